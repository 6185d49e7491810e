"""Audit and repair of a sealed store by file: only changed files are read, only damaged ones are written anew.

The manifest has a line for each file: its size and time, its rows, how many fail their checksum, and the sum of all
checksums. A file whose size and time are those of its line is not read again. A repaired file is written beside the
damaged one, and the next manifest names it in its place; so readers, who go by the manifest, see either all of a
repair or nothing of it.

    _manifest/version=N   the lines; the last complete version counts
    _fixed/version=N      files that a repair has written
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.model import REV
from revlens.operators.store import audit, corrupted, delete, exists, folders, intact

LIVE, REPLACED = "live", "replaced"
LINES = "file string, size long, modified timestamp, rows long, bad long, total long, state string, checked long"
_NAMES = [part.split()[0] for part in LINES.split(", ")]
_PLACE = {"file": "_metadata.file_path", "size": "_metadata.file_size", "modified": "_metadata.file_modification_time"}


def _versions(spark: SparkSession, path: str) -> list[int]:
    folder = os.path.join(path, "_manifest")
    found = sorted(int(name.partition("=")[2]) for name in folders(spark, folder) if name.startswith("version="))
    return [n for n in found if exists(spark, os.path.join(folder, f"version={n}", "_SUCCESS"))]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The manifest as it stands; empty before the first audit."""
    versions = _versions(spark, path)
    if not versions:
        return spark.createDataFrame([], LINES)
    return spark.read.schema(LINES).parquet(os.path.join(path, "_manifest", f"version={versions[-1]}"))


def _files_now(spark: SparkSession, path: str) -> DataFrame:
    """Files of the store as they lie there. No content is read."""
    places = [x for x in (path, os.path.join(path, "_fixed")) if exists(spark, x)]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(places)
    return listed.select(*[F.col(c).alias(name) for name, c in _PLACE.items()])


def _checked(rows: DataFrame, version: int) -> DataFrame:
    """Lines of the files that sealed rows are read from."""
    found = audit(rows.select(*REV, "payload", "crc", *[F.col(c).alias(name) for name, c in _PLACE.items()]))
    sums = found.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") != "ok").alias("bad"), F.coalesce(F.sum("crc"), F.lit(0)).alias("total"))
    return sums.withColumns({"state": F.lit(LIVE), "checked": F.lit(version).cast("long")}).select(*_NAMES)


def _write(spark: SparkSession, path: str, version: int, new: DataFrame) -> DataFrame:
    new.select(*_NAMES).write.mode("overwrite").parquet(os.path.join(path, "_manifest", f"version={version}"))
    return lines(spark, path)


def audit_files(spark: SparkSession, path: str, schema: T.StructType, whole: bool = False) -> DataFrame:
    """Bring the manifest up to date; returns its lines. Column ``checked`` is the version in which a file was read last.

    Files that are new or changed are read; with ``whole`` all are. A file without rows has no line. A file that is
    gone has none either.
    """
    known, version = lines(spark, path), (_versions(spark, path) or [-1])[-1] + 1
    now = _files_now(spark, path)
    kept = known.join(now, list(_PLACE), "left_semi")
    if whole:
        kept = kept.where(F.col("state") == REPLACED)
    open_ = [r["file"] for r in now.join(kept, list(_PLACE), "left_anti").select("file").collect()]  # a row for each file
    if open_:
        kept = kept.unionByName(_checked(spark.read.schema(schema).parquet(*open_), version))
    return _write(spark, path, version, kept)


def _rows_of(spark: SparkSession, found: DataFrame, schema: T.StructType) -> DataFrame:
    files = [r["file"] for r in found.select("file").collect()]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def stored_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the files that the manifest names."""
    return _rows_of(spark, lines(spark, path).where(F.col("state") == LIVE), schema)


def damaged_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows that fail their checksum, by the manifest as it stands: only files with such rows are read."""
    return corrupted(_rows_of(spark, lines(spark, path).where((F.col("state") == LIVE) & (F.col("bad") > 0)), schema))


def repair_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Write the intact rows of damaged files anew and name them in place of these; returns ``stored_rows``.

    Files without damage stay as they are and are not read. One writer at a time; a repair that ended early is done
    over by the next.
    """
    known = lines(spark, path)
    hit = known.where((F.col("state") == LIVE) & (F.col("bad") > 0))
    names = [r["file"] for r in hit.select("file").collect()]  # a row for each damaged file
    if not names:
        return stored_rows(spark, path, schema)
    version = _versions(spark, path)[-1] + 1
    fixed = os.path.join(path, "_fixed", f"version={version}")
    intact(spark.read.schema(schema).parquet(*names)).write.mode("overwrite").parquet(fixed)
    gone = F.col("file").isin(names)
    old = known.withColumn("state", F.when(gone, REPLACED).otherwise(F.col("state")))
    _write(spark, path, version, old.unionByName(_checked(spark.read.schema(schema).parquet(fixed), version)))
    for name in names:
        delete(spark, name)
    return stored_rows(spark, path, schema)

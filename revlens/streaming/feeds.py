"""Structured Streaming over a feed of revisions.

Every result is written below a path in the shared folder. A batch's output goes
to a folder named after the batch, or is filtered against what is stored, so that
a batch replayed after a failure changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.functions import times
from revlens.model import LINE
from revlens.operators import filed
from revlens.operators.store import delete, exists, folders, is_file
from revlens.sources.diffs import diffstat_from_diffs
from revlens.sources.pieces import folded, read_pieces

BATCH = "batch_id"


def feed(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    """An append-only folder of Parquet files, or one such file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_file(spark, path):
        path, name = os.path.split(path)
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def slot_totals(revs: DataFrame, amount: Column, width: str = "1 day") -> DataFrame:
    """Commits and churn per slot."""
    slots = revs.groupBy(*LINE, F.window(F.timestamp_seconds("date"), width))
    sums = slots.agg(F.count("*").alias("commits"), F.sum(amount).alias("churn"))
    return sums.select(*LINE, F.unix_seconds("window.start").alias("slot"), "commits", "churn")


def author_totals(revs: DataFrame, amount: Column) -> DataFrame:
    """Commits and lines per author."""
    return revs.where("author <> ''").groupBy(*LINE, "author").agg(F.count("*").alias("commits"), F.sum(amount).alias("loc"))


def punchcard_cells(revs: DataFrame) -> DataFrame:
    """Commits per weekday and hour."""
    cells = revs.where("date <> 0").withColumns({"dow": times.weekday(F.col("date")), "hour": times.hour(F.col("date"))})
    return cells.groupBy(*LINE, "dow", "hour").agg(F.count("*").alias("n"))


def _drain(writer, path: str) -> None:
    query = writer.option("checkpointLocation", os.path.join(path, "_progress")).trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(stream: DataFrame, path: str) -> DataFrame:
    """Drain the feed into Parquet files; returns the table written so far."""
    out = os.path.join(path, "rows")
    _drain(stream.writeStream.outputMode("append").format("parquet").option("path", out), path)
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def per_batch(stream: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> str:
    """Drain the feed, writing each batch's (shaped) rows to its own folder."""
    out = os.path.join(path, "batches")

    def write(batch: DataFrame, number: int) -> None:
        shape(batch).write.mode("overwrite").parquet(os.path.join(out, f"{BATCH}={number}"))

    _drain(stream.writeStream.outputMode("append").foreachBatch(write), path)
    return out


def totals_so_far(stream: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Sums over all that was ever fed, whatever its dates: no row is late and no slot stays open.

    Each batch is summed by ``shape`` and its sums are stored; reading adds them up by ``keys``. No state is
    kept but these sums, and they are merged from time to time (``compact``).
    """
    spark = stream.sparkSession
    schema = shape(spark.createDataFrame([], stream.schema)).schema
    out = per_batch(stream, path, shape)
    compact(spark, out, keys, schema, UNMERGED)
    return _merged(spark, out, keys, schema)


#: Batches whose sums are read one by one.
UNMERGED = 50


def _stored(spark: SparkSession, out: str) -> tuple[int, list[str], list[tuple[int, str]]]:
    """The last batch that is merged (-1: none), the folder with all up to it, and the batches after it."""

    def numbered(folder: str, mark: str) -> list[tuple[int, str]]:
        found = [(name.partition("=")[2], os.path.join(folder, name)) for name in folders(spark, folder) if name.startswith(mark)]
        return sorted((int(n), path) for n, path in found)

    merged = [x for x in numbered(os.path.join(out, "merged"), "upto=") if exists(spark, os.path.join(x[1], "_SUCCESS"))]
    last, base = (merged[-1][0], [merged[-1][1]]) if merged else (-1, [])
    return last, base, [x for x in numbered(out, BATCH + "=") if x[0] > last]


def _merged(spark: SparkSession, out: str, keys: list[str] | None, schema: T.StructType) -> DataFrame:
    """All that is stored: sums by ``keys``, or (None) the rows themselves."""
    _, base, later = _stored(spark, out)
    paths = base + [path for _, path in later]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if keys is None:
        return rows
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in schema.names if c not in keys])


def compact(spark: SparkSession, out: str, keys: list[str] | None, schema: T.StructType, unmerged: int) -> None:
    """Merge stored sums, or rows, once there are more than ``unmerged`` batches.

    The merged folder counts once it is complete; only then the folders that it replaces go. Run by the feed's
    writer between two drains.
    """
    _, base, later = _stored(spark, out)
    if len(later) <= unmerged:
        return
    upto = os.path.join(out, "merged", f"upto={later[-1][0]}")
    _merged(spark, out, keys, schema).write.mode("overwrite").parquet(upto)
    for path in base + [path for _, path in later]:
        delete(spark, path)


def store_new(stream: DataFrame, path: str) -> DataFrame:
    """Keep a store up to date: each batch adds the revisions the store lacks, whatever their dates.

    A batch opens only the files that may hold its ids; ``filed.reports`` of the folder ``store`` tells how many rows.
    """
    out = os.path.join(path, "store")
    _drain(stream.writeStream.foreachBatch(lambda batch, _: filed.append(batch, out)), path)
    return filed.stored(stream.sparkSession, out, stream.schema)


def once_each(stream: DataFrame, path: str) -> DataFrame:
    """Each revision once, however often and however late it is fed: what the store holds is not taken again."""
    return store_new(stream, path)


def rows_so_far(stream: DataFrame, path: str, shape: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The shaped rows of all batches; their folders are merged from time to time."""
    spark = stream.sparkSession
    schema = shape(spark.createDataFrame([], stream.schema)).schema
    out = per_batch(stream, path, shape)
    compact(spark, out, None, schema, UNMERGED)
    return _merged(spark, out, None, schema)


def parse_diffs(stream: DataFrame, path: str) -> DataFrame:
    """File changes of a stream of raw diffs. What cannot be read does not stop it; ``rejected`` lists such diffs."""
    return rows_so_far(stream, path, diffstat_from_diffs)


def parse_pieces(stream: DataFrame, path: str) -> DataFrame:
    """File changes of a stream of pieces of diffs (repo, id, piece, diff), whichever batches the pieces of a diff come in.

    What each batch stores is a summary of its pieces; the summaries of all batches are folded when they are read.
    """
    return folded(rows_so_far(stream, path, read_pieces))

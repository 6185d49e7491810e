"""The incremental revision store: append what is new, audit, repair."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revlens.model import REV
from revlens.operators.sets import missing_from_store
from revlens.session import written

# Newest store version, and per backend the last version whose
# content is stale.
STORE_VERSION = 5
STALE_UPTO = {"subversion": 2, "git": 4}
STALE_FOR_ALL = 1

OK, STALE, UNKNOWN, CORRUPT = "ok", "out of date", "unknown", "corrupted"


def hit_counts(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """How many requested revisions the store holds already and how many it lacks, per repository."""
    marked = requested.select(*REV).join(stored.select(*REV).distinct().withColumn("held", F.lit(1)), REV, "left")
    held = F.coalesce("held", F.lit(0))
    return marked.groupBy("repo").agg(
        F.sum(held.cast("long")).alias("hits"), F.sum((1 - held).cast("long")).alias("misses")
    )


def append_new(incoming: DataFrame, path: str) -> DataFrame:
    """Append the revisions the store at ``path`` lacks; returns the store."""
    spark = incoming.sparkSession
    fresh = written(incoming.dropDuplicates(REV), "batch")
    if exists(spark, path):
        fresh = missing_from_store(fresh, spark.read.schema(incoming.schema).parquet(path))
    fresh.write.mode("append").parquet(path)
    return spark.read.schema(incoming.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop)


def read_if_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``; empty as long as there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path``."""
    system, hadoop = _file_system(spark, path)
    return [s.getPath().getName() for s in system.listStatus(hadoop) if s.isDirectory()] if system.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    system, hadoop = _file_system(spark, path)
    system.delete(hadoop, True)


def is_file(spark: SparkSession, path: str) -> bool:
    system, hadoop = _file_system(spark, path)
    return system.exists(hadoop) and system.getFileStatus(hadoop).isFile()


def seal(rows: DataFrame) -> DataFrame:
    """Add the checksum of each payload."""
    return rows.withColumn("crc", F.crc32(F.col("payload")))


def version_status(version: Column, backend: Column) -> Column:
    """Whether a store of this version can be read for this backend."""
    stale = version <= STALE_FOR_ALL
    for name, upto in STALE_UPTO.items():
        stale = stale | ((backend == name) & (version <= upto))
    return F.when(version <= 0, UNKNOWN).when(stale, STALE).when(version <= STORE_VERSION, OK).otherwise(UNKNOWN)


def audit(stored: DataFrame) -> DataFrame:
    """Status of every stored revision: does its payload still match its checksum?"""
    matches = F.crc32(F.col("payload")).eqNullSafe(F.col("crc"))
    return stored.withColumn("status", F.when(matches, OK).otherwise(CORRUPT))


def corrupted(stored: DataFrame) -> DataFrame:
    return audit(stored).where(F.col("status") == CORRUPT)


def intact(stored: DataFrame) -> DataFrame:
    return audit(stored).where(F.col("status") == OK).drop("status")


def repair(spark: SparkSession, path: str, fixed_path: str, schema: T.StructType | None = None) -> DataFrame:
    """Write the intact rows of a store to a new path and return that store. Without ``schema`` it is read from the files.

    The new path is complete or absent (the output is committed as a whole), so
    that readers are switched over only to a finished copy.
    """
    stored = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    intact(stored).write.mode("errorifexists").parquet(fixed_path)
    return spark.read.schema(stored.schema).parquet(os.fspath(fixed_path))

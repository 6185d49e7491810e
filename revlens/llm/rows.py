"""Rows in and out of Arrow batches, and rows in the order of an id."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revlens.llm import tokens

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE = 512


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies. A cluster gets it by --py-files."""
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, words: bool = False) -> DataFrame:
    """``mapInArrow``. Workers go on to other stages: a task gives back the memory it had, and only tasks that encode
    ``words`` leave their dictionaries to the next."""
    importable(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not words:
            tokens.forget()
        yield from fn(batches)
        tokens.give_back()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Smaller batches: what is decoded at a time stays small when texts are long."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(column: pa.Array) -> list[str]:
    """Strings; a null is empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def blobs(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes; a null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns that operators on texts read; all others, whatever their names, stay out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(docs: DataFrame, parts: int | None = None) -> tuple[DataFrame, list[int | None]]:
    """Rows of (doc_id, text) dealt to partitions by ranges of doc_id, and each part's smallest id (None: no row).

    The first pass reads ids only. Null ids come first, rows of one id stay in one part.
    Column ``part`` is the number of the range; it is also the number of the partition.
    """
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    ids = docs.select("doc_id")
    at = [i / parts for i in range(1, parts)]
    splits = ids.agg(F.percentile_approx("doc_id", at, 100 * parts).alias("s")).first()["s"] if at else []
    cuts = np.array(sorted(set(splits or [])), dtype="int64")
    importable(spark)

    @F.arrow_udf("int")
    def part_of(doc_id: pa.Array) -> pa.Array:
        null = doc_id.is_null().to_numpy(zero_copy_only=False)
        found = np.searchsorted(cuts, doc_id.fill_null(0).to_numpy(), side="right")
        return pa.array(np.where(null, 0, found), pa.int32())

    dealt = docs.withColumn("part", part_of("doc_id"))
    least = ids.withColumn("part", part_of("doc_id")).groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("null"))
    firsts: list = [()] * (len(cuts) + 1)
    for row in least.collect():  # a row for each part
        firsts[row["part"]] = (None if row["null"] else row["least"],)
    return dealt, firsts


def dealt_by_part(df: DataFrame, parts: int) -> DataFrame:
    return df.repartitionById(parts, F.col("part"))


def running_total(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, for a table of a few rows (one for each file)."""
    before = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")))


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def flat(lists) -> list:
    return list(chain.from_iterable(lists))

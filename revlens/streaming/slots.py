"""Slots of time that close: each is reported once, when the feed has moved on, and later rows are corrections to it.

A slot's sums are state under its key; a timer in event time ends it. A row for a slot that has ended is not dropped,
as a windowed aggregate would, but given out as a correction. So what was given out, and what is still open, adds up
to the batch answer at any time. The file sink and the state share a checkpoint: a replayed batch changes nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from revlens.model import LINE
from revlens.operators.store import exists
from revlens.session import importable

DAY = 86400
#: Keys that a slot of a history line is dealt to, since it may hold most rows of a batch.
PARTS = 8
CLOSED, LATE, OPEN = "closed", "late", "open"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEYS = [*LINE, "slot", "part"]
_OUT = "repo string, branch string, slot long, part int, kind string, commits long, churn long"


class Slots(StatefulProcessor):
    """Sums of one slot, until its end is past the watermark."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "commits long, churn long")

    def _row(self, key, kind: str, commits: int, churn: int) -> pd.DataFrame:
        return pd.DataFrame({**{name: [value] for name, value in zip(_KEYS, key, strict=True)}, "kind": [kind], "commits": [commits], "churn": [churn]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        commits = churn = 0
        for chunk in rows:
            commits += len(chunk)
            churn += int(chunk["churn"].sum())
        end = (int(key[2]) + self.width) * 1000
        if end <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, LATE, commits, churn)
            return
        if self.sums.exists():
            had = self.sums.get()
            commits, churn = commits + had[0], churn + had[1]
        else:
            self.handle.registerTimer(end)
        self.sums.update((commits, churn))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        commits, churn = self.sums.get()
        self.sums.clear()
        yield self._row(key, CLOSED, commits, churn)

    def close(self) -> None:
        pass


def closing_slots(revs: DataFrame, amount: Column, path: str, width: int = DAY, delay: str = "1 day") -> DataFrame:
    """Drain a feed of revisions (repo, branch, id, date); returns ``reported`` of the folder.

    A slot closes once a revision is ``delay`` past its end. An undated revision belongs to the slot of date 0.
    """
    spark = revs.sparkSession
    importable(spark)
    date = F.coalesce("date", F.lit(0).cast("long"))
    timed = revs.select(*LINE, date.alias("date"), F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part"), F.coalesce(amount, F.lit(0)).cast("long").alias("churn"))
    marked = timed.withColumn("at", F.timestamp_seconds("date")).withWatermark("at", delay)
    # without the column of the watermark rows behind it reach the processor
    keyed = marked.select(*LINE, (F.col("date") - F.pmod("date", F.lit(width))).alias("slot"), "part", "churn")
    rows = keyed.groupBy(*_KEYS).transformWithStateInPandas(Slots(width), _OUT, "Append", "EventTime")
    had = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        writer = rows.writeStream.outputMode("append").format("parquet").option("path", os.path.join(path, "rows"))
        query = writer.option("checkpointLocation", os.path.join(path, "_progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if had is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, had)
    return reported(spark, path)


def reported(spark: SparkSession, path: str) -> DataFrame:
    """repo, branch, slot, kind, commits, churn of what was given out: one row for a closed slot, and one with all its corrections."""
    out = os.path.join(path, "rows")
    rows = spark.read.schema(_OUT).parquet(out) if exists(spark, os.path.join(out, "_spark_metadata")) else spark.createDataFrame([], _OUT)
    return _summed(rows)


def still_open(spark: SparkSession, path: str) -> DataFrame:
    """The same columns for slots that have not closed, read from the stream's state."""
    progress = os.path.join(path, "_progress")
    if not exists(spark, os.path.join(progress, "state")):
        return _summed(spark.createDataFrame([], _OUT))
    state = spark.read.format("statestore").option("path", progress).option("stateVarName", "sums").load()
    return _summed(state.select("key.*", F.lit(OPEN).alias("kind"), "value.*"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*LINE, "slot", "kind").agg(F.sum("commits").alias("commits"), F.sum("churn").alias("churn"))


def totals_now(spark: SparkSession, path: str) -> DataFrame:
    """repo, branch, slot, commits, churn: closed slots with their corrections, and open ones as they stand."""
    every = reported(spark, path).unionByName(still_open(spark, path))
    return every.groupBy(*LINE, "slot").agg(F.sum("commits").alias("commits"), F.sum("churn").alias("churn"))

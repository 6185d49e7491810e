"""User callbacks over revisions."""

from __future__ import annotations

import gc
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.session import written


def map_revisions(revs: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to every selected revision, one Arrow batch at a time.

    A worker holds one batch's values, however many it reads: Spark keeps the frame it handed out while it reads the
    next, so that one is emptied, and what ``fn`` leaves in cycles (pandas' ``.str`` ties a column to itself) is freed.
    """

    def run(batches):
        for batch in batches:
            out = fn(batch.copy(deep=False))
            batch.drop(columns=batch.columns, inplace=True)
            gc.collect(1)  # what the call left is young
            yield out

    return revs.mapInPandas(run, schema)


def fold_by(
    revs: DataFrame,
    keys: list[str],
    fold: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    spread: int = 64,
) -> DataFrame:
    """Fold each group with user code without gathering the group.

    ``fold`` turns any piece of one group into one row of ``schema``; ``merge``
    turns several such rows of a group into one and must not depend on their
    order. Pieces are folded where they are read, partial rows are merged in
    ``spread`` sub-groups and then once more, so that a group holding a third of
    all revisions never meets in one task.
    """

    def fold_batches(batches):
        for batch in batches:
            parts = [fold(part) for _, part in batch.groupby(keys, sort=False, dropna=False)]
            if parts:
                yield pd.concat(parts, ignore_index=True)

    partial = revs.mapInPandas(fold_batches, schema)
    salted = partial.withColumn("__salt", F.pmod(F.xxhash64(*partial.columns), F.lit(spread)))
    names = partial.columns

    def merge_part(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf[names])

    once = salted.groupBy(*keys, "__salt").applyInPandas(merge_part, schema)
    return once.groupBy(*keys).applyInPandas(merge_part, schema)


def fold_in_order(
    revs: DataFrame,
    keys: list[str],
    fold: Callable[[pd.DataFrame], pd.DataFrame],
    merge: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    order: str = "seq",
) -> DataFrame:
    """Fold each group in log order, for user code that depends on it.

    ``fold`` turns a run of neighbouring rows of a group, in order, into one row of ``schema``, which has the
    keys; ``merge`` turns the rows of neighbouring runs, in order, into one. Rows are dealt by ranges of keys and
    order, so a large group is folded by many tasks; in the end one row for each range and group is merged. The
    ranges are stored with their rows: a retry of a task sees the same ones.
    """
    ranged = written(revs.repartitionByRange(*keys, order).withColumn("__part", F.spark_partition_id()), "runs")
    dealt = ranged.repartition("__part").sortWithinPartitions("__part", *keys, order)

    def fold_runs(batches):
        held, last = None, None
        for batch in batches:
            for key, run in batch.groupby(["__part", *keys], sort=False, dropna=False):
                row = fold(run.drop(columns="__part")).assign(part=key[0])
                if held is not None and repr(key) == last:
                    held = merge(pd.concat([held, row], ignore_index=True).drop(columns="part")).assign(part=key[0])
                else:
                    if held is not None:
                        yield held
                    held, last = row, repr(key)
        if held is not None:
            yield held

    def merge_runs(pdf: pd.DataFrame) -> pd.DataFrame:
        return merge(pdf.sort_values("part").drop(columns="part").reset_index(drop=True))

    partial = dealt.mapInPandas(fold_runs, f"{schema}, part int")
    return partial.groupBy(*keys).applyInPandas(merge_runs, schema)

"""Set operations on revision ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.model import REV


def union_ids(fetched: DataFrame, stored: DataFrame) -> DataFrame:
    return fetched.select(*REV).unionByName(stored.select(*REV)).distinct()


def missing_ids(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested revisions the store does not hold.

    The store may have any number of rows per revision: they are reduced to one
    before they are shuffled.
    """
    return requested.join(stored.select(*REV).distinct(), REV, "left_anti")


def missing_from_store(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of a stored, small batch that a large store lacks.

    The store is reduced to the batch's ids first: as its size is known, the batch is broadcast and the store is
    read where it lies; a batch too large for that is shuffled with it.
    """
    held = stored.select(*REV).join(batch.select(*REV), REV, "left_semi").distinct()
    return batch.join(held, REV, "left_anti")


def hit_ids(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested revisions the store holds."""
    return requested.join(stored.select(*REV).distinct(), REV, "left_semi")


def overlay(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Per key the row with the highest ordinal: what was written last wins."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("last"))
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest])

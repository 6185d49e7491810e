"""Top-N, remainders and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import written

OTHERS = "Others"


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null for an empty whole."""
    return F.when(whole != 0, part / whole)


def sized_join(facts: DataFrame, dims: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join facts to a derived side with one row per key.

    That side is written first, so that the planner knows its real size: a small
    one is broadcast and the facts are not shuffled at all. Otherwise both sides of
    the join are plain shuffles, which adaptive execution can split where one key
    holds much of the facts.
    """
    return facts.join(written(dims, "dims"), on, how)


def spread_join(facts: DataFrame, dims: DataFrame, on: list[str], by: list[str], how: str = "inner", spread: int = 64) -> DataFrame:
    """``sized_join`` for the few, possibly huge, groups of a history line.

    Each key is split into ``spread`` sub-keys by a hash of ``by``; the one-row
    side is repeated for each. A later aggregation on finer keys then shuffles
    again instead of staying on the partitions of the coarse key.
    """
    salted = facts.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(spread)))
    salts = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)).cast("array<bigint>"))
    copies = written(dims, "dims").withColumn("__salt", salts)
    return salted.join(copies, on + ["__salt"], how).drop("__salt")


def rank(df: DataFrame, keys: list[str], metric: str, tie: list[str], n: int) -> DataFrame:
    """Add ``rank`` by metric descending and keep the first ``n``.

    Ties go to the smaller tie column. The rank filter lets each task cut its own
    rows down to ``n`` per key before anything is shuffled. Spark does so for ``n``
    up to a threshold; beyond it, salted parts of a key are cut first, so that no
    task ever sorts a whole key.
    """
    if n > int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")):
        salted = df.withColumn("__salt", F.pmod(F.xxhash64(metric, *tie), F.lit(256)))
        part = Window.partitionBy(*keys, "__salt").orderBy(F.col(metric).desc(), *tie)
        df = salted.withColumn("__nth", F.row_number().over(part)).where(F.col("__nth") <= n).drop("__salt", "__nth")
    window = Window.partitionBy(*keys).orderBy(F.col(metric).desc(), *tie)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_n(df: DataFrame, metric: str, tie: list[str], n: int = 6) -> DataFrame:
    """The ``n`` largest rows of the whole frame."""
    return df.orderBy(F.col(metric).desc(), *tie).limit(n)


def keep_members(df: DataFrame, chosen: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the chosen entities only."""
    return df.join(chosen.select(*on), on, "left_semi")


def label_others(df: DataFrame, chosen: DataFrame, on: list[str], column: str, label: str = OTHERS) -> DataFrame:
    """Replace ``column`` by a common label where the entity was not chosen."""
    marked = chosen.select(*on).withColumn("__chosen", F.lit(True))
    joined = df.join(marked, on, "left")
    return joined.withColumn(column, F.when(F.col("__chosen"), F.col(column)).otherwise(label)).drop("__chosen")


def top_n_and_others(
    df: DataFrame, keys: list[str], entity: str, metric: str, n: int = 6, label: str = OTHERS
) -> DataFrame:
    """Top ``n`` entities per key plus one remainder row, with ``total`` per key.

    ``df`` holds one row per (key, entity) and is computed once. The remainder is
    the key's total minus what was kept, so that only ``n`` rows per key are joined.
    """
    df = written(df, "sizes")
    top = rank(df, keys, metric, [entity], n).select(*keys, entity, metric, "rank")
    totals = df.groupBy(*keys).agg(F.sum(metric).alias("total"))
    kept = top.groupBy(*keys).agg(F.sum(metric).alias("__kept"), F.count("*").alias("__shown"))
    both = totals.join(kept, keys)
    rest = both.select(
        *keys,
        F.lit(label).alias(entity),
        (F.col("total") - F.col("__kept")).alias(metric),
        (F.col("__shown") + 1).cast("int").alias("rank"),
        "total",
        F.lit(True).alias("is_rest"),
    )
    return top.join(totals, keys).withColumn("is_rest", F.lit(False)).unionByName(rest)


def shares(df: DataFrame, keys: list[str], entity: str, metric: str, n: int = 6) -> DataFrame:
    """Fraction of the key's total for the top ``n``; ``Others`` fills up to one.

    The remainder row is left out when the top ``n`` reach 0.99999 of the total.
    """
    parts = top_n_and_others(df, keys, entity, metric, n)
    shown = parts.where(~F.col("is_rest") | (F.col(metric) > F.lit(0.00001) * F.col("total")))
    return shown.withColumn("share", ratio(F.col(metric), F.col("total")))


def arcs(df: DataFrame, keys: list[str], metric: str, total: str = "total") -> DataFrame:
    """[arc_from, arc_to) of each ranked item and its rounded percentage."""
    upto = F.sum(metric).over(Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("__upto", upto).select(
        "*",
        ratio(F.col("__upto") - F.col(metric), F.col(total)).alias("arc_from"),
        ratio(F.col("__upto"), F.col(total)).alias("arc_to"),
        F.floor(F.lit(100) * ratio(F.col(metric), F.col(total)) + 0.5).alias("pct"),
    ).drop("__upto")


def normalize(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    """Scale the values of a key to sum 1; an all-zero key stays as it is."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    joined = spread_join(df, totals, keys, df.columns)
    scaled = F.when(F.col("__sum") == 0, F.col(value).cast("double")).otherwise(F.col(value) / F.col("__sum"))
    return joined.withColumn(out, scaled).drop("__sum")


def swap_last(df: DataFrame, keys: list[str], entity: str, special: str) -> DataFrame:
    """Let the special entity trade places with the last of the kept ranks."""
    kept = Window.partitionBy(*keys)
    bounds = df.withColumns(
        {
            "__last": F.max("rank").over(kept),
            "__spot": F.max(F.when(F.col(entity) == special, F.col("rank"))).over(kept),
        }
    )
    swapped = (
        F.when(F.col("__spot").isNull(), F.col("rank"))
        .when(F.col("rank") == F.col("__spot"), F.col("__last"))
        .when(F.col("rank") == F.col("__last"), F.col("__spot"))
        .otherwise(F.col("rank"))
    )
    return bounds.withColumn("rank", swapped).drop("__last", "__spot")

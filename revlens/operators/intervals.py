"""Coverage arithmetic over intervals of fetched ids. Bounds are inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.operators.ranking import spread_join
from revlens.operators.scan import by_position, scan
from revlens.session import written


def coalesce_intervals(intervals: DataFrame, keys: list[str], merge_adjacent: bool = False) -> DataFrame:
    """Merge overlapping intervals of a key; touching ones only on request."""
    longest = written(intervals.groupBy(*keys, "start").agg(F.max("end").alias("end")), "intervals")
    seen = scan(longest, keys, ["start"], {"reach": ("max", F.col("end"))}, by_position("start"), exclusive=True)
    gap = 1 if merge_adjacent else 0
    opens = F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap)
    # an island is named by the start that opened it: the latest opening start so far
    named = scan(
        seen, keys, ["start"], {"island": ("max", F.when(opens, F.col("start")))}, by_position("start")
    )
    return named.groupBy(*keys, F.col("island").alias("start")).agg(F.max("end").alias("end"))


def missing_intervals(intervals: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of each request [start, end] no stored interval covers.

    ``requests`` holds one row per key.
    """
    wanted = requests.select(*keys, F.col("start").alias("from"), F.col("end").alias("to"))
    # the request's own borders stand in as covered neighbours, so that every gap
    # lies between two consecutive intervals and a key without any is one gap
    borders = wanted.select(
        *keys,
        F.explode(
            F.array(
                F.struct((F.col("from") - 1).alias("start"), (F.col("from") - 1).alias("end")),
                F.struct((F.col("to") + 1).alias("start"), (F.col("to") + 1).alias("end")),
            )
        ).alias("b"),
    ).select(*keys, "b.start", "b.end")
    near = (F.col("end") >= F.col("from")) & (F.col("start") <= F.col("to"))
    stored = spread_join(intervals, wanted, keys, ["start", "end"]).where(near)
    clipped = stored.select(
        *keys,
        F.greatest("start", "from").alias("start"),
        F.least("end", "to").alias("end"),
    )
    covered = written(coalesce_intervals(clipped.unionByName(borders), keys, merge_adjacent=True), "covered")
    ends = scan(covered, keys, ["start"], {"before": ("max", F.col("end"))}, by_position("start"), exclusive=True)
    return ends.where("before is not null").select(
        *keys, (F.col("before") + 1).alias("start"), (F.col("start") - 1).alias("end")
    )


def ids_served(intervals: DataFrame, ids: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Known ids inside the request of their key that a stored interval covers.

    Each id looks up the last merged interval that starts at or before it: one
    pass over ids and intervals in order, no pair is formed.
    """
    wanted = requests.select(*keys, F.col("start").alias("from"), F.col("end").alias("to"))
    asked = spread_join(ids, wanted, keys, ["id"]).where(F.col("id").between(F.col("from"), F.col("to")))
    merged = written(coalesce_intervals(intervals, keys), "merged")
    marks = merged.select(*keys, F.col("start").alias("id"), F.lit(0).alias("kind"), "end")
    probes = asked.select(*keys, "id").distinct().select(*keys, "id", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"))
    line = scan(marks.unionByName(probes), keys, ["id", "kind"], {"cover": ("max", F.col("end"))}, by_position("id"))
    return line.where((F.col("kind") == 1) & (F.col("cover") >= F.col("id"))).select(*keys, "id")

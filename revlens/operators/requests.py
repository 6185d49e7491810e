"""Many requests for ranges of ids, against stored intervals, without comparing each with each.

A range is cut into dyadic pieces: numbers that agree but for their last k bits, at most two pieces for each k. A
number lies in exactly one piece of each size, so "the number is in the range" is an equality of (size, piece), and a
join on it yields one row for each true case and no other. Two ranges overlap if one starts inside the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.intervals import coalesce_intervals
from revlens.operators.scan import by_position, scan
from revlens.session import written

_PIECE = ["bits", "piece"]


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftright", x, bits.cast("int"))


def pieces(start: Column, end: Column, most: int) -> Column:
    """The dyadic pieces (bits, piece) that make up [start, end], of numbers from 0 to below 2 ** most; none if it is empty."""

    def of_size(bits: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))
        low, high = _shifted(start + size - 1, bits), _shifted(end + 1, bits)
        some, odd = low < high, F.lit(1).cast("long")
        return F.array_compact(
            F.array(
                F.when(some & (low.bitwiseAND(odd) == 1), F.struct(bits.alias("bits"), low.alias("piece"))),
                F.when(some & (high.bitwiseAND(odd) == 1), F.struct(bits.alias("bits"), (high - 1).alias("piece"))),
            )
        )

    # a piece is no larger than the range, so only the sizes up to its own are tried
    own = F.length(F.bin(F.greatest(end - start + 1, F.lit(1).cast("long")))) - 1
    return F.flatten(F.transform(F.sequence(F.lit(0), F.least(F.lit(most), own)), of_size))


def points_inside(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """Rows of ``points`` joined to the rows of ``ranges`` whose [start, end] holds their number ``at``.

    Both have the keys, and no other column in common. Sizes of pieces that no range has are not tried. Wide ranges
    share large pieces: such a piece holds many points and many ranges, all of which are pairs that are asked for.
    """
    bounds = points.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    empty = points.join(ranges, keys).where(F.lit(False))
    if bounds["low"] is None:
        return empty
    low, most = bounds["low"], max(1, (bounds["high"] - bounds["low"] + 1).bit_length())
    clipped = F.greatest(F.col(start), F.lit(low)) - low, F.least(F.col(end), F.lit(bounds["high"])) - low
    cut = written(ranges.withColumn("_p", F.explode(pieces(*clipped, most))).select(*ranges.columns, "_p.*"), "pieces")
    sizes = sorted(cut.agg(F.collect_set("bits")).first()[0])  # at most 64
    if not sizes:
        return empty
    own = F.explode(F.array(*[F.struct(F.lit(k).alias("bits"), F.shiftright(F.col(at) - low, k).alias("piece")) for k in sizes]))
    return points.withColumn("_p", own).select(*points.columns, "_p.*").join(cut, [*keys, *_PIECE]).drop(*_PIECE)


def gaps_between(intervals: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Ranges (gap_start, gap_end) that no interval covers, null for an end without bound, for each key of ``wanted``."""
    merged = written(coalesce_intervals(intervals, keys, merge_adjacent=True), "islands")
    before = scan(merged, keys, ["start"], {"before": ("max", F.col("end"))}, by_position("start"), exclusive=True)
    inner = before.select(*keys, (F.col("before") + 1).alias("gap_start"), (F.col("start") - 1).alias("gap_end"))
    last = merged.groupBy(*keys).agg((F.max("end") + 1).alias("gap_start")).withColumn("gap_end", F.lit(None).cast("long"))
    bare = wanted.select(*keys).distinct().join(merged.select(*keys).distinct(), keys, "left_anti")
    whole = bare.withColumns({"gap_start": F.lit(None).cast("long"), "gap_end": F.lit(None).cast("long")})
    return inner.unionByName(last).unionByName(whole)


def missing_parts(intervals: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, req, start, end): the parts of each request (keys, req, start, end) that no stored interval covers.

    A key may have any number of requests, and they may overlap; a request with its end before its start is empty.
    Requests of a key without intervals are missing as a whole. Bounds are inclusive; null keys match nothing.
    """
    asked = written(requests.where("start <= end").select(*keys, "req", F.col("start").alias("from"), F.col("end").alias("to")), "asked")
    gaps = written(gaps_between(intervals, keys, asked), "gaps")
    least = F.least(F.coalesce("gap_end", "to"), "to")
    # gaps that start inside a request, after its first number
    later = points_inside(gaps.where("gap_start is not null"), "gap_start", asked.withColumn("after", F.col("from") + 1), "after", "to", keys)
    later = later.select(*keys, "req", F.col("gap_start").alias("start"), least.alias("end"))
    # the gap, if any, in which a request starts: the last one that starts at or before it
    marks = gaps.select(*keys, F.coalesce("gap_start", F.lit(-(2**63))).alias("at"), F.lit(0).alias("kind"), F.struct(F.coalesce("gap_start", F.lit(-(2**63))).alias("s"), "gap_end").alias("gap"))
    probes = asked.select(*keys, F.col("from").alias("at")).distinct().withColumn("kind", F.lit(1))
    line = scan(marks.unionByName(probes, allowMissingColumns=True), keys, ["at", "kind"], {"last": ("max", F.col("gap"))}, by_position("at"))
    open_ = line.where("kind = 1 and last is not null and (last.gap_end is null or last.gap_end >= at)")
    first = asked.join(open_.select(*keys, F.col("at").alias("from"), F.col("last.gap_end").alias("gap_end")), [*keys, "from"])
    return first.select(*keys, "req", F.col("from").alias("start"), least.alias("end")).unionByName(later)


def served_ids(intervals: DataFrame, ids: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, req, id): the known ids inside each request (keys, req, start, end) that a stored interval covers."""
    merged = written(coalesce_intervals(intervals, keys), "merged")
    marks = merged.select(*keys, F.col("start").alias("id"), F.lit(0).alias("kind"), "end")
    probes = ids.select(*keys, "id").distinct().withColumn("kind", F.lit(1))
    line = scan(marks.unionByName(probes, allowMissingColumns=True), keys, ["id", "kind"], {"cover": ("max", F.col("end"))}, by_position("id"))
    covered = written(line.where((F.col("kind") == 1) & (F.col("cover") >= F.col("id"))).select(*keys, "id"), "covered")
    asked = requests.select(*keys, "req", F.col("start").alias("from"), F.col("end").alias("to"))
    return points_inside(covered, "id", asked, "from", "to", keys).select(*keys, "req", "id")

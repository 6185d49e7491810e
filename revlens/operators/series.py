"""Running totals, dense series, slot spines and the smoothed activity curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.functions import times
from revlens.model import LINE, ChangeLog
from revlens.operators.ranking import rank, spread_join
from revlens.operators.scan import by_day, by_position, range_scan, scan
from revlens.operators.totals import net_lines

# Points of the activity curve after the first, and the kernel's
# half width in grid steps.
GRID = 1000
HALF_WIDTH = 25


def loc_curve(daily: DataFrame) -> DataFrame:
    """Running total of net lines over the dates of a history line."""
    return scan(daily, LINE, ["date"], {"loc": ("sum", F.col("delta"))}, by_day()).select(*LINE, "date", "loc")


def running_total(totals: DataFrame) -> DataFrame:
    """Running total of net lines in log order."""
    return scan(totals, LINE, ["seq"], {"total": ("sum", net_lines())}, by_position())


def with_parent(revs: DataFrame) -> DataFrame:
    """Set ``parent_id`` to the preceding revision of the branch; the first has none."""
    before = ("max", F.struct("seq", "id"))
    paired = scan(revs.drop("parent_id"), LINE, ["seq"], {"before": before}, by_position(), exclusive=True)
    return paired.withColumn("parent_id", F.col("before.id")).drop("before")


def top_names(sizes: DataFrame, entity: str, metric: str, n: int) -> DataFrame:
    """One row per history line: its top entities by metric as an array of at most ``n``."""
    top = rank(sizes, LINE, metric, [entity], n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col(entity).alias("name"))))
    return top.groupBy(*LINE).agg(ordered.getField("name").alias("names"))


def member_columns(entity: str, value: Column, n: int) -> list[Column]:
    """``n`` columns: the value where the entity is the i-th of ``names``, else zero."""
    name = F.col(entity)
    return [
        F.when(F.get("names", F.lit(i)) == name, value).otherwise(F.lit(0).cast("long")).alias(f"__v{i}") for i in range(n)
    ]


#: Points of a range of the running totals: a window over one holds about as many, whatever the number of points.
RANGE = 1 << 20


def ranges_for(spark: SparkSession, points: int) -> int:
    """Ranges of the sort order for so many points, none much above RANGE of them; their borders are quantiles of a sample."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points // RANGE))


def member_sums(moves: DataFrame, names: DataFrame, entity: str, value: str, n: int, size: int) -> DataFrame:
    """One row per commit with the columns of ``member_columns``, summed over its rows; a row without an entity keeps its commit.

    The rows are dealt by commit, in parts of RANGE of the ``size`` commits at most, while they are narrow: no task
    holds the ``n`` sums of more commits, however many rows it has read.
    """
    spot = F.coalesce(F.array_position("names", F.col(entity)), F.lit(0)).cast("int")
    shown = F.col(entity).isNull() | (F.col("__spot") > 0)
    placed = with_names(moves, names).withColumn("__spot", spot).where(shown).select(*LINE, "date", "seq", "__spot", value)
    dealt = placed.repartition(ranges_for(moves.sparkSession, size), *LINE, "date", "seq")
    own = [F.when(F.col("__spot") == i + 1, F.col(value)).otherwise(F.lit(0).cast("long")) for i in range(n)]
    return dealt.groupBy(*LINE, "date", "seq").agg(*[F.sum(v).alias(f"__v{i}") for i, v in enumerate(own)])


def top_series(points: DataFrame, names: DataFrame, n: int, entity: str, metric: str, size: int | None = None) -> DataFrame:
    """Dense series of the top entities: every point of the line gets one row per entity. ``size``: how many points there are, if known.

    ``points`` has one row per commit with the columns of ``member_columns``. The
    running totals are taken over commit rows; ``names`` and the expansion to one row
    per entity come last and shuffle nothing.
    """
    cells = [f"__v{i}" for i in range(n)]
    ranges = None if size is None else ranges_for(points.sparkSession, size)
    totals = range_scan(points, LINE, ["date", "seq"], {c: ("sum", F.col(c)) for c in cells}, ranges=ranges)
    pairs = F.arrays_zip(F.col("names").alias("name"), F.slice(F.array(*cells), F.lit(1), F.size("names")).alias("value"))
    rows = with_names(totals, names).select(*LINE, "date", "seq", F.explode(pairs).alias("cell"))
    return rows.select(*LINE, "date", "seq", F.col("cell.name").alias(entity), F.col("cell.value").alias(metric))


def with_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    return spread_join(rows, names, LINE, ["seq"])


_STEPS = {"days": "interval 1 day", "weeks": "interval 7 days", "months": "interval 1 month", "years": "interval 1 year"}


def slot_spine(lines: DataFrame, start: int, as_of: int, resolution: str) -> DataFrame:
    """Every slot of every history line from ``start`` up to, not including, ``as_of``.

    ``start`` is itself the start of a slot.
    """
    first = times.to_date(F.lit(start).cast("long"))
    last = times.to_date(F.lit(as_of - 1).cast("long"))
    dates = F.sequence(first, last, F.expr(_STEPS[resolution]))
    rows = lines.where(F.lit(start) < F.lit(as_of)).select(*LINE, F.explode(dates).alias("day"))
    return rows.select(*LINE, times.to_epoch(F.col("day")).alias("slot"))


def fill_slots(counts: DataFrame, spine: DataFrame, values: list[str]) -> DataFrame:
    """Counts on every slot of the spine, zero where nothing happened."""
    filled = spine.join(counts, LINE + ["slot"], "left")
    return filled.withColumns({v: F.coalesce(v, F.lit(0)) for v in values})


def history_lines(log: ChangeLog) -> DataFrame:
    source = log.branches if log.branches is not None else log.revisions
    return source.select(*LINE).distinct()


def activity_cells(counts: DataFrame, extent: DataFrame) -> DataFrame:
    """Samples of each series summed per grid cell.

    ``part`` is the sum of n times the sample's offset in its cell, as a whole
    number (the cell is ``span`` wide), so that the kernel can be applied to cells
    exactly as to samples. A series has at most 1001 cells.
    """
    ranged = spread_join(counts, extent, LINE, ["series", "date"]).withColumn("span", F.col("last_date") - F.col("first_date"))
    scaled = (F.col("date") - F.col("first_date")) * GRID
    rows = ranged.withColumn("cell", F.when(F.col("span") > 0, F.floor(scaled / F.col("span")))).withColumn(
        "offset", scaled - F.col("cell") * F.col("span")
    )
    wide = "decimal(19,0)"
    return rows.groupBy(*LINE, "series", "first_date", "span", "cell").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast(wide) * F.col("offset").cast(wide)).alias("part"),
        F.count("*").alias("dates"),
    )


def smooth_cells(cells: DataFrame) -> DataFrame:
    """The curve: at each grid point x, sum of n * (1 - (t - x) / w) over x - w <= t < x + w.

    Grid point i lies at first_date + step * (i + 1) and sees cells i - 24 to i + 25.
    """
    axis = LINE + ["series", "first_date", "span"]
    reach = F.sequence(
        F.greatest(F.col("cell") - HALF_WIDTH, F.lit(0)), F.least(F.col("cell") + HALF_WIDTH - 1, F.lit(GRID))
    )
    seen = cells.where(F.col("cell").isNotNull()).select(*axis, "cell", "n", "part", F.explode(reach).alias("i"))
    weighted = seen.select(
        *axis, "i", (F.col("n") * (HALF_WIDTH + 1 + F.col("i") - F.col("cell"))).alias("whole"), "part"
    )
    grid = F.explode(F.sequence(F.lit(0), F.lit(GRID)).cast("array<bigint>"))
    zeros = cells.select(*axis).distinct().select(
        *axis, grid.alias("i"), F.lit(0).cast("long").alias("whole"), F.lit(0).cast(dict(cells.dtypes)["part"]).alias("part")
    )
    sums = weighted.unionByName(zeros).groupBy(*axis, "i").agg(F.sum("whole").alias("whole"), F.sum("part").alias("part"))
    step = F.col("span") / GRID
    fraction = F.when(F.col("span") > 0, F.col("part").cast("double") / F.col("span")).otherwise(F.lit(0.0))
    return sums.select(
        *LINE,
        "series",
        F.col("i").cast("int").alias("point"),
        (F.col("first_date") + step * (F.col("i") + 1)).alias("x"),
        ((F.col("whole") - fraction) / HALF_WIDTH).alias("y"),
    )

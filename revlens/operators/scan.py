"""Running sums and maxima that no single key can pin to one task.

A window partitioned by repository alone would put a third of the data into one
task as soon as one repository holds a third of it. Here the order axis of every
key is cut into blocks: block totals are aggregated map-side, their running value
is taken over the blocks, and it re-enters each block as one extra leading row.
Every window partition is then one block of one key, whatever the skew.

``scan`` cuts by a block expression with a known bound on the rows per block.
``range_scan`` needs none: it cuts by balanced ranges of the full sort order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.session import written

_ROW = "__is_row"
_PART = "__part"
# Blocks of log positions, and blocks of these blocks: however sparse the positions, a window partition holds
# 2 ** 20 rows, or 2 ** 24 block totals, at most.
_BLOCK_BITS = (40, 20)
_AGGREGATES = {"sum": F.sum, "max": F.max}

Levels = list[tuple[str, Column]]


def by_day(date: str = "date") -> Levels:
    """Blocks for rows that are unique per second: a block has 86,400 rows at most."""
    return [("__day", F.floor(F.col(date) / 86400))]


def by_position(seq: str = "seq") -> Levels:
    """Blocks for rows in log order."""
    return [(f"__run{bits}", F.shiftright(F.col(seq), bits)) for bits in _BLOCK_BITS]


def scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    levels: Levels | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running aggregates per key in the given order.

    ``values`` maps an output column to ("sum" | "max", expression); ``levels``
    are nested block columns, coarse to fine, each non-decreasing in ``order``.
    With ``exclusive`` a row sees only the rows before it: 0 for a sum and null
    for a maximum at the start.
    """
    levels = levels or []
    staged = rows.withColumns({**dict(levels), **{name: expr for name, (_, expr) in values.items()}})
    kinds = {name: kind for name, (kind, _) in values.items()}
    names = [name for name, _ in levels]
    return _scan(staged, keys, names, order, kinds, exclusive).drop(*names)


def range_scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    exclusive: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """``scan`` over any unique order, such as (date, seq), even if most rows share a date.

    The rows are range-partitioned by key and order, which balances them however
    they are distributed, and written once together with their partition number:
    as a stored value it stays the same in every later read or retry. ``ranges`` is
    their number, as many as shuffle partitions by default: a window cannot be split
    afterwards, so choose it for some hundred MB of rows each.
    """
    staged = rows.withColumns({name: expr for name, (_, expr) in values.items()})
    kinds = {name: kind for name, (kind, _) in values.items()}
    parts = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged.repartitionByRange(parts, *keys, *order).withColumn(_PART, F.spark_partition_id())
    return _scan(written(ranged, "ranges"), keys, [_PART], order, kinds, exclusive).drop(_PART)


def _running(kinds: dict[str, str], window, exclusive: bool) -> dict[str, Column]:
    out = {}
    for name, kind in kinds.items():
        running = _AGGREGATES[kind](name).over(window)
        out[name] = F.coalesce(running, F.lit(0)) if kind == "sum" and exclusive else running
    return out


def _scan(rows, keys, levels, order, kinds, exclusive):
    last = -1 if exclusive else Window.currentRow
    if not levels:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
        return rows.withColumns(_running(kinds, window, exclusive))
    block = keys + levels
    totals = rows.groupBy(*block).agg(*[_AGGREGATES[kind](name).alias(name) for name, kind in kinds.items()])
    carried = _scan(totals, keys, levels[:-1], levels[-1:], kinds, True)
    stream = rows.withColumn(_ROW, F.lit(True)).unionByName(
        carried.withColumn(_ROW, F.lit(False)), allowMissingColumns=True
    )
    window = Window.partitionBy(*block).orderBy(_ROW, *order).rowsBetween(Window.unboundedPreceding, last)
    return stream.withColumns(_running(kinds, window, exclusive)).where(_ROW).drop(_ROW)

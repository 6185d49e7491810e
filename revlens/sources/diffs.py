"""Unified diffs to per-file line and byte counts, as one distributed job.

A diff is read line by line with two counters: how many old and new lines the
current hunk still owes. Only when both are used up can a '--- ' or '+++ ' line be
a file header. Because the counters never rise inside a hunk, "used up" is the
same as "lines seen since the hunk header >= lines announced", which running
counts express without a sequential loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.model import REV, STAT_COLUMNS

# The line that separates files, the hunk header and the marker of
# the end of a piped diff (byte 0xFF).
SEPARATOR = "=" * 67
HUNK = r"^@@\s*((?!@@)[^\s,]+)(,\d*)?\S*\s+((?!@@)[^\s,]+)(,\d*)?"
END_MARK = "ÿ"


def _lines(raw: DataFrame) -> DataFrame:
    """One narrow row per line: its kind and length, and text only for header lines.

    Bytes are read as Latin-1, so that lengths count bytes and invalid UTF-8
    passes through unharmed.
    """
    content = F.decode(F.col("diff").cast("binary"), "ISO-8859-1")
    line = F.col("line")
    kind = (
        F.when(line.startswith("@@"), "hunk")
        .when(line.startswith("-"), "old")
        .when(line.startswith("+"), "new")
        .when(line == SEPARATOR, "reset")
        .when(line.startswith(END_MARK), "end")
        .otherwise("other")
    )
    looks_like_header = line.startswith("--- ") | line.startswith("+++ ")
    split = raw.select(*REV, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line"))
    return split.select(
        *REV,
        "pos",
        kind.alias("kind"),
        F.length("line").cast("long").alias("size"),
        F.when(looks_like_header | (kind == "hunk"), line).alias("text"),
        looks_like_header.alias("named"),
    )


def _announced(side: str) -> Column:
    """Lines a hunk header announces for '-' or '+', by the later of its first two ranges for that side.

    A missing length means one. Null: it says nothing about that side, as in the header of a combined diff, or
    the length is no number.
    """

    def length(group: int) -> Column:
        tail = F.regexp_extract("text", HUNK, group)
        return F.when(tail == "", F.lit(1).cast("long")).otherwise(F.substr(tail, F.lit(2)).try_cast("long"))

    def own(group: int) -> Column:
        removed = F.regexp_extract("text", HUNK, group).startswith("-")
        return removed if side == "-" else ~removed

    return F.when(own(3), length(4)).when(own(1), length(2))


def rejected(raw: DataFrame) -> DataFrame:
    """(repo, id, reason) of diffs with a hunk header that lacks two ranges."""
    content = F.decode(F.col("diff").cast("binary"), "ISO-8859-1")
    hunks = F.filter(F.split(content, "\n", -1), lambda line: line.startswith("@@"))
    bad = F.filter(hunks, lambda line: ~line.rlike(HUNK))
    found = raw.select(*REV, F.get(bad, F.lit(0)).alias("line")).where("line is not null")
    return found.select(*REV, F.concat(F.lit("bad hunk header: "), "line").alias("reason"))


def file_name(text: Column) -> Column:
    """File name of a header line; null for /dev/null."""
    name = F.substring_index(F.substr(text, F.lit(5)), "\t", 1)
    bare = F.when(
        (F.length(name) > 1) & name.startswith('"') & name.endswith('"'), F.substring(name, F.lit(2), F.length(name) - 2)
    ).otherwise(name)
    bare = F.when(bare.startswith("a/") | bare.startswith("b/"), F.substr(bare, F.lit(3))).otherwise(bare)
    return F.when(name != "/dev/null", bare)


def diffstat_from_diffs(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (repo, id, diff) to file_changes rows.

    ``diff`` is one string or binary cell per revision and (repo, id) is unique, so
    a window partition is never larger than the lines of one cell. All line-level
    windows share one shuffle of narrow rows. A hunk header without two ranges
    announces nothing (``rejected`` lists such diffs), or is an error if ``strict``.
    """
    lines = _lines(raw)
    order = Window.partitionBy(*REV).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    is_hunk = F.col("kind") == "hunk"
    well_formed = F.col("text").rlike(HUNK)
    if strict:
        bad = F.raise_error(F.concat(F.lit("bad hunk header: "), F.col("text"))).cast("long")
    else:
        bad = F.lit(None).cast("long")
    announced = {
        name: F.when(is_hunk, F.when(well_formed, _announced(side)).otherwise(bad)).otherwise(0)
        for name, side in (("old", "-"), ("new", "+"))
    }

    def seen(*kinds: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), 1).otherwise(0)).over(before), F.lit(0))

    counted = lines.select(
        "*",
        seen("old", "other").alias("old_seen"),
        seen("new", "other").alias("new_seen"),
        seen("end").alias("ends"),
    ).where((F.col("ends") == 0) & (F.col("kind") != "end"))
    # what remained to be seen when the current hunk began
    opens = F.col("kind").isin("hunk", "reset")
    due = {name: F.last(F.when(opens, F.col(f"{name}_seen") + announced[name]), ignorenulls=True).over(before) for name in ("old", "new")}
    marked = counted.withColumns({f"{name}_due": column for name, column in due.items()})
    idle = F.lit(True)
    for name in ("old", "new"):
        idle = idle & (F.col(f"{name}_due").isNull() | (F.col(f"{name}_seen") >= F.col(f"{name}_due")))
    headed = marked.withColumn("is_header", F.col("named") & idle)
    blocks = headed.select(
        *REV,
        F.sum(F.col("is_header").cast("int")).over(upto).alias("block"),
        "is_header",
        "kind",
        "size",
        F.when(F.col("is_header"), file_name(F.col("text"))).alias("name"),
    )
    body = ~F.col("is_header")

    def total(kind: str, what: Column) -> Column:
        return F.coalesce(F.sum(F.when(body & (F.col("kind") == kind), what)), F.lit(0))

    one = F.lit(1).cast("long")
    stats = blocks.groupBy(*REV, "block").agg(
        F.max("name").alias("name"),
        total("new", F.col("size")).alias("bytes_added"),
        total("new", one).alias("lines_added"),
        total("old", F.col("size")).alias("bytes_removed"),
        total("old", one).alias("lines_removed"),
    )
    # a name holds until a block with changed lines has used it
    some = F.col("lines_added") + F.col("lines_removed") > 0
    by_block = Window.partitionBy(*REV).orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = stats.withColumns(
        {
            "given": F.max(F.when(F.col("name").isNotNull(), F.struct("block", "name"))).over(so_far),
            "used": F.max(F.when(some, F.col("block"))).over(earlier),
        }
    )
    live = named.where(some & F.col("given").isNotNull() & (F.col("used").isNull() | (F.col("used") < F.col("given.block"))))
    path = F.decode(F.encode(F.col("given.name"), "ISO-8859-1"), "UTF-8")
    last = live.where(F.col("given.name") != "").withColumn("path", path).groupBy(*REV, "path")
    return last.agg(F.max_by(F.struct(*STAT_COLUMNS), "block").alias("stat")).select(*REV, "path", "stat.*")

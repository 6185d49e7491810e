"""Joins of revisions to file changes, and plain aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlens.functions import paths, text, times
from revlens.model import LINE, REV, STAT_COLUMNS, ChangeLog
from revlens.operators.ranking import ratio, sized_join
from revlens.operators.select import attributed, dated
from revlens.session import written

TOTALS = ["files"] + STAT_COLUMNS


def touches(revs: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per touched file of the given revisions."""
    return revs.join(changes, REV)


def revision_changes(revs: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per touched file; a revision without changes keeps one row of zeros.

    An outer join would tie all files of a revision to one task: adaptive execution
    splits a hot key only on sides whose rows need not be kept. Hence an inner join
    plus the revisions that have no match.
    """
    empty = revs.join(changes.select(*REV).distinct(), REV, "left_anti")
    zeros = {c: F.lit(0).cast("long") for c in STAT_COLUMNS}
    matched = touches(revs, changes)
    return matched.unionByName(empty.withColumns({"path": F.lit(None).cast("string"), **zeros}))


def change_totals(changes: DataFrame, more: list[Column] | None = None) -> DataFrame:
    """Touched files and summed counters per revision, with ``more`` aggregates from the same pass."""
    return changes.groupBy(*REV).agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in STAT_COLUMNS], *(more or []))


def revision_totals(revs: DataFrame, changes: DataFrame, some: bool = False) -> DataFrame:
    """Revisions with their totals. Changes are summed before they meet the revisions.

    ``some``: the revisions are a selection; changes of others are dropped before they are summed.
    """
    return with_change_totals(revs, change_totals(of_revisions(changes, revs) if some else changes))


def selected_totals(log: ChangeLog, revs: DataFrame, some: bool = True) -> DataFrame:
    """``revision_totals`` of revisions of a log; of a selection (``some``) only its own changes are read."""
    return with_change_totals(revs, change_totals(changes_of(log, revs) if some else log.need("file_changes")))


def of_revisions(changes: DataFrame, revs: DataFrame) -> DataFrame:
    """Changes of a selection of revisions, whose ids are stored first, so that a short list is broadcast."""
    return changes.join(written(revs.select(*REV).distinct(), "selected"), REV, "left_semi")


def change_month(date: Column) -> Column:
    """The folder a revision's changes lie in: the first second of its month, 0 without a date, -1 without a revision."""
    return F.coalesce(F.when(date == 0, F.lit(0).cast("long")).otherwise(times.time_slot(date, "months")), F.lit(-1).cast("long"))


def change_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*REV), F.lit(buckets)).cast("int")


def changes_of(log: ChangeLog, revs: DataFrame) -> DataFrame:
    """Changes of a selection of revisions (with their date); of a log stored by month and bucket only the folders these lie in are read."""
    if log.placed_changes is None:
        return of_revisions(log.need("file_changes"), revs)
    place = {"month": change_month(F.col("date")), "bucket": change_bucket(log.buckets)}
    selected = written(revs.select(*REV, "date").distinct().withColumns(place).drop("date"), "selected")
    folders = selected.agg(F.collect_set("month").alias("month"), F.collect_set("bucket").alias("bucket")).first()  # as many as months and buckets
    near = F.col("month").isin(folders["month"]) & F.col("bucket").isin(folders["bucket"])
    found = log.placed_changes.where(near if folders["month"] else F.lit(False)).join(selected.select(*REV).distinct(), REV, "left_semi")
    return found.select(log.need("file_changes").columns)


def with_change_totals(revs: DataFrame, sums: DataFrame) -> DataFrame:
    """Revisions with totals summed beforehand, zeros where there are none."""
    joined = revs.join(sums, REV, "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in TOTALS})


def file_totals(changes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Counters of the wanted (repo, id, path) rows, zeros where the file was not touched."""
    joined = wanted.join(changes, REV + ["path"], "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in STAT_COLUMNS})


def commits_by_author(revs: DataFrame) -> DataFrame:
    return attributed(revs).groupBy(*LINE, "author").agg(F.count("*").alias("commits"))


def lines_by_author(totals: DataFrame) -> DataFrame:
    """Lines added, not net."""
    return attributed(totals).groupBy(*LINE, "author").agg(F.sum("lines_added").alias("loc"))


def churn(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("lines_added") + F.col("lines_removed")).alias("churn"))


def net_lines():
    return F.col("lines_added") - F.col("lines_removed")


def net_by_date(totals: DataFrame) -> DataFrame:
    return dated(totals).groupBy(*LINE, "date").agg(F.sum(net_lines()).alias("delta"))


def directory():
    return paths.dirname(F.concat(F.lit("/"), F.col("path")))


def net_by_directory(touched: DataFrame) -> DataFrame:
    """Net lines of each file's own directory, not rolled up to its parents."""
    rows = touched.withColumn("directory", directory())
    return rows.groupBy(*LINE, "directory").agg(F.sum(net_lines()).alias("loc"))


# Names of the splits; their first letters stand for them.
SPLITS = ("none", "authors", "files", "directories")


def split_name(split: str) -> str:
    """Full name of a split, or of its first letter."""
    for name in SPLITS:
        if split in (name, name[0]):
            return name
    raise ValueError(f"unknown split {split!r}")


def activity_counts(log: ChangeLog, revs: DataFrame, split: str = "none", changes: bool = False, some: bool = False) -> DataFrame:
    """Commits, or changed lines, per (series, date). ``some``: the revisions are a selection of the log's."""
    split = split_name(split)
    rows = dated(revs)
    lines = F.col("lines_added") + F.col("lines_removed")
    if split in ("files", "directories"):
        rows = touches(rows, changes_of(log, rows) if some else log.need("file_changes"))
        series = F.col("path") if split == "files" else directory()
    else:
        rows = selected_totals(log, rows, some) if changes else rows
        series = F.lit("all") if split == "none" else F.col("author")
    return (
        rows.withColumn("series", series)
        .groupBy(*LINE, "series", "date")
        .agg(F.sum(lines if changes else F.lit(1).cast("long")).alias("n"))
    )


def files_by_language(tree: DataFrame) -> DataFrame:
    return tree.withColumn("language", paths.language(F.col("path"))).groupBy("repo", "language").agg(F.count("*").alias("n"))


def punchcard(revs: DataFrame) -> DataFrame:
    """Commits per weekday (0 = Sunday) and hour; size is half the share of the fullest cell."""
    cells = (
        dated(revs)
        .withColumns({"dow": times.weekday(F.col("date")), "hour": times.hour(F.col("date"))})
        .groupBy(*LINE, "dow", "hour")
        .agg(F.count("*").alias("n"))
    )
    # at most 7 x 24 rows per window partition
    fullest = F.max("n").over(Window.partitionBy(*LINE))
    return cells.withColumn("size", ratio(F.col("n"), 2 * fullest))


def slot_counts(totals: DataFrame, resolution: str) -> DataFrame:
    slots = totals.withColumn("slot", times.time_slot(F.col("date"), resolution))
    return slots.groupBy(*LINE, "slot").agg(F.count("*").alias("commits"), F.sum("files").alias("changes"))


def in_slots(revs: DataFrame, slots: list[tuple[str, int | None]]) -> DataFrame:
    """One row per revision and open-ended slot (caption, first second) it belongs to.

    The few slots travel as literals inside the row expression: no join is needed.
    """
    captions = [
        F.when(F.lit(True) if first is None else F.col("date") >= first, F.lit(caption)) for caption, first in slots
    ]
    return revs.withColumn("slot", F.explode(F.array_compact(F.array(*captions))))


def participation(rows: DataFrame, author: str, resolution: str, changes: bool = False) -> DataFrame:
    """One author against all others per slot: commits, or lines added."""
    n = F.col("lines_added") if changes else F.lit(1).cast("long")
    own = F.col("author") == author
    return (
        rows.withColumn("slot", times.time_slot(F.col("date"), resolution))
        .groupBy(*LINE, "slot")
        .agg(
            F.sum(F.when(own, n).otherwise(0)).alias("own"),
            F.sum(F.when(own, 0).otherwise(n)).alias("others"),
        )
    )


def date_extent(revs: DataFrame) -> DataFrame:
    return dated(revs).groupBy(*LINE).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def first_revision(revs: DataFrame) -> DataFrame:
    """First revision of each repository in log order, and its date."""
    return revs.groupBy("repo").agg(F.min_by("id", "seq").alias("id"), F.min_by("date", "seq").alias("born"))


def end_revisions(revs: DataFrame) -> DataFrame:
    """Oldest and newest revision of each history line."""
    return revs.groupBy(*LINE).agg(F.min_by("id", "seq").alias("oldest"), F.max_by("id", "seq").alias("newest"))


def messages_by_author(revs: DataFrame) -> DataFrame:
    """Messages in log order per author, with the author's commit count.

    One row per message: an author's list can be a third of the log, so it is
    never gathered into one cell or task.
    """
    rows = attributed(revs).select(*LINE, "author", "seq", "message")
    return sized_join(rows, commits_by_author(revs), LINE + ["author"])


def layout_stats(changes: DataFrame) -> DataFrame:
    """Longest path and largest change per revision, with the revision's totals."""
    return changes.groupBy(*REV).agg(
        F.max(F.length("path")).alias("max_len"),
        F.max(F.col("lines_added") + F.col("lines_removed")).alias("max_change"),
        F.count("*").alias("files"),
        F.sum("lines_added").alias("added"),
        F.sum("lines_removed").alias("removed"),
    )


def summary_lines(totals: DataFrame) -> DataFrame:
    line = text.summary_line(F.col("files"), F.col("lines_added"), F.col("lines_removed"))
    return totals.select(*LINE, "id", line.alias("summary"))

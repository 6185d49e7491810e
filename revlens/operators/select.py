"""Selections over a change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.model import LINE, UNKNOWN_AUTHOR, UNKNOWN_DATE, ChangeLog

# Passed as ``branch`` to select each repository's default branch.
DEFAULT_BRANCH = "@default"


def on_branch(df: DataFrame, log: ChangeLog, branch: str | None) -> DataFrame:
    """Rows of one branch name, of the default branches, or (None) of all branches."""
    if branch is None:
        return df
    if branch == DEFAULT_BRANCH:
        chosen = log.need("branches").where("is_default").select(*LINE)
        return df.join(chosen, LINE, "left_semi")
    return df.where(F.col("branch") == branch)


def revisions(
    log: ChangeLog,
    branch: str | None = None,
    start: int | None = None,
    stop: int | None = None,
    in_order: bool = False,
) -> DataFrame:
    """Revisions of a branch within [start, stop], both bounds inclusive and optional."""
    rows = on_branch(log.revisions, log, branch)
    if start is not None:
        rows = rows.where(F.col("date") >= start)
    if stop is not None:
        rows = rows.where(F.col("date") <= stop)
    return rows.orderBy(*LINE, "seq") if in_order else rows


def revision(log: ChangeLog, id: str) -> DataFrame:
    return log.revisions.where(F.col("id") == id)


def filter_prefix(changes: DataFrame, prefix: str) -> DataFrame:
    """File changes whose path starts with the prefix, directory boundary or not."""
    return changes.where(F.col("path").startswith(prefix))


def by_author(revs: DataFrame, author: str) -> DataFrame:
    return revs.where(F.col("author") == author)


def dated(revs: DataFrame) -> DataFrame:
    return revs.where(F.col("date") != UNKNOWN_DATE)


def attributed(revs: DataFrame) -> DataFrame:
    return revs.where(F.col("author") != UNKNOWN_AUTHOR)


def filter_tags(tags: DataFrame, pattern: str | None = None) -> DataFrame:
    """Tags whose name contains a match of the regular expression; None keeps all."""
    return tags if pattern is None else tags.where(F.col("name").rlike(pattern))


def clip_after(df: DataFrame, datemin: int | None) -> DataFrame:
    """Show rows from a date on. Applied above a running total, it does not change the totals."""
    return df if datemin is None else df.where(F.col("date") >= datemin)

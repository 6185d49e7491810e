"""Raw commit metadata to revision columns, as plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text, times


def _checked(staged: DataFrame, ok: Column, what: str, strict: bool) -> DataFrame:
    """Rows that can be read; with ``strict`` any other is an error."""
    fine = F.coalesce(ok, F.lit(False))
    return staged.where(F.when(fine, True).otherwise(F.raise_error(F.lit(f"unable to parse {what}")).cast("boolean")) if strict else fine)


def _git_lines(raw: DataFrame) -> DataFrame:
    # The keywords of a raw commit header.
    lines = F.split("header", "\n", -1)
    spot = F.array_position(F.transform(lines, lambda line: line.startswith("author ")), True).cast("int")
    staged = raw.withColumn("lines", lines).withColumn("spot", spot)
    return staged.withColumn("stamp", F.get("lines", F.col("spot")))


def _git_readable() -> Column:
    return (F.col("spot") > 0) & F.col("stamp").startswith("committer ") & F.col("stamp").rlike(STAMP)


def rejected_git(raw: DataFrame) -> DataFrame:
    """(repo, id, reason) of headers that ``parse_git_headers`` leaves out."""
    bad = _git_lines(raw).where(~F.coalesce(_git_readable(), F.lit(False)))
    reason = F.when(F.coalesce("spot", F.lit(0)) == 0, "no author line").otherwise(F.concat(F.lit("bad commit date: "), F.coalesce("stamp", F.lit(""))))
    return bad.select("repo", "id", reason.alias("reason"))


#: Epoch and offset at the end of the committer line.
STAMP = r" (-?\d{1,18}) ([+-])(\d\d)(\d\d)$"


def parse_git_headers(raw: DataFrame, local_time: bool = True, strict: bool = False) -> DataFrame:
    """Rows (repo, id, header) to (repo, id, author, date, message).

    Headers that cannot be read are left out and listed by ``rejected_git``, or are an error if ``strict``.
    ``local_time`` shifts the commit time by its offset, which makes the epoch
    read as the committer's wall clock. The message keeps a line break after each
    of its lines.
    """
    staged = _checked(_git_lines(raw), _git_readable(), "commit header", strict)
    author_line = F.get("lines", F.col("spot") - 1)

    def part(group: int) -> Column:
        return F.regexp_extract("stamp", STAMP, group)

    sign = F.when(part(2) == "-", -1).otherwise(1).cast("long")
    utc = part(1).cast("long")
    date = times.local_epoch(utc, sign, part(3).cast("long"), part(4).cast("long")) if local_time else utc
    body = F.slice("lines", F.col("spot") + 2, F.greatest(F.size("lines") - F.col("spot") - 1, F.lit(0)))
    kept = F.transform(
        F.filter(body, lambda line: line != ""), lambda line: F.concat(F.substr(line, F.lit(5)), F.when(line.startswith("\0"), "").otherwise("\n"))
    )
    return staged.select(
        "repo",
        "id",
        text.clean_author(F.substr(author_line, F.lit(8))).alias("author"),
        date.alias("date"),
        F.array_join(kept, "").alias("message"),
    )


def parse_hg_log(raw: DataFrame) -> DataFrame:
    """Rows (repo, id, header) of 'epoch offset', author, message lines.

    The offset counts seconds west of UTC, so the wall clock is epoch - offset.
    """
    lines = F.split("header", "\n", 3)
    clock = F.split(F.get(lines, F.lit(0)), " ")
    whole = F.size(clock) > 1
    date = F.get(clock, F.lit(0)).try_cast("long") - F.get(clock, F.lit(1)).try_cast("long")
    return raw.select(
        "repo",
        "id",
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("author"),
        F.coalesce(F.when(whole, date), F.lit(0)).cast("long").alias("date"),
        F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("message"),
    )


def _svn_date() -> tuple[Column, Column]:
    given = F.try_element_at("props", F.lit("svn:date"))
    date = F.unix_seconds(F.try_to_timestamp(given))
    return date, given.isNull() | date.isNotNull()


def rejected_svn(raw: DataFrame) -> DataFrame:
    """(repo, id, reason) of properties that ``parse_svn_props`` leaves out."""
    reason = F.concat(F.lit("bad date: "), F.try_element_at("props", F.lit("svn:date")))
    return raw.where(~_svn_date()[1]).select("repo", "id", reason.alias("reason"))


def parse_svn_props(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (repo, id, props map) to revision columns; a missing property is '' or date 0.

    Revisions whose date cannot be read are left out and listed by ``rejected_svn``, or are an error if ``strict``.
    """
    date, readable = _svn_date()
    return _checked(raw, readable, "date", strict).select(
        "repo",
        "id",
        F.coalesce(F.try_element_at("props", F.lit("svn:author")), F.lit("")).alias("author"),
        F.coalesce(date, F.lit(0)).cast("long").alias("date"),
        F.coalesce(F.try_element_at("props", F.lit("svn:log")), F.lit("")).alias("message"),
    )

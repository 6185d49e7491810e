"""Line dumps of a change log and long-format series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions import text
from revlens.model import LINE, REV, ChangeLog
from revlens.operators import select as sel
from revlens.operators.series import running_total
from revlens.operators.totals import change_totals, changes_of, net_lines, with_change_totals
from revlens.session import written

# Column codes, their short forms and their titles.
COLUMN_CODES = {
    "id": ("id", "Commit ID"),
    "author": ("a", "Author"),
    "added": ("+", "Lines added"),
    "removed": ("-", "Lines removed"),
    "delta": ("d", "Line delta"),
    "total": ("t", "Total lines"),
    "files": ("f", "Changed Files"),
    "message": ("m", "Message"),
}
DEFAULT_COLUMNS = "a,d,t"


def parse_codes(columns: str) -> list[str]:
    """Full names of a comma-separated list of column codes."""
    short = {abbreviation: name for name, (abbreviation, _) in COLUMN_CODES.items()}
    names = [short.get(code, code) for code in columns.split(",")]
    for name in names:
        if name not in COLUMN_CODES:
            raise ValueError(f"unknown column code: {name}")
    return names


def dump_header(columns: str = DEFAULT_COLUMNS) -> str:
    return ", ".join(["# Timestamp"] + [COLUMN_CODES[name][1] for name in parse_codes(columns)])


def select_columns(
    log: ChangeLog,
    columns: str = DEFAULT_COLUMNS,
    branch: str | None = None,
    datemin: int | None = None,
    datemax: int | None = None,
) -> DataFrame:
    """repo, branch, seq, date and the coded columns, in log order.

    Only what the codes ask for is joined or scanned. A running total counts from
    the beginning of history, whatever ``datemin`` is.
    """
    names = parse_codes(columns)
    counting = "total" in names
    rows = sel.revisions(log, branch, None if counting else datemin, datemax)
    if {"added", "removed", "delta", "total", "files"} & set(names):
        changes, selected = log.need("file_changes"), bool(branch or datemax or (datemin and not counting))
        # one pass for counters and paths; the format has all paths of a revision in one field
        paths = [F.array_sort(F.collect_list("path")).alias("paths")] if "files" in names else []
        sums = change_totals(changes_of(log, rows) if selected else changes, paths)
        rows = with_change_totals(rows, sums)
    if counting:
        rows = running_total(written(rows, "dump-rows"))
    rows = sel.clip_after(rows, datemin)
    values = {
        "id": F.col("id"),
        "author": F.col("author"),
        "added": F.col("lines_added"),
        "removed": F.col("lines_removed"),
        "delta": net_lines(),
        "total": F.col("total"),
        "files": F.coalesce("paths", F.array().cast("array<string>")),
        "message": F.col("message"),
    }
    return rows.select(*LINE, "seq", "date", *[values[name].alias("c_" + name) for name in names])


_TEXT = ("id", "author", "message")


def _lines(rows: DataFrame, fields: list[Column]) -> DataFrame:
    return rows.select(*LINE, "seq", F.concat_ws(",", F.col("date").cast("string"), *fields).alias("line"))


def dump_csv_legacy(log: ChangeLog, columns: str = DEFAULT_COLUMNS, **span) -> DataFrame:
    """Unquoted fields; only messages are escaped and quoted."""

    def field(name: str) -> Column:
        value = F.col("c_" + name)
        if name == "message":
            return text.escape_legacy_csv(value)
        return F.array_join(value, ":") if name == "files" else value.cast("string")

    return _lines(select_columns(log, columns, **span), [field(n) for n in parse_codes(columns)])


def dump_csv(log: ChangeLog, columns: str = DEFAULT_COLUMNS, **span) -> DataFrame:
    """Every string field escaped and quoted."""

    def field(name: str) -> Column:
        value = F.col("c_" + name)
        if name == "files":
            return text.quote_csv(F.array_join(value, ":"))
        return text.quote_csv(value) if name in _TEXT else value.cast("string")

    return _lines(select_columns(log, columns, **span), [field(n) for n in parse_codes(columns)])


def dump_json(log: ChangeLog, columns: str = DEFAULT_COLUMNS, **span) -> DataFrame:
    """One JSON array per revision; file lists are nested arrays."""

    def field(name: str) -> Column:
        value = F.col("c_" + name)
        if name == "files":
            quoted = F.array_join(F.transform(value, text.quote_json), ",")
            return F.concat(F.lit("["), quoted, F.lit("]"))
        return text.quote_json(value) if name in _TEXT else value.cast("string")

    lines = _lines(select_columns(log, columns, **span), [field(n) for n in parse_codes(columns)])
    return lines.withColumn("line", F.concat(F.lit("["), F.col("line"), F.lit("]")))


def revision_dump(log: ChangeLog, branch: str | None = None, id: str | None = None) -> DataFrame:
    """Text dump of revisions, one row per block: head (section 0), each file (1), rule (2).

    Sorted by (seq, section, path) the lines are the dump. A revision may touch any
    number of files, so they stay rows and are never gathered.
    """
    rows = sel.on_branch(log.revisions, log, branch)
    if id is not None:
        rows = rows.where(F.col("id") == id)
    # The headings of the dump.
    head = F.concat_ws(
        "\n", F.lit("-- Revision"), "id", F.lit("-- Date"), F.col("date").cast("string"), F.lit("-- Author"), "author",
        F.lit("-- Message "), "message", F.lit("-- Diffstat"),
    )
    frame = rows.select(
        *LINE, "id", "seq",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("section"), F.lit("").alias("path"), head.alias("line")),
                F.struct(F.lit(2).alias("section"), F.lit("").alias("path"), F.lit("=" * 66).alias("line")),
            )
        ).alias("b"),
    ).select(*LINE, "id", "seq", "b.*")
    counters = [("lines_added", " +"), ("lines_removed", " -"), ("bytes_added", " +"), ("bytes_removed", " -")]
    line = F.concat(F.col("path"), *[x for c, sign in counters for x in (F.lit(sign), F.col(c).cast("string"))])
    changes = log.need("file_changes") if id is None and branch is None else changes_of(log, rows)
    files = rows.select(*LINE, *[c for c in REV if c not in LINE], "seq").join(changes, REV)
    return frame.unionByName(files.select(*LINE, "id", "seq", F.lit(1).alias("section"), "path", line.alias("line")))


def write_lines(lines: DataFrame, path: str, order: list[str]) -> None:
    """Write the ``line`` column as text files whose name order is the dump's order."""
    lines.orderBy(*order).select("line").write.mode("errorifexists").text(path)


def write_dump(lines: DataFrame, path: str, columns: str = DEFAULT_COLUMNS) -> None:
    """Write a CSV dump in log order behind its header line."""
    header = lines.sparkSession.createDataFrame([("", "", -1, dump_header(columns))], "repo string, branch string, seq bigint, line string")
    write_lines(lines.unionByName(header), path, [*LINE, "seq"])


def to_series(df: DataFrame, x: str, values: list[str], keys: list[str] | None = None) -> DataFrame:
    """Wide result to long form: keys, series, x, y."""
    keys = keys or []
    numbers = df.select(*keys, F.col(x).cast("double").alias("x"), *[F.col(v).cast("double").alias(v) for v in values])
    return numbers.unpivot([*keys, "x"], values, "series", "y").select(*keys, "series", "x", "y")

"""Unified diffs of any size, cut into pieces anywhere, also inside a line or a character.

A piece is read once, by itself, into a summary of what it does from any state the parser may enter it in. Whether a
line that looks like a file header is one depends on the lines the current hunk still owes. After a hunk header that
is known; before the first one of a piece it depends on what the pieces before leave open, so such a line stays a
candidate with the number of old and new lines before it. Summaries are folded by running sums and maxima over
(repo, id, piece); candidates then resolve, and sums between them add up to files.

Lines that cross a border are put together first and count as small pieces of their own. So no task holds more than
a piece, whatever the size of a diff, and only summaries are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.model import REV, STAT_COLUMNS
from revlens.operators.scan import by_position, scan
from revlens.session import importable, written
from revlens.sources.diffs import HUNK, SEPARATOR, file_name

#: Bytes kept of a line that crosses a border: more than any file name or hunk header has.
KEPT = 1 << 16
FREE = np.iinfo(np.int64).max
_HUNK = re.compile(HUNK.encode())
_SEPARATOR = SEPARATOR.encode()
_PART = [("free", pa.bool_()), ("old", pa.int64()), ("new", pa.int64()), ("text", pa.binary()), ("removes", pa.bool_()), ("size", pa.int64())]
_PART += [(c, pa.int64()) for c in STAT_COLUMNS]
#: ended: the mark of the end was met. old, new: lines seen. due_old, due_new: lines seen by the time the last hunk is
#: used up, null without a hunk. parts: sums before the first candidate, then each candidate with the sums after it.
_SUMMARY = [("ended", pa.bool_()), ("old", pa.int64()), ("new", pa.int64()), ("due_old", pa.int64()), ("due_new", pa.int64()), ("bad", pa.binary()), ("parts", pa.list_(pa.struct(_PART)))]
_PART_DDL = ", ".join(f"{n}: {'boolean' if t == pa.bool_() else 'binary' if t == pa.binary() else 'long'}" for n, t in _PART)
_SUMMARY_DDL = f"ended boolean, old long, new long, due_old long, due_new long, bad binary, parts array<struct<{_PART_DDL}>>"


def announced(line: bytes) -> tuple[int | None, int | None] | None:
    """Old and new lines a hunk header announces, each None if it says nothing about them; None for no hunk header."""
    found = _HUNK.match(line)
    if not found:
        return None
    out: list[int | None] = [None, None]
    for sign, length in ((found[1], found[2]), (found[3], found[4])):
        digits = length[1:] if length else b"1"
        out[not sign.startswith(b"-")] = int(digits) if digits and int(digits) <= FREE else None
    return out[0], out[1]


def summary(data: bytes, more: int = 0) -> dict:
    """Summary of whole lines; the last one has ``more`` further bytes that were not kept."""
    return _of_line(data, more) if b"\n" not in data else _of_lines(data, more)


def _stated(*values) -> dict:
    *others, parts = values
    names = [name for name, _ in _PART]
    return dict(zip([name for name, _ in _SUMMARY], (*others, [dict(zip(names, p, strict=True)) for p in parts]), strict=True))


def _of_line(line: bytes, more: int = 0) -> dict:
    """``_of_lines`` of a single line: nothing is owed before it."""
    size, first = len(line) + more, line[:1]
    before = (True, 0, 0, None, False, 0)
    if first == b"\xff":
        return _stated(True, 0, 0, None, None, None, [(*before, 0, 0, 0, 0)])
    hunk, reset = line[:2] == b"@@", size == len(_SEPARATOR) and line == _SEPARATOR
    removed, added = first == b"-", first == b"+"
    other = not (hunk or reset or removed or added)
    owed = (0, 0) if reset else announced(line) if hunk else (None, None)
    bad, last = (line, (None, None)) if owed is None else (None, owed)
    seen = (int(removed or other), int(added or other))
    if line[:4] in (b"--- ", b"+++ "):
        return _stated(False, *seen, *last, bad, [(*before, 0, 0, 0, 0), (False, 0, 0, line, removed, size, 0, 0, 0, 0)])
    return _stated(False, *seen, *last, bad, [(*before, size if added else 0, int(added), size if removed else 0, int(removed))])


def _of_lines(data: bytes, more: int = 0) -> dict:
    raw = np.frombuffer(data + b"\0\0\0\0", "u1")
    ends = np.flatnonzero(raw[:-4] == 10)
    starts = np.concatenate([[0], ends + 1])
    sizes = np.concatenate([ends, [len(data)]]) - starts
    sizes[-1] += more
    at = [np.where(sizes > i, raw[starts + np.minimum(i, np.maximum(sizes, 0))], 0) for i in range(4)]
    over = np.flatnonzero(at[0] == 0xFF)
    n = over[0] if len(over) else len(starts)
    starts, sizes, at = starts[:n], sizes[:n], [x[:n] for x in at]

    def line(i: int) -> bytes:
        return data[starts[i] : starts[i] + sizes[i]]

    hunk = (at[0] == ord("@")) & (at[1] == ord("@"))
    reset = (at[0] == ord("=")) & (sizes == len(_SEPARATOR))
    reset[reset] = [line(i) == _SEPARATOR for i in np.flatnonzero(reset)]
    removed, added = at[0] == ord("-"), at[0] == ord("+")
    other = ~(hunk | reset | removed | added)
    seen = [np.cumsum(kind | other) - (kind | other) for kind in (removed, added)]
    due = [np.zeros(n, np.int64) for _ in range(2)]
    known = [np.zeros(n, bool) for _ in range(2)]
    last: list[int | None] = [None, None]
    bad = None
    opens = np.flatnonzero(hunk | reset)
    for i, to in zip(opens, [*opens, n][1:], strict=True):
        owed = (0, 0) if reset[i] else announced(line(i))
        if owed is None:
            bad = bad or line(i)
        for side in range(2):
            if owed and owed[side] is not None:
                last[side] = int(seen[side][i]) + owed[side]
            if last[side] is not None:
                due[side][i + 1 : to + 1], known[side][i + 1 : to + 1] = last[side], True
    named = ((removed & (at[1] == ord("-")) & (at[2] == ord("-"))) | (added & (at[1] == ord("+")) & (at[2] == ord("+")))) & (at[3] == ord(" "))
    for side in range(2):
        named &= ~known[side] | (seen[side] >= due[side])
    heads = np.flatnonzero(named)
    body = ~named
    part = np.cumsum(named)
    sums = [np.bincount(part[kind & body], what[kind & body], len(heads) + 1).astype(np.int64) for kind in (added, removed) for what in (sizes, np.ones(n))]
    need = [np.where(known[side], FREE, seen[side]) for side in range(2)]
    free = known[0] & known[1]
    parts = [(True, 0, 0, None, False, 0, *(int(s[0]) for s in sums))]
    parts += [(bool(free[i]), int(need[0][i]), int(need[1][i]), line(i), bool(removed[i]), int(sizes[i]), *(int(s[k]) for s in sums)) for k, i in enumerate(heads, 1)]
    totals = [int((kind | other).sum()) for kind in (removed, added)]
    return _stated(len(over) > 0, *totals, *last, bad, parts)


def _with(columns: list[tuple[str, pa.DataType]], rows: list[dict]) -> pa.RecordBatch:
    """A batch of rows, their parts column by column: far cheaper than as nested rows."""
    given = [*columns, *_SUMMARY[:-1]]
    ends, flat = [0], []
    for row in rows:
        flat += row["parts"] or []
        ends.append(len(flat))
    fields = [pa.array([p[name] for p in flat], kind) for name, kind in _PART]
    starts = [None if row["parts"] is None else at for row, at in zip(rows, ends, strict=False)]
    parts = pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.StructArray.from_arrays(fields, fields=[pa.field(*f) for f in _PART]))
    return pa.RecordBatch.from_arrays([*(pa.array([row[name] for row in rows], kind) for name, kind in given), parts], schema=pa.schema([*columns, *_SUMMARY]))


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece: its ends up to the first and from the last line break, and the summary of the lines between."""
    columns = [("repo", pa.string()), ("id", pa.string()), ("piece", pa.int64()), ("breaks", pa.bool_()), ("first", pa.binary()), ("first_size", pa.int64()), ("last", pa.binary()), ("last_size", pa.int64())]
    for batch in batches:
        rows = []
        ids = zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)
        for (repo, id_, piece), cell in zip(ids, batch.column(3), strict=True):
            data = cell.as_py() or b""
            a, b = data.find(b"\n"), data.rfind(b"\n")
            first, last = (data, b"") if a < 0 else (data[:a], data[b + 1 :])
            row = {"repo": repo, "id": id_, "piece": piece, "breaks": a >= 0, "first": first[:KEPT], "first_size": len(first), "last": last[:KEPT], "last_size": len(last)}
            rows.append(row | (summary(data[a + 1 : b]) if a < b else dict.fromkeys(name for name, _ in _SUMMARY)))
        yield _with(columns, rows)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [("repo", pa.string()), ("id", pa.string()), ("pos", pa.int64())]
    for batch in batches:
        rows = []
        for repo, id_, pos, text, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append({"repo": repo, "id": id_, "pos": pos, **summary(text, size - len(text))})
        yield _with(columns, rows)


def read_pieces(pieces: DataFrame) -> DataFrame:
    """What is kept of each piece: its fragments of lines and the summary of its whole lines. Rows of several calls add up."""
    importable(pieces.sparkSession)
    typed = pieces.select("repo", "id", F.col("piece").cast("long"), F.col("diff").cast("binary"))
    return typed.mapInArrow(_inside, "repo string, id string, piece long, breaks boolean, first binary, first_size long, last binary, last_size long, " + _SUMMARY_DDL)


def summaries(own: DataFrame) -> DataFrame:
    """(repo, id, pos, summary) of ``read_pieces``' rows: pieces at even positions, the line that crosses into the next piece at the odd one after."""
    importable(own.sparkSession)
    # a piece's first fragment ends the line that the latest earlier piece with a line break has begun
    starts = {"start": ("max", F.when(F.col("breaks"), F.col("piece")))}
    narrow = own.select(*REV, "piece", "breaks", "first", "first_size")
    firsts = scan(narrow, REV, ["piece"], starts, by_position("piece"), exclusive=True)
    fragments = firsts.select(*REV, F.coalesce(2 * F.col("start") + 1, F.lit(-1).cast("long")).alias("pos"), F.col("piece").alias("at"), F.col("first").alias("text"), F.col("first_size").alias("size"))
    begun = own.where("breaks").select(*REV, (2 * F.col("piece") + 1).alias("pos"), F.col("piece").alias("at"), F.col("last").alias("text"), F.col("last_size").alias("size"))
    lines = fragments.unionByName(begun).groupBy(*REV, "pos").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts"), F.sum("size").alias("size"))
    text = F.aggregate("texts", F.lit(b""), lambda whole, x: F.substring(F.concat(whole, x["text"]), 1, KEPT))
    crossing = lines.select(*REV, "pos", text.alias("text"), "size").mapInArrow(_crossing, "repo string, id string, pos long, " + _SUMMARY_DDL)
    inside = own.where("parts is not null").select(*REV, (2 * F.col("piece")).alias("pos"), *[name for name, _ in _SUMMARY])
    return inside.unionByName(crossing)


def diffstat_from_pieces(pieces: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (repo, id, piece, diff) to file_changes rows, as ``diffstat_from_diffs`` gives for whole diffs.

    ``piece`` numbers the pieces of a diff in their order, from 0, gaps allowed; (repo, id, piece) is unique. Pieces
    may be cut anywhere; some MB each are a good size. A hunk header without two ranges announces nothing, or is an
    error if ``strict``. Of a line that crosses a border the first 64 KB are looked at. An empty table gives no rows.
    """
    return folded(written(read_pieces(pieces), "pieces"), strict)


def folded(read: DataFrame, strict: bool = False) -> DataFrame:
    """file_changes rows from the stored rows of ``read_pieces``."""
    own = written(summaries(read), "summaries")
    if strict:
        bad = F.raise_error(F.concat(F.lit("bad hunk header: "), F.decode("bad", "ISO-8859-1")))
        own = own.withColumn("ended", F.when(F.col("bad").isNotNull(), bad.cast("boolean")).otherwise(F.col("ended")))
    levels = by_position("pos")
    seen = scan(own, REV, ["pos"], {"old_before": ("sum", F.col("old")), "new_before": ("sum", F.col("new")), "over": ("max", F.col("ended").cast("int"))}, levels, exclusive=True)
    due = {side: F.when(F.col(f"due_{side}").isNotNull(), F.struct("pos", (F.col(f"{side}_before") + F.col(f"due_{side}")).alias("due"))) for side in ("old", "new")}
    owed = scan(seen.where("coalesce(over, 0) = 0"), REV, ["pos"], {f"{side}_due": ("max", column) for side, column in due.items()}, levels, exclusive=True)
    left = {side: F.coalesce(F.col(f"{side}_due.due") - F.col(f"{side}_before"), F.lit(0)) for side in ("old", "new")}
    stated = owed.select(*REV, "pos", "parts", left["old"].alias("left_old"), left["new"].alias("left_new"))

    def heads(part):
        return part["text"].isNotNull() & (part["free"] | ((part["old"] >= F.col("left_old")) & (part["new"] >= F.col("left_new"))))

    counted = stated.withColumn("heads", F.size(F.filter("parts", heads)).cast("long"))
    numbered = scan(counted, REV, ["pos"], {"block": ("sum", F.col("heads"))}, levels, exclusive=True)
    parts = numbered.select(*REV, "pos", "block", "left_old", "left_new", F.posexplode("parts").alias("k", "part"))
    parts = parts.select(*REV, "pos", "k", "block", heads(F.col("part")).alias("head"), "part.*")
    order = Window.partitionBy(*REV, "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("block", F.col("block") + F.sum(F.col("head").cast("long")).over(order))
    # a candidate that is no header is a changed line of the block before it
    line = F.col("text").isNotNull() & ~F.col("head")

    def total(name: str, removes: bool, own: str):
        more = F.when(line & (F.col("removes") == removes), F.col("size") if own == "size" else F.lit(1).cast("long")).otherwise(0)
        return F.sum(F.col(name) + more).alias(name)

    name = F.when(F.col("head"), file_name(F.decode("text", "ISO-8859-1")))
    blocks = parts.withColumn("name", name).groupBy(*REV, "block").agg(
        F.max("name").alias("name"), total("bytes_added", False, "size"), total("lines_added", False, "one"), total("bytes_removed", True, "size"), total("lines_removed", True, "one"),
    )
    # a name holds until a block with changed lines has used it
    some = F.col("lines_added") + F.col("lines_removed") > 0
    marks = {"given": ("max", F.when(F.col("name").isNotNull(), F.struct("block", "name"))), "this": ("max", F.when(some, F.col("block")))}
    blocks = written(blocks, "blocks")
    given = scan(blocks, REV, ["block"], {"given": marks["given"]}, by_position("block"))
    used = scan(given, REV, ["block"], {"used": marks["this"]}, by_position("block"), exclusive=True)
    live = used.where(some & F.col("given").isNotNull() & (F.col("used").isNull() | (F.col("used") < F.col("given.block"))))
    path = F.decode(F.encode(F.col("given.name"), "ISO-8859-1"), "UTF-8")
    last = live.where(F.col("given.name") != "").withColumn("path", path).groupBy(*REV, "path")
    return last.agg(F.max_by(F.struct(*STAT_COLUMNS), "block").alias("stat")).select(*REV, "path", "stat.*")


def rejected_pieces(pieces: DataFrame) -> DataFrame:
    """(repo, id, reason) of diffs with a hunk header that lacks two ranges: the first one of each."""
    bad = summaries(written(read_pieces(pieces), "pieces")).where("bad is not null").groupBy(*REV).agg(F.min_by("bad", "pos").alias("bad"))
    return bad.select(*REV, F.concat(F.lit("bad hunk header: "), F.decode("bad", "ISO-8859-1")).alias("reason"))


def cut(raw: DataFrame, size: int, keep: list[str] | None = None) -> DataFrame:
    """Whole diffs (repo, id, diff) as pieces of ``size`` bytes. ``keep`` names further columns."""
    data = F.col("diff").cast("binary")
    numbers = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(data) - 1) / size).cast("int")))
    parts = raw.select(*REV, *(keep or []), F.posexplode(F.transform(numbers, lambda k: F.substring(data, k * size + 1, F.lit(size)))).alias("piece", "diff"))
    return parts.withColumn("piece", F.col("piece").cast("long"))

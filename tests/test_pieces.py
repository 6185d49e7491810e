"""Diffs in pieces against the sequential reading of the whole diff."""

import random

import pyarrow as pa
import pytest

from revlens.model import STAT_COLUMNS
from revlens.sources import pieces
from revlens.sources.diffs import SEPARATOR
from tests.test_diffs import CASES, sequential


def parse(spark, diffs, sizes, strict=False):
    rows = []
    for i, (diff, size) in enumerate(zip(diffs, sizes, strict=True)):
        at, piece = 0, 0
        rng = random.Random(i)
        while at < len(diff) or not piece:
            step = max(1, size + rng.randint(-size // 2, size // 2)) if size > 1 else 1
            rows.append(("r", str(i), piece * 3, diff[at : at + step]))
            at, piece = at + step, piece + 1
    rng = random.Random(1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, id string, piece long, diff binary").repartition(5)
    found = [{} for _ in diffs]
    for row in pieces.diffstat_from_pieces(df, strict).collect():
        assert row.path not in found[int(row.id)]
        found[int(row.id)][row.path] = tuple(row[c] for c in STAT_COLUMNS)
    return found


LINES = ["--- a/f", "+++ b/f", "--- a/g\tx", "+++ b/g", "+++ /dev/null", "--- /dev/null", "@@ -1,2 +1,2 @@", "@@ -3 +4 @@ s", "@@ -1,4 +1 @@", "@@@ -1,2 -1,3 +1,4 @@@", "-a", "+b", "+", "-", " c", "", "\\ No newline",
         "--- not a header", "+++ ++", SEPARATOR, "=" * 66, "diff --git a/f b/f", '--- "a/q q"', "-- x", "---", "@ -1 +1 @", "@@ -1, +1,2 @@"]


def random_diff(rng):
    lines = [rng.choice(LINES) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.1:
        lines.insert(rng.randint(0, len(lines)), "ÿ end")
    return "\n".join(lines).encode("latin-1")


def test_cases(spark):
    diffs = [d if isinstance(d, bytes) else d.encode() for d, _ in CASES.values()]
    for size in (1, 5, 10_000):
        assert parse(spark, diffs, [size] * len(diffs)) == [sequential(d) for d in diffs]


@pytest.mark.parametrize("seed", range(2))
def test_random_diffs(spark, seed):
    rng = random.Random(seed)
    diffs = [d for d in (random_diff(rng) for _ in range(400)) if b"-1, +1" not in d]
    assert parse(spark, diffs, [rng.choice([1, 2, 3, 7, 20, 100, 5000]) for _ in diffs]) == [sequential(d) for d in diffs]


def test_a_line_longer_than_pieces_and_kept_bytes(spark):
    long = b"x" * 300_000
    diff = b"--- a/f\n+++ b/f\n@@ -1 +1,2 @@\n-" + long + b"\n+--- a/" + long + b"\n+y\n--- a/" + b"d/" * 3000 + b"n\n+++ b/" + b"d/" * 3000 + b"n\n@@ -0,0 +1 @@\n+z"
    want = sequential(diff)
    assert want == {"f": (300_009, 2, 300_001, 1), "d/" * 3000 + "n": (2, 1, 0, 0)}
    assert parse(spark, [diff, diff], [1000, 70_000]) == [want, want]


def test_bad_headers(spark):
    df = spark.createDataFrame([("r", "1", 0, b"--- a/f\n+++ b/f\n@@ -"), ("r", "1", 1, b"1 @@\n+x\n"), ("r", "2", 0, b"--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+x")], "repo string, id string, piece long, diff binary")
    assert [tuple(r) for r in pieces.rejected_pieces(df).collect()] == [("r", "1", "bad hunk header: @@ -1 @@")]
    assert len(pieces.diffstat_from_pieces(df).collect()) == 2
    with pytest.raises(Exception, match="bad hunk header"):
        pieces.diffstat_from_pieces(df, strict=True).collect()


def test_a_hot_diff_runs_in_many_tasks(spark):
    """All pieces of one revision: they are read where they lie, without a shuffle."""
    body = b"".join(b"--- a/f%d\n+++ b/f%d\n@@ -0,0 +1,2 @@\n+a\n+b\n" % (i, i) for i in range(3000))
    raw = spark.createDataFrame([("r", "1", body)], "repo string, id string, diff binary")
    own = pieces.cut(raw, 4000)
    got = pieces.diffstat_from_pieces(own).collect()
    assert len(got) == 3000 and all(tuple(r)[3:] == (4, 2, 0, 0) for r in got)
    plan = pieces.read_pieces(own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_none(spark):
    none = spark.createDataFrame([], "repo string, id string, piece long, diff binary")
    assert pieces.diffstat_from_pieces(none).collect() == []


def test_a_single_line_has_the_summary_of_whole_lines():
    odd = [b"", b"-", b"+", b"@", b"@@", b"@@ -1,2 +3 @@", b"@@ -1 +0,0 @@ x", b"@@ nothing", b"=" * 67, b"=" * 66, b"\xff", b"\xffx", b"--- ", b"+++ ", b"---", b"+++\t", b"--- a/b", b"+++ b/c", b" x", b"\0", b"-\0", b"\r"]
    odd += [pieces._SEPARATOR, pieces._SEPARATOR + b"=", pieces._SEPARATOR[:-1]]
    for line in odd:
        for more in (0, 1, 70):
            assert pieces._of_line(line, more) == pieces._of_lines(line, more), (line, more)


def test_batches_of_summaries_equal_nested_rows():
    texts = [b"--- a\n+++ b\n@@ -1 +1,2 @@\n-x\n+y\n+z\n--- c\n+++ d", b"", b"+x", b"@@ bad\n x"]
    columns = [("repo", pa.string()), ("pos", pa.int64())]
    rows = [{"repo": "r", "pos": k, **pieces.summary(x)} for k, x in enumerate(texts)]
    rows[2:2] = [{"repo": None, "pos": 9, **dict.fromkeys(name for name, _ in pieces._SUMMARY)}]
    for own in (rows, rows[2:], rows[2:3], []):
        made = pieces._with(columns, own)
        assert made.to_pylist() == own and made.schema == pa.schema([*columns, *pieces._SUMMARY])

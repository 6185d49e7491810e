"""Diff parsing against fixed cases and a sequential reading of random diffs."""

import random
import re

import pytest

from revlens.model import STAT_COLUMNS
from revlens.operators.totals import change_totals
from revlens.sources.diffs import SEPARATOR, diffstat_from_diffs, rejected


def sequential(diff: bytes) -> dict:
    """One pass over the lines with the two counters spelled out."""
    files, name, owed = {}, "", [0, 0]
    stat = [0, 0, 0, 0]

    def flush():
        nonlocal name
        if name and any(stat):
            files[name] = tuple(stat)
            name = ""

    for line in diff.decode("latin-1").split("\n"):
        if max(owed) <= 0 and line[:4] in ("--- ", "+++ "):
            flush()
            stat = [0, 0, 0, 0]
            path = line[4:].split("\t")[0]
            if path != "/dev/null":
                if len(path) > 1 and path[0] == path[-1] == '"':
                    path = path[1:-1]
                name = path[2:] if path[:2] in ("a/", "b/") else path
        elif line.startswith("@@"):
            for part in re.split("@@", line[2:])[0].split()[:2]:
                owed[part[0] != "-"] = int(part.split(",")[1]) if "," in part else 1
        elif line[:1] in ("-", "+"):
            side = "+-".index(line[0])
            stat[2 * side] += len(line)
            stat[2 * side + 1] += 1
            owed[1 - side] -= 1
        elif line == SEPARATOR:
            owed = [0, 0]
        elif line[:1] == "ÿ":
            break
        else:
            owed = [n - 1 if n > 0 else n for n in owed]
    flush()
    return {k.encode("latin-1").decode("utf-8", "replace"): v for k, v in files.items()}


def parse(spark, diffs, strict=True):
    rows = [("r", str(i), d if isinstance(d, bytes) else d.encode()) for i, d in enumerate(diffs)]
    raw = spark.createDataFrame(rows, "repo string, id string, diff binary")
    found = [{} for _ in diffs]
    for row in diffstat_from_diffs(raw, strict).collect():
        assert row.path not in found[int(row.id)]
        found[int(row.id)][row.path] = tuple(row[c] for c in STAT_COLUMNS)
    return found


CASES = {
    "added file": ("4f2a\n--- /dev/null\n+++ b/NEW\n@@ -0,0 +1,2 @@\n+one\n+two\n", {"NEW": (8, 2, 0, 0)}),
    "deleted file": ("--- a/OLD\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-one\n-two\n", {"OLD": (0, 0, 8, 2)}),
    "two hunks": ("--- a/M\n+++ b/M\n@@ -1,2 +1,2 @@\n x\n-a\n+bb\n@@ -9,2 +9,2 @@ section\n-c\n+d\n y\n", {"M": (5, 2, 4, 2)}),
    "svn": (f"Index: f\n{SEPARATOR}\n--- f\t(revision 1)\n+++ f\t(revision 2)\n@@ -1 +1 @@\n-a\n+b\n", {"f": (2, 1, 2, 1)}),
    "svn property": (
        f"Index: f\n{SEPARATOR}\n--- f\t(revision 1)\n+++ f\t(revision 2)\n@@ -1 +1 @@\n-a\n+b\n\nProperty changes on: f\n___\nAdded: p\n   + x\n+more\n",
        {"f": (7, 2, 2, 1)},
    ),
    "quoted and spaced": (
        '--- "a/sp\\303\\244t.c"\n+++ "b/sp\\303\\244t.c"\n@@ -1 +0,0 @@\n-x\n--- a/with space\n+++ b/with space\n@@ -1 +0,0 @@\n-y\n--- a/p+q\n+++ b/p+q\n@@ -1 +0,0 @@\n-z\n',
        {"a/sp\\303\\244t.c": None, "with space": (0, 0, 2, 1), "p+q": (0, 0, 2, 1)},
    ),
    "bad utf-8 body": (b"--- a/f\n+++ b/f\n@@ -1 +1 @@\n-\xe4\n+\xe4\xf6\n", {"f": (3, 1, 2, 1)}),
    "utf-8 path": ("--- a/ä\n+++ b/ä\n@@ -0,0 +1 @@\n+ü\n", {"ä": (3, 1, 0, 0)}),
    "removed text looks like a header": ("--- a/q\n+++ b/q\n@@ -1,2 +1 @@\n--- not a header\n keep\n", {"q": (0, 0, 16, 1)}),
    "added text looks like a header": ("--- a/q\n+++ b/q\n@@ -1 +1,2 @@\n keep\n+++ not a header\n", {"q": (16, 1, 0, 0)}),
    "no newline mark": ("--- a/q\n+++ b/q\n@@ -1 +1 @@\n-a\n\\ No newline at end of file\n+b\n\\ No newline at end of file\n", {"q": (2, 1, 2, 1)}),
    "same path twice": ("--- a/q\n+++ b/q\n@@ -0,0 +1 @@\n+a\n--- a/q\n+++ b/q\n@@ -0,0 +1,2 @@\n+b\n+cc\n", {"q": (5, 2, 0, 0)}),
    "mode change only": ("diff --git a/s b/s\nold mode 100644\nnew mode 100755\n", {}),
    "binary": ("--- a/b.png\n+++ b/b.png\nBinary files differ\n", {}),
    "both sides null after a file": ("--- a/q\n+++ b/q\n@@ -0,0 +1 @@\n+a\n--- /dev/null\n+++ /dev/null\n@@ -0,0 +1 @@\n+b\n", {"q": (2, 1, 0, 0)}),
    "empty": ("", {}),
    "crlf": ("--- a/q\n+++ b/q\n@@ -1 +1 @@\n-a\r\n+b\r\n", {"q": (3, 1, 3, 1)}),
    "combined diff": ("--- a/q\n+++ b/q\n@@@ -1,2 -1,2 +1,3 @@@\n- a\n +b\n--- a/z\n++c\n", {"q": (0, 0, 3, 1), "z": (3, 1, 0, 0)}),
    "end mark": (b"--- a/q\n+++ b/q\n@@ -0,0 +1 @@\n+a\n\xff\n--- a/z\n+++ b/z\n@@ -0,0 +1 @@\n+a\n", {"q": (2, 1, 0, 0)}),
}


def test_cases(spark):
    found = parse(spark, [diff for diff, _ in CASES.values()])
    for (name, (diff, want)), got in zip(CASES.items(), found):
        raw = diff if isinstance(diff, bytes) else diff.encode()
        assert got == sequential(raw), name
        if None not in want.values():
            assert got == want, name


def test_malformed_hunk(spark):
    bad = "--- a/q\n+++ b/q\n@@ nonsense @@\n+a\n"
    with pytest.raises(Exception, match="bad hunk header"):
        parse(spark, [bad])
    good = CASES["two hunks"][0]
    assert parse(spark, [good, bad, good], strict=False) == [CASES["two hunks"][1], {"q": (2, 1, 0, 0)}, CASES["two hunks"][1]]
    raw = spark.createDataFrame([("r", "0", good), ("r", "1", bad), ("r", "2", "@@ -1\n")], "repo string, id string, diff string")
    assert sorted(tuple(r) for r in rejected(raw).collect()) == [("r", "1", "bad hunk header: @@ nonsense @@"), ("r", "2", "bad hunk header: @@ -1")]


def _random_diff(rng):
    lines = []
    for _ in range(rng.randint(0, 14)):
        kind = rng.random()
        path = rng.choice(["/dev/null", "a/x", "b/x", "y", '"a/q"', "a/z\t(revision 3)"])
        if kind < 0.35:
            lines += [f"--- {path}", f"+++ {rng.choice([path, '/dev/null', 'b/w'])}"]
        elif kind < 0.7:
            old, new = rng.randint(0, 4), rng.randint(0, 4)
            lines.append(rng.choice([f"@@ -1,{old} +1,{new} @@", f"@@ -1 +1,{new} @@ tail", "@@ -3 +4 @@"]))
        elif kind < 0.75:
            lines.append(SEPARATOR)
        for _ in range(rng.randint(0, 5)):
            lines.append(rng.choice(["+added", "-gone", " same", "", "--- a/inner", "+++ b/inner", "-- x", "\\ No newline", "+", "-"]))
    return "\n".join(lines).encode()


def test_random_diffs(spark):
    rng = random.Random(7)
    diffs = [_random_diff(rng) for _ in range(1500)]
    for diff, got in zip(diffs, parse(spark, diffs)):
        assert got == sequential(diff), diff


def test_totals_of_parsed(spark):
    raw = spark.createDataFrame([("r", "1", CASES["two hunks"][0])], "repo string, id string, diff string")
    (row,) = change_totals(diffstat_from_diffs(raw)).collect()
    assert (row.files, row.lines_added, row.lines_removed) == (1, 2, 2)

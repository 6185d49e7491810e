"""Feeds that arrive in several files give the batch answer."""

import os

from pyspark.sql import functions as F

from revlens.model import LINE
from revlens.streaming import feeds

COLUMNS = "repo string, branch string, id string, seq bigint, date bigint, author string, message string"
HOUR = 3600


def _rows(numbers):
    return [("r", "main", str(i), i, i * HOUR, f"a{i % 3}", "m") for i in numbers]


def _write(spark, path, *batches):
    for rows in batches:
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(path)


def _feed(spark, path):
    return feeds.feed(spark, path, spark.createDataFrame([], COLUMNS).schema, files_per_trigger=1)


def test_feed_continues_where_it_stopped(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, source, _rows(range(10)))
    assert feeds.append_to(_feed(spark, source), out).count() == 10
    _write(spark, source, _rows(range(10, 15)))
    assert feeds.append_to(_feed(spark, source), out).count() == 15


def test_once_each(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, source, _rows(range(20)), _rows(range(15, 30)))
    assert sorted(r.seq for r in feeds.once_each(_feed(spark, source), out).collect()) == list(range(30))


def test_no_revision_is_late(spark, tmp_path):
    source = str(tmp_path / "in")
    late = [("r", "main", "old", 999, 3 * HOUR, "a0", "m"), ("r", "main", "undated", 998, 0, "a0", "m")]
    _write(spark, source, _rows(range(24 * 400, 24 * 400 + 10)), _rows(range(24 * 500, 24 * 500 + 3)) + late)
    assert {"old", "undated"} < {r.id for r in feeds.once_each(_feed(spark, source), str(tmp_path / "once")).collect()}
    slots = _totals(spark, source, tmp_path / "slots", lambda b: feeds.slot_totals(b, F.lit(2)), "slot")
    assert {r.slot // 86400: (r.commits, r.churn) for r in slots.collect()} == {0: (2, 4), 400: (10, 20), 500: (3, 6)}


def _totals(spark, source, out, shape, *keys):
    return feeds.totals_so_far(_feed(spark, source), str(out), shape, [*LINE, *keys])


def test_running_authors(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, _rows(range(10)), _rows(range(10, 31)))
    state = _totals(spark, source, tmp_path / "out", lambda b: feeds.author_totals(b, F.lit(1)), "author")
    assert {r.author: r.commits for r in state.collect()} == {"a0": 11, "a1": 10, "a2": 10}


def test_live_punchcard(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, _rows(range(1, 30)), _rows(range(30, 24 * 7 + 1)))
    cells = _totals(spark, source, tmp_path / "out", feeds.punchcard_cells, "dow", "hour").collect()
    assert len(cells) == 168 and {r.n for r in cells} == {1}


def test_stored_sums_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "UNMERGED", 2)
    source, out = str(tmp_path / "in"), tmp_path / "out"
    shape, keys = feeds.punchcard_cells, [*LINE, "dow", "hour"]
    for i in range(4):
        _write(spark, source, _rows(range(1 + 10 * i, 11 + 10 * i)))
        _totals(spark, source, out, shape, "dow", "hour")
    schema = shape(spark.createDataFrame([], COLUMNS)).schema
    feeds.compact(spark, str(out / "batches"), keys, schema, unmerged=2)
    assert sum(r.n for r in _totals(spark, source, out, shape, "dow", "hour").collect()) == 40
    left = [n for n in os.listdir(out / "batches") if n.startswith("batch_id")]
    assert len(left) <= 2 and len(os.listdir(out / "batches" / "merged")) == 1


def test_an_empty_feed_gives_empty_tables(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    stream = _feed(spark, str(source))
    assert feeds.store_new(stream, str(tmp_path / "a")).columns == stream.columns
    assert _totals(spark, str(source), tmp_path / "b", feeds.punchcard_cells, "dow", "hour").collect() == []
    patches = feeds.feed(spark, str(source), spark.createDataFrame([], "repo string, id string, diff string").schema)
    assert feeds.parse_diffs(patches, str(tmp_path / "c")).collect() == []


def test_store_and_diffs(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(spark, source, _rows(range(10)), _rows(range(5, 15)))
    assert feeds.store_new(_feed(spark, source), str(tmp_path / "out")).count() == 15
    patches = str(tmp_path / "patches")
    for i in range(2):
        diff = f"@@ \n--- /dev/null\n+++ b/f{i}\n@@ -0,0 +1 @@\n+x\n"
        spark.createDataFrame([("r", str(i), diff)], "repo string, id string, diff string").coalesce(1).write.mode("append").parquet(patches)
    stream = feeds.feed(spark, patches, spark.read.parquet(patches).schema, 1)
    rows = feeds.parse_diffs(stream, str(tmp_path / "parsed")).collect()
    assert sorted((r.id, r.path, r.lines_added) for r in rows) == [("0", "f0", 1), ("1", "f1", 1)]


def test_a_single_file_is_a_feed(spark, tmp_path):
    folder = str(tmp_path / "in")
    _write(spark, folder, _rows(range(4)))
    (name,) = [n for n in os.listdir(folder) if n.endswith(".parquet")]
    assert feeds.append_to(_feed(spark, os.path.join(folder, name)), str(tmp_path / "out")).count() == 4


def test_pieces_of_a_diff_come_in_any_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(feeds, "UNMERGED", 2)
    diff = b"--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-a\n-b\n+c\n--- a/g\n+d\n--- a/g\n+++ b/g\n@@ -0,0 +1 @@\n+xyz\n"
    schema = "repo string, id string, piece long, diff binary"
    source, pieces = str(tmp_path / "in"), [("r", "1", i, diff[i * 13 : i * 13 + 13]) for i in range(7)]
    for part in (pieces[4:], pieces[:1], pieces[2:4], pieces[1:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        got = feeds.parse_pieces(feeds.feed(spark, source, spark.createDataFrame([], schema).schema, 1), str(tmp_path / "out"))
    assert sorted((r.path, r.lines_added, r.lines_removed, r.bytes_added) for r in got.collect()) == [("f", 2, 3, 4), ("g", 1, 0, 4)]

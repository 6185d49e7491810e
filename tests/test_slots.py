"""Slots that close: once each, late rows as corrections, and all of it adds up."""

import random

from pyspark.sql import functions as F

from revlens.streaming import feeds, slots

COLUMNS = "repo string, branch string, id string, date bigint, lines bigint"
DAY = 86400


def drain(spark, source, out):
    feed = feeds.feed(spark, source, spark.createDataFrame([], COLUMNS).schema, files_per_trigger=1)
    return slots.closing_slots(feed, F.col("lines"), out)


def put(spark, source, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(source)


def kinds(df):
    return sorted((r.slot // DAY, r.kind, r.commits, r.churn) for r in df.collect())


def test_slots_close_once_and_late_rows_correct_them(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    row = lambda i, date, lines=2: ("r", "main", str(i), date, lines)
    put(spark, source, [row(i, i * 3600) for i in range(24 * 4)])
    first = kinds(drain(spark, source, out))
    assert first == [(0, "closed", 24, 48), (1, "closed", 24, 48)]
    assert kinds(slots.still_open(spark, out)) == [(2, "open", 24, 48), (3, "open", 24, 48)]
    put(spark, source, [row(100, 5, 7), row(101, 3 * DAY + 7), row(102, 0, None)])
    assert kinds(drain(spark, source, out)) == [(0, "closed", 24, 48), (0, "late", 2, 7), (1, "closed", 24, 48)]
    put(spark, source, [row(103, 10 * DAY)])
    want = [(0, "closed", 24, 48), (0, "late", 2, 7), (1, "closed", 24, 48), (2, "closed", 24, 48), (3, "closed", 25, 50)]
    assert kinds(drain(spark, source, out)) == want
    # nothing new: nothing changes
    assert kinds(drain(spark, source, out)) == want
    whole = {r.slot // DAY: (r.commits, r.churn) for r in slots.totals_now(spark, out).collect()}
    assert whole == {0: (26, 55), 1: (24, 48), 2: (24, 48), 3: (25, 50), 10: (1, 2)}


def test_random_feed_adds_up(spark, tmp_path):
    rng = random.Random(4)
    source, out, every = str(tmp_path / "in"), str(tmp_path / "out"), []
    for k in range(4):
        rows = [("r" if rng.random() < 0.9 else "q", f"b{rng.randint(0, 1)}", f"{k}.{i}", rng.randint(0, (k + 1) * 5 * DAY), rng.randint(0, 9)) for i in range(300)]
        every += rows
        put(spark, source, rows)
        given = drain(spark, source, out)
        assert given.where("kind = 'closed'").groupBy("repo", "branch", "slot").count().where("count > 1").count() == 0
        want = {}
        for repo, branch, _, date, lines in every:
            key = (repo, branch, date // DAY * DAY)
            n, s = want.get(key, (0, 0))
            want[key] = (n + 1, s + lines)
        assert {(r.repo, r.branch, r.slot): (r.commits, r.churn) for r in slots.totals_now(spark, out).collect()} == want
    assert given.where("kind = 'late'").count() > 0


def test_an_empty_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert drain(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect() == []
    assert slots.totals_now(spark, str(tmp_path / "out")).collect() == []

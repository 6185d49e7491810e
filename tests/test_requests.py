"""Many requests at once against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from revlens.operators import requests

SCHEMA = "key string, start long, end long"


def asked(spark, rows):
    return spark.createDataFrame([(k, i, a, b) for i, (k, a, b) in enumerate(rows)], "key string, req long, start long, end long")


def random_case(seed, low=-300, high=300):
    rng = random.Random(seed)
    key = lambda: "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 5)}"
    have = [(key(), a, a + rng.randint(0, 12)) for a in (rng.randint(low, high) for _ in range(150))]
    want = [(key(), a, a + rng.choice([-1, 0, 1, 5, 40, 500])) for a in (rng.randint(low - 20, high + 20) for _ in range(200))]
    want += [("bare", 3, 9), ("bare", -(2**40), 2**40)] + [("hot", low, high)] * 30
    return have, want


@pytest.mark.parametrize("seed", range(3))
def test_random_requests(spark, seed):
    have, want = random_case(seed)
    covered = {}
    for k, a, b in have:
        covered.setdefault(k, set()).update(range(a, b + 1))
    got = {}
    for r in requests.missing_parts(spark.createDataFrame(have, SCHEMA), asked(spark, want), ["key"]).collect():
        assert r.start <= r.end
        got.setdefault(r.req, []).append((r.start, r.end))
    for i, (k, a, b) in enumerate(want):
        if b - a > 10**6:
            assert sorted(got[i]) == [(a, b)]
            continue
        open_ = [x for x in range(a, b + 1) if x not in covered.get(k, ())]
        runs = [(x, next(y for y in range(x, b + 2) if y + 1 not in open_)) for x in open_ if x - 1 not in open_]
        assert sorted(got.get(i, [])) == runs
    ids = [(k, x) for k in ("hot", "k0", "bare") for x in range(-400, 400, 3)]
    served = requests.served_ids(spark.createDataFrame(have, SCHEMA), spark.createDataFrame(ids + ids, "key string, id long"), asked(spark, want), ["key"])
    have_ids = sorted((r.key, r.req, r.id) for r in served.collect())
    assert have_ids == sorted((k, i, x) for i, (k, a, b) in enumerate(want) for kk, x in ids if kk == k and a <= x <= b and x in covered.get(k, ()))


def test_pieces_make_up_the_range(spark):
    rng = random.Random(1)
    rows = [(a, b) for a, b in ((rng.randint(0, 200), rng.randint(0, 255)) for _ in range(300))] + [(0, 255), (0, 0), (255, 255), (5, 4)]
    df = spark.createDataFrame(rows, "a long, b long").withColumn("p", requests.pieces(F.col("a"), F.col("b"), 8))
    for r in df.collect():
        numbers = sorted(x for p in r.p for x in range(p.piece << p.bits, (p.piece + 1) << p.bits))
        assert numbers == list(range(r.a, r.b + 1)) and len(r.p) <= 16


def test_no_pair_beyond_true_overlaps(spark):
    """The join itself makes one row for each point in a range, and none else."""
    points = spark.range(1000).selectExpr("'k' as key", "id * 7 as at")
    ranges = spark.range(400).selectExpr("'k' as key", "id as r", "id * 13 as lo", "id * 13 + id % 50 as hi")
    met = requests.points_inside(points, "at", ranges, "lo", "hi", ["key"])
    want = sum(1 for r in range(400) for x in range(1000) if r * 13 <= x * 7 <= r * 13 + r % 50)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = met.select("*")._jdf.queryExecution().executedPlan()
        assert len(plan.executeCollect()) == want
        rows, todo = [], [plan]
        while todo:
            node = todo.pop()
            if "Join" in node.nodeName():
                rows.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
        assert rows == [want]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_none(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("k", 1, 3)], SCHEMA)
    no_requests = asked(spark, [("k", 5, 1)])
    assert requests.missing_parts(some, no_requests, ["key"]).collect() == []
    assert [(r.start, r.end) for r in requests.missing_parts(none, asked(spark, [("k", 1, 5)]), ["key"]).collect()] == [(1, 5)]
    assert requests.served_ids(none, spark.createDataFrame([("k", 1)], "key string, id long"), asked(spark, [("k", 0, 5)]), ["key"]).collect() == []

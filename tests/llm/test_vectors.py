"""Hard negatives and nearest neighbours against brute force, with odd vectors."""

import math

import numpy as np
import pytest

from revlens.llm import collisions, negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd_rows(seed, n, width=12, clustered=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    rows = []
    for i in range(n):
        v = centres[i % 6] + 0.2 * rng.normal(size=width) if clustered else rng.normal(size=width)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 4))))
    rows[3] = (3, rows[2][1], rows[2][2])
    rows[4] = (4, None, 1)
    rows[5] = (5, [float("nan")] * width, 1)
    rows[6] = (6, [0.0] * width, 1)
    rows[7] = (7, rows[8][1], None)
    rows[9] = (9, [*rows[9][1][:-1], float("inf")], 2)
    rows[10] = (10, [*rows[10][1][:-1], None], 2)
    rows[11] = (11, rows[11][1][:5], 3)
    rows[12] = (12, [], 3)
    rows[13] = (None, rows[13][1], 0)
    rows += [rows[20], (20, rows[21][1], 2), (None, rows[22][1], 1)]
    rows += [(50_000 + i, rows[30][1], 1) for i in range(n // 3)]
    return rows


def usable(row, with_label):
    _, v, label = row
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and not (with_label and label is None)


def dense(v, width):
    return np.array(list(v) + [0.0] * (width - len(v)), float)


def test_negatives(spark):
    for seed, n, clustered in ((1, 300, False), (2, 5000, True)):
        rows = odd_rows(seed, n, clustered=clustered)
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as page", "2 as score", "'x' as id", "3 as vector", "4 as low").repartition(3)
        got = negatives.hard_negatives(df, df.where("vec_id % 100 = 0"))
        have = sorted((tuple(r) for r in got.drop("positive_rank").collect()), key=repr)
        own = [r for r in rows if usable(r, True)]
        x = np.array([np.floor(256 * dense(v, 12)) for _, v, _ in own]).astype(int)
        want, done = [], set()
        key = [math.inf if r[0] is None else r[0] for r in own]
        for a, r in enumerate(own):
            if r[0] is None or r[0] % 100 or (r[0], r[2], tuple(x[a])) in done:
                continue
            done.add((r[0], r[2], tuple(x[a])))
            s = x @ x[a]
            order = sorted((i for i in range(len(own)) if own[i][0] != r[0]), key=lambda i: (-s[i], key[i]))
            for p in [i for i in order if own[i][2] == r[2]][:5]:
                found = [i for i in order if own[i][2] != r[2] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]][:10]
                want += [(r[0], own[p][0], k, own[i][0], int(s[p]), int(s[i])) for k, i in enumerate(found, 1)]
        assert have == sorted(want, key=repr)


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours(spark, clustered):
    rows = odd_rows(3, 4000, clustered=clustered)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as page", "2 as radius", "3 as twin", "'x' as rank").repartition(3)
    got = collisions.nearest(df, df.where("vec_id % 100 = 0")).collect()
    own = [r for r in rows if usable(r, False) and any(r[1])]
    x = np.array([dense(v, 12) for _, v, _ in own])
    key = [math.inf if r[0] is None else r[0] for r in own]
    found = total = 0
    for a, r in enumerate(own):
        if r[0] is None or r[0] % 100:
            continue
        gap = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        order = sorted((i for i in range(len(own)) if own[i][0] != r[0]), key=lambda i: (gap[i], key[i]))[:10]
        have = sorted((g for g in got if g["query_id"] == r[0]), key=lambda g: g["rank"])
        assert [g["rank"] for g in have] == list(range(1, 11))
        assert [(g["score"], math.inf if g["vec_id"] is None else g["vec_id"]) for g in have] == sorted((g["score"], math.inf if g["vec_id"] is None else g["vec_id"]) for g in have)
        for g in have:
            assert any(own[i][0] == g["vec_id"] and abs(gap[i] - g["score"]) < 1e-12 for i in range(len(own)))
        found, total = found + len({own[i][0] for i in order} & {g["vec_id"] for g in have}), total + len({own[i][0] for i in order})
    assert total and found / total >= 0.9


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.5, 0.5], 2), (100, [0.0, 1.0], 2)], SCHEMA)
    got = collisions.nearest(few, few.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 1), (0, 2), (0, 100), (100, 2), (100, 1), (100, 0)]
    assert [tuple(r) for r in negatives.hard_negatives(few, few.where("vec_id = 0")).collect()] == [(0, 1, 1, 2, 58880, 32768, 1)]
    for none in (few.limit(0), few.selectExpr("vec_id", "cast(null as array<float>) as embedding", "label")):
        assert collisions.nearest(none, none).collect() == [] and negatives.hard_negatives(none, none).collect() == []

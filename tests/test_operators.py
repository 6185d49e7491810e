"""Running aggregates, intervals, walks and folds against plain Python."""

import random
import weakref

import pytest
from pyspark.sql import functions as F

from revlens.operators import extend, intervals, lineage, ranking, series, store
from revlens.operators.scan import by_day, by_position, range_scan, scan


def _running(rows, exclusive):
    want, sums, tops = {}, {}, {}
    for key, date, seq, value in sorted(rows):
        if exclusive:
            want[key, date, seq] = (sums.get(key, 0), tops.get(key))
        sums[key] = sums.get(key, 0) + value
        tops[key] = max(value, tops.get(key, value))
        if not exclusive:
            want[key, date, seq] = (sums[key], tops[key])
    return want


def _skewed(rng, n):
    """One key owns half of the rows, and most of those share a date."""
    rows = []
    for seq in range(n):
        hot = rng.random() < 0.5
        date = 5 * 86400 if hot and rng.random() < 0.7 else rng.randint(0, 20 * 86400)
        rows.append(("hot" if hot else f"k{rng.randint(0, 9)}", date, seq << 14, rng.randint(-50, 50)))
    return rows


@pytest.mark.parametrize("exclusive", [False, True])
def test_range_scan(spark, exclusive):
    rows = _skewed(random.Random(1), 3000)
    df = spark.createDataFrame(rows, "key string, date bigint, seq bigint, v bigint")
    values = {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}
    got = range_scan(df, ["key"], ["date", "seq"], values, exclusive).collect()
    assert len(got) == len(rows)
    assert {(r.key, r.date, r.seq): (r.total, r.top) for r in got} == _running(rows, exclusive)
    assert {(r.key, r.date, r.seq, r.v) for r in got} == set(rows)


@pytest.mark.parametrize("exclusive", [False, True])
def test_scan_in_blocks(spark, exclusive):
    rows = [(k, s, s, v) for k, _, s, v in _skewed(random.Random(2), 2000)]
    df = spark.createDataFrame(rows, "key string, date bigint, seq bigint, v bigint")
    values = {"total": ("sum", F.col("v")), "top": ("max", F.col("v"))}
    for levels in (None, by_position("seq"), by_day("date")):
        got = scan(df, ["key"], ["seq"], values, levels, exclusive).collect()
        assert {(r.key, r.date, r.seq): (r.total, r.top) for r in got} == _running(rows, exclusive)


def _ids(pairs):
    return {i for start, end in pairs for i in range(start, end + 1)}


def _runs(ids):
    runs = []
    for i in sorted(ids):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return {tuple(r) for r in runs}


def _frame(spark, pairs, key="k"):
    return spark.createDataFrame([(key, a, b) for a, b in pairs], "key string, start bigint, end bigint")


def test_interval_cases(spark):
    def merged(pairs, **options):
        return {(r.start, r.end) for r in intervals.coalesce_intervals(_frame(spark, pairs), ["key"], **options).collect()}

    assert merged([(0, 4), (5, 12)]) == {(0, 4), (5, 12)}
    assert merged([(0, 4), (5, 12)], merge_adjacent=True) == {(0, 12)}
    assert merged([(0, 9), (3, 5), (3, 5)]) == {(0, 9)}
    assert merged([(0, 4), (4, 6), (20, 21)]) == {(0, 6), (20, 21)}

    def gaps(stored, request):
        found = intervals.missing_intervals(_frame(spark, stored), _frame(spark, [request]), ["key"])
        return {(r.start, r.end) for r in found.collect()}

    assert gaps([(0, 4), (5, 12)], (3, 7)) == set()
    assert gaps([(3, 4), (6, 7)], (0, 12)) == {(0, 2), (5, 5), (8, 12)}
    assert gaps([(100, 200)], (0, 12)) == {(0, 12)}

    known = spark.createDataFrame([("k", i) for i in range(1, 13)], "key string, id bigint")
    served = intervals.ids_served(_frame(spark, [(0, 4), (5, 12)]), known, _frame(spark, [(3, 7)]), ["key"])
    assert {r.id for r in served.collect()} == {3, 4, 5, 6, 7}


def test_random_intervals(spark):
    rng = random.Random(3)
    base = 1 << 20  # straddles a block border
    stored, requests, want_gaps, want_runs = [], [], set(), set()
    for k in range(25):
        pairs = [(base + s, base + s + rng.randint(0, 9)) for s in (rng.randint(-60, 60) for _ in range(rng.randint(0, 14)))]
        low = base + rng.randint(-70, 0)
        high = low + rng.randint(0, 90)
        stored += [(f"k{k}", a, b) for a, b in pairs]
        requests.append((f"k{k}", low, high))
        want_gaps |= {(f"k{k}", a, b) for a, b in _runs(set(range(low, high + 1)) - _ids(pairs))}
        want_runs |= {(f"k{k}", a, b) for a, b in _runs(_ids(pairs))}
    schema = "key string, start bigint, end bigint"
    have, asked = spark.createDataFrame(stored, schema), spark.createDataFrame(requests, schema)
    assert {tuple(r) for r in intervals.missing_intervals(have, asked, ["key"]).collect()} == want_gaps
    assert {tuple(r) for r in intervals.coalesce_intervals(have, ["key"], merge_adjacent=True).collect()} == want_runs


def test_first_parent_chain(spark):
    # a chain longer than any recursion limit, with side branches hanging off it
    main = [("r", str(i), str(i - 1) if i else None) for i in range(300)]
    side = [("r", f"s{i}", str(i * 10)) for i in range(20)]
    dag = spark.createDataFrame(main + side, "repo string, id string, parent_id string")
    heads = spark.createDataFrame([("r", "main", "299"), ("r", "old", "s3")], "repo string, branch string, head_id string")
    got = {(r.branch, r.id): r.depth for r in lineage.first_parent_chain(dag, heads).collect()}
    want = {("main", str(299 - d)): d for d in range(300)}
    want |= {("old", "s3"): 0} | {("old", str(30 - d)): d + 1 for d in range(31)}
    assert got == want


def test_shared_history_is_listed_once(spark):
    trunk = [("r", str(i), str(i - 1) if i else None) for i in range(200)]
    side = [("r", f"s{k}.{j}", f"s{k}.{j - 1}" if j else str(10 * k)) for k in range(20) for j in range(k % 4 + 1)]
    dag = spark.createDataFrame(trunk + side, "repo string, id string, parent_id string")
    heads = [("r", "main", "199"), ("r", "same", "150")] + [("r", f"side{k:02}", f"s{k}.{k % 4}") for k in range(20)]
    heads = spark.createDataFrame(heads, "repo string, branch string, head_id string")
    history, joins = lineage.first_parent_history(dag, heads)
    rows = history.collect()
    assert len(rows) == len({r.id for r in rows}) == 200 + len(side)
    assert {(r.branch, r.depth) for r in rows if r.id == "150"} == {("main", 49)}
    found = {(r.branch, r.onto, r["at"]) for r in joins.collect()}
    assert found == {("same", "main", "150")} | {(f"side{k:02}", "main", str(10 * k)) for k in range(20)}
    alone = {r.id: r.depth for r in lineage.first_parent_chain(dag, heads, "side03").collect()}
    assert alone == {f"s3.{j}": 3 - j for j in range(4)} | {str(30 - d): 4 + d for d in range(31)}


def test_circular_parents_are_an_error(spark):
    ring = [("r", str(i), str((i + 1) % 40)) for i in range(40)]
    dag = spark.createDataFrame(ring, "repo string, id string, parent_id string")
    heads = spark.createDataFrame([("r", "main", "0")], "repo string, branch string, head_id string")
    with pytest.raises(ValueError, match="circle"):
        lineage.first_parent_chain(dag, heads)


def test_sparse_and_extreme_positions(spark):
    rows = [("k", i << 22, 1) for i in range(300)] + [("k", s, 1) for s in (-(2**63), -5, 2**62 + 1, 2**63 - 1)]
    df = spark.createDataFrame(rows, "key string, seq bigint, v bigint")
    got = scan(df, ["key"], ["seq"], {"total": ("sum", F.col("v"))}, by_position()).collect()
    assert {r.seq: r.total for r in got} == {s: i + 1 for i, (_, s, _) in enumerate(sorted(rows, key=lambda r: r[1]))}


def test_rank_of_many(spark):
    df = spark.range(6000).selectExpr("'r' AS repo", "id % 700 AS n", "cast(id as string) AS author")
    got = [(r.n, r.author) for r in ranking.rank(df, ["repo"], "n", ["author"], 2000).orderBy("rank").collect()]
    assert got == sorted(((i % 700, str(i)) for i in range(6000)), key=lambda x: (-x[0], x[1]))[:2000]


def test_spread_join_keeps_all(spark):
    facts = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(500)], "key string, i bigint")
    dims = facts.groupBy("key").agg(F.count("*").alias("n"))
    rows = ranking.spread_join(facts, dims, ["key"], ["i"]).collect()
    assert sorted(r.i for r in rows) == list(range(500))
    assert {r.n for r in rows if r.key == "hot"} == {sum(1 for i in range(500) if i % 3)}


def test_shares_and_remainder(spark):
    rows = [("r", f"a{i}", n) for i, n in enumerate([50, 30, 10, 5, 5])]
    df = spark.createDataFrame(rows, "repo string, author string, n bigint")
    pie = {r.author: r.share for r in ranking.shares(df, ["repo"], "author", "n", 2).collect()}
    assert pie == {"a0": 0.5, "a1": 0.3, "Others": 0.2}
    whole = ranking.shares(df, ["repo"], "author", "n", 5).collect()
    assert "Others" not in {r.author for r in whole}
    arcs = {r.author: (r.arc_from, r.arc_to, r.pct) for r in ranking.arcs(ranking.shares(df, ["repo"], "author", "n", 2), ["repo"], "n").collect()}
    assert arcs == {"a0": (0.0, 0.5, 50), "a1": (0.5, 0.8, 30), "Others": (0.8, 1.0, 20)}


def test_ties_go_to_the_smaller_name(spark):
    df = spark.createDataFrame([("r", x, 1) for x in "dbca"], "repo string, author string, n bigint")
    assert [r.author for r in ranking.rank(df, ["repo"], "n", ["author"], 2).orderBy("rank").collect()] == ["a", "b"]


def test_normalize_all_zero(spark):
    df = spark.createDataFrame([("z", 0), ("z", 0), ("p", 1), ("p", 3)], "repo string, n bigint")
    got = sorted((r.repo, r.share) for r in ranking.normalize(df, ["repo"], "n").collect())
    assert got == [("p", 0.25), ("p", 0.75), ("z", 0.0), ("z", 0.0)]


def test_smoothing_matches_the_definition(spark):
    rng = random.Random(5)
    points = {t: rng.randint(1, 9) for t in [1000, 91000] + [rng.randint(1000, 91000) for _ in range(200)]}
    counts = spark.createDataFrame([("r", "b", "s", t, n) for t, n in points.items()], "repo string, branch string, series string, date bigint, n bigint")
    extent = spark.createDataFrame([("r", "b", 1000, 91000)], "repo string, branch string, first_date bigint, last_date bigint")
    got = {r.point: (r.x, r.y) for r in series.smooth_cells(series.activity_cells(counts, extent)).collect()}
    assert set(got) == set(range(1001))
    step = 90  # 90000 seconds over 1000 steps
    for i in range(1001):
        x, w = 1000 + step * (i + 1), 25 * step
        want = sum(n * (1 - (t - x) / w) for t, n in points.items() if x - w <= t < x + w)
        assert got[i][0] == x and abs(got[i][1] - want) < 1e-6


def test_smoothing_of_a_single_moment(spark):
    counts = spark.createDataFrame([("r", "b", "s", 7, 3)], "repo string, branch string, series string, date bigint, n bigint")
    extent = spark.createDataFrame([("r", "b", 7, 7)], "repo string, branch string, first_date bigint, last_date bigint")
    rows = series.smooth_cells(series.activity_cells(counts, extent)).collect()
    assert len(rows) == 1001 and {(r.x, r.y) for r in rows} == {(7.0, 0.0)}


def test_fold_by_merges_pieces(spark):
    df = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(2000)], "key string, v bigint").repartition(7)

    def fold(pdf):
        return pdf.groupby("key", as_index=False).agg(n=("v", "size"), total=("v", "sum"))

    def merge(pdf):
        return pdf.groupby("key", as_index=False).agg(n=("n", "sum"), total=("total", "sum"))

    got = {r.key: (r.n, r.total) for r in extend.fold_by(df, ["key"], fold, merge, "key string, n bigint, total bigint", spread=4).collect()}
    want = {r.key: (r.n, r.total) for r in df.groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total")).collect()}
    assert got == want


@pytest.fixture
def small_batches(spark):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "10")
    yield
    spark.conf.set(size, before)


def test_map_revisions_frees_earlier_batches(spark, small_batches):
    seen = []

    def measure(pdf):
        texts = pdf["message"]
        earlier = sum(known() is not None for known in seen)
        seen.append(weakref.ref(texts))
        return pdf[["id"]].assign(chars=texts.str.len(), batch=len(seen), earlier=earlier)

    rows = [(str(i), "x" * (i % 17) if i % 5 else None) for i in range(95)]
    df = spark.createDataFrame(rows, "id string, message string").coalesce(1)
    got = extend.map_revisions(df, measure, "id string, chars bigint, batch int, earlier int").collect()
    assert {r.id: r.chars for r in got} == {i: None if text is None else len(text) for i, text in rows}
    assert max(r.batch for r in got) == 10
    assert {r.earlier for r in got} == {0}


def test_map_revisions_may_return_or_keep_its_rows(spark, small_batches):
    kept = []

    def same(pdf):
        kept.append(pdf)
        return pdf

    def count(pdf):
        kept.append(pdf)
        return pdf[["id"]].assign(sofar=sum(len(p["message"]) for p in kept))

    rows = [(str(i), f"text {i}") for i in range(25)]
    df = spark.createDataFrame(rows, "id string, message string").coalesce(1)
    assert sorted(tuple(r) for r in extend.map_revisions(df, same, "id string, message string").collect()) == sorted(rows)
    assert {r.sofar for r in extend.map_revisions(df, count, "id string, sofar bigint").collect()} == {10, 20, 25}


def test_version_gate(spark):
    rows = [(v, b) for v in range(-1, 8) for b in ("git", "subversion", "mercurial")]
    df = spark.createDataFrame(rows, "version int, backend string")
    got = {(r.version, r.backend): r.s for r in df.withColumn("s", store.version_status(F.col("version"), F.col("backend"))).collect()}
    assert {got[v, b] for v in (-1, 0, 6, 7) for b in ("git", "mercurial")} == {store.UNKNOWN}
    assert got[1, "mercurial"] == store.STALE and got[2, "mercurial"] == store.OK
    assert got[2, "subversion"] == store.STALE and got[3, "subversion"] == store.OK
    assert got[4, "git"] == store.STALE and got[5, "git"] == store.OK


def test_store_append_audit_repair(spark, tmp_path):
    def payloads(ids):
        return store.seal(spark.createDataFrame([("r", str(i), f"payload {i}") for i in ids], "repo string, id string, payload string"))

    path = str(tmp_path / "store")
    store.append_new(payloads([1, 2, 2, 3]), path)
    stored = store.append_new(payloads([2, 3, 4]), path)
    assert sorted(r.id for r in stored.collect()) == ["1", "2", "3", "4"]
    counts = store.hit_counts(payloads([3, 4, 5]), stored).collect()
    assert [(r.hits, r.misses) for r in counts] == [(2, 1)]
    damaged = stored.withColumn("payload", F.when(F.col("id") == "3", "garbled").otherwise(F.col("payload")))
    broken = str(tmp_path / "broken")
    damaged.write.parquet(broken)
    assert [r.id for r in store.corrupted(spark.read.parquet(broken)).collect()] == ["3"]
    fixed = store.repair(spark, broken, str(tmp_path / "fixed"))
    assert sorted(r.id for r in fixed.collect()) == ["1", "2", "4"]
    assert store.corrupted(fixed).count() == 0


def test_fold_in_order(spark):
    import pandas as pd

    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 5)}", i, rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, seq bigint, x string").repartition(5)

    def fold(pdf):
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "text": ["".join(pdf["x"])]})

    def merge(pdf):
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "text": ["".join(pdf["text"])]})

    want = {}
    for key, _, x in rows:
        want[key] = want.get(key, "") + x
    got = extend.fold_in_order(df, ["key"], fold, merge, "key string, text string").collect()
    assert {r.key: r.text for r in got} == want

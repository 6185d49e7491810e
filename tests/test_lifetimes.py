"""Trees at many positions against one call for each."""

import random

from pyspark.sql import functions as F

from revlens.model import LINE
from revlens.operators import lifetimes, totals
from revlens.sources import tables


def some_log(make_log, seed=2, n=120):
    rng = random.Random(seed)
    revs = [dict(repo=f"r{i % 2}", branch=f"b{i % 3}", id=f"c{i}", seq=i * 3 - 50, date=i + 1, author="a", message="") for i in range(n)]
    names = [f"d/f{k}.{e}" for k in range(8) for e in ("c", "py")] + ["README", "x.unknownkind"]
    changes = [
        dict(repo=r["repo"], id=r["id"], path=p, lines_added=rng.randint(0, 5), lines_removed=rng.randint(0, 6), bytes_added=1, bytes_removed=1)
        for r in revs for p in rng.sample(names, rng.randint(0, 6))
    ]
    tags = [dict(repo=r["repo"], name=f"t{i}", id=r["id"]) for i, r in enumerate(revs) if i % 7 == 0] + [dict(repo="r0", name="again", id="c0"), dict(repo="r0", name="lost", id="nowhere")]
    return make_log(revisions=revs, file_changes=changes, tags=tags)


def test_trees_at_all_tags(spark, make_log):
    log = some_log(make_log)
    got = {}
    for r in lifetimes.trees_at(log, lifetimes.tag_positions(log)).collect():
        got.setdefault((r.repo, r.branch, r["at"], r.name), []).append(r.path)
    positions = [tuple(r) for r in lifetimes.tag_positions(log).collect()]
    assert len(positions) == 19
    trees = {at: {} for _, _, at, _ in positions}
    for at in trees:
        for r in tables.tree_from_changes(log, upto=at).collect():
            trees[at].setdefault((r.repo, r.branch), []).append(r.path)
    for repo, branch, at, name in positions:
        assert sorted(got.get((repo, branch, at, name), [])) == sorted(trees[at].get((repo, branch), []))


def test_languages_are_those_of_the_trees(spark, make_log):
    log = some_log(make_log, 5)
    positions = lifetimes.tag_positions(log)
    trees = lifetimes.trees_at(log, positions).withColumnRenamed("repo", "r").withColumn("repo", F.concat_ws("/", "r", "branch", "at", "name"))
    want = sorted((r.repo, r.language, r.n) for r in totals.files_by_language(trees).collect())
    got = sorted((f"{r.repo}/{r.branch}/{r['at']}/{r.name}", r.language, r.n) for r in lifetimes.languages_at(log, positions).collect())
    assert got == want and got


def test_lifetimes_do_not_overlap(spark, make_log):
    log = some_log(make_log, 9)
    spans = {}
    for r in lifetimes.lifetimes(log).collect():
        spans.setdefault((r.repo, r.branch, r.path), []).append((r.born, r.dead))
    for own in spans.values():
        own.sort()
        assert all(a[1] is not None and a[1] < b[0] for a, b in zip(own, own[1:], strict=False)) and all(d is None or d > b for b, d in own)
    now = {(r.repo, r.branch, r.path) for r in tables.tree_from_changes(log).select(*LINE, "path").collect()}
    assert now == {k for k, own in spans.items() if own[-1][1] is None}


def test_none(spark, make_log):
    log = some_log(make_log, n=0)
    assert lifetimes.trees_at(log, lifetimes.tag_positions(log)).collect() == [] == lifetimes.languages_at(log, lifetimes.tag_positions(log)).collect()

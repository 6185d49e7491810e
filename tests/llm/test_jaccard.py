"""Near-duplicates by five-word shingles against brute force."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from revlens.llm import jaccard, simhash
from tests.llm.conftest import words


def brute_set(text, n=5):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} or ({tuple(own)} if own else set())


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(texts):
    sets, root = [brute_set(x) for x in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        if near(sets[i], sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(rng, text, n):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = "edit%d" % rng.randrange(1 << 30)
    return " ".join(own)


def edited_texts():
    """Texts near the border on both sides, chains of edits, a group of near copies, a line that most have."""
    rng = random.Random(12)
    texts, line = [], " ".join(rng.choices(["one", "common", "line", "of", "words"], k=12))
    for _ in range(25):
        base = words(rng, rng.randint(15, 200))
        texts += [base, *(edited(rng, base, rng.randint(1, 1 + len(base.split()) // 30)) for _ in range(3))]
    chain = words(rng, 150)
    for _ in range(8):
        texts.append(chain := edited(rng, chain, 3))
    hot = words(rng, 60)
    texts += [edited(rng, hot, 1) for _ in range(60)]
    texts = [f"{line} {x}" if rng.random() < 0.6 else x for x in texts]
    return texts + [words(rng, k) for k in (1, 2, 4, 5, 6)] + ["short text", "Short  TEXT", "", None, texts[0], texts[0]]


def test_links_all_near_pairs_and_no_others(spark, monkeypatch):
    texts = edited_texts()
    groups = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    own = {i: (f, c) for i, f, c in jaccard.near_duplicates(df).collect()}
    assert [own[i][1] for i in range(len(texts))] == groups
    bits = [simhash.fingerprint((x or "").encode()) for x in texts]
    far = [(i, j) for i, j in combinations(range(len(texts)), 2) if near(brute_set(texts[i]), brute_set(texts[j])) and (bits[i] ^ bits[j]).bit_count() > 3]
    assert far and 1 < len(set(groups)) < len(texts)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df).collect()) == sorted(set(groups))


def test_pipeline_drops_what_five_words_tell(spark):
    """0.8 in five words, but more than three bits apart."""
    import corpus_pipeline

    rng = random.Random(3)
    base = words(rng, 120)
    texts = [base] + [edited(rng, base, 2) for _ in range(6)]
    groups = brute_groups(texts)
    bits = [simhash.fingerprint(x.encode()) for x in texts]
    assert set(groups) == {0} and any((bits[0] ^ b).bit_count() > 3 for b in bits)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.keep_one_of_each(spark, df, "").collect()] == [0]


def simhash_pairs(rng):
    """Texts of one fingerprint, or of two three bits apart at most, whose sets of five words are far from near."""
    line, tail = "one two three " * 40, [words(rng, 12) for _ in range(3)]
    texts = [line + x for x in tail] + [words(rng, 80), line + tail[0]]
    bits = [simhash.fingerprint(x.encode()) for x in texts]
    linked = [(i, j) for i, j in combinations(range(len(texts)), 2) if (bits[i] ^ bits[j]).bit_count() <= 3]
    assert any(not near(brute_set(texts[i]), brute_set(texts[j])) for i, j in linked)
    return texts, linked


def test_pipeline_links_what_simhash_links(spark):
    """SimHash's links hold in the stage, also where five words alone would not tell, and join its groups of near sets."""
    import corpus_pipeline

    rng = random.Random(5)
    texts, linked = simhash_pairs(rng)
    base = words(rng, 120)
    texts += [base, edited(rng, base, 2), edited(rng, base, 2)]
    root = brute_groups(texts)
    for i, j in linked:
        low, high = sorted((root[i], root[j]))
        root = [low if r == high else r for r in root]
    for ids in (range(len(texts)), [7] * len(texts)):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        found = jaccard.near_duplicates(df, radius=simhash.RADIUS).collect()
        kept = corpus_pipeline.keep_one_of_each(spark, df, "").collect()
        if len(set(ids)) > 1:
            assert [r["component_id"] for r in sorted(found)] == root
            assert sorted(r["doc_id"] for r in kept) == sorted(set(root))
        else:
            assert len(found) == len(texts) and {r["component_id"] for r in found} == {7}


def test_odd_rows(odd, empty, spark):
    rows, df = odd
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(brute_groups([x for _, x in rows])))
    assert jaccard.near_duplicates(empty).collect() == [] and jaccard.one_of_each(empty).collect() == []
    assert [tuple(r)[::2] for r in jaccard.near_duplicates(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, None)]


def test_large_buckets_are_compared_by_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7)
    texts = edited_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert [c for _, _, c in sorted(jaccard.near_duplicates(df).collect())] == brute_groups(texts)


@pytest.mark.parametrize("few", [0, 3, 1 << 11])
def test_sketches_never_differ_more_than_sets_and_blocks_find_all_close_ones(monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype="u8")) for n in (1, 5, 40, 100, 100, 300, 900) for _ in range(9)]
    sets += [np.unique(np.r_[x[: len(x) - 4], rng.integers(0, 1 << 62, 4, dtype="u8")]) for x in sets]
    drawn = [jaccard.sketch(x) for x in sets]
    key = np.sort(np.arange(len(sets)) % 63 % 3)
    sets = [sets[i] for i in np.argsort(np.arange(len(sets)) % 63 % 3, kind="stable")]
    drawn = [jaccard.sketch(x) for x in sets]
    n, sig = np.array([len(x) for x in sets]), np.arange(len(sets))
    one, two, far = jaccard.bucket_pairs(key, np.full(len(sets), -1), sig, sig, n, drawn)
    found = {(min(a, b), max(a, b)) for a, b in zip(one.tolist(), two.tolist(), strict=True)}
    for a, b in combinations(range(len(sets)), 2):
        gap = len(np.setxor1d(sets[a], sets[b]))
        x, y = jaccard._to_words([drawn[a]], len(drawn[b])), jaccard._to_words([drawn[b]], len(drawn[a]))
        bits = int(np.bitwise_count(x ^ y).sum())
        assert bits <= gap
        fits = 5 * n[a] >= 4 * n[b] and 5 * n[b] >= 4 * n[a]
        assert ((a, b) in found) == (key[a] == key[b] and fits and bits <= (n[a] + n[b]) // 9)
    assert found

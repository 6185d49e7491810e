"""op2, op8, op10 against brute force."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from revlens.llm import jaccard, merkle, simhash, suffixes
from tests.llm.conftest import words


def brute_print(text, words=3):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([" ".join(own)] if own else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def brute_groups(prints, radius=3):
    """Smallest index of each one's group."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def test_fingerprint(odd):
    for _, text in odd[0]:
        assert simhash.fingerprint((text or "").encode()) == brute_print(text or "")


def test_bit_planes_find_all_groups():
    rng = np.random.default_rng(1)
    for radius in (0, 1, 2, 3, 5):
        base = rng.integers(0, 1 << 63, 5, dtype="u8")
        values = {int(x) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 5)))) for x in rng.choice(base, 200)}
        values = np.array(sorted(values), "u8")
        keys = np.sort(rng.integers(0, 3, len(values)))
        a, b = simhash.bucket_links(keys, values, radius)
        label = np.arange(len(values))
        simhash.join(label, np.searchsorted(values, a), np.searchsorted(values, b))
        for k in set(keys.tolist()):
            own = np.flatnonzero(keys == k)
            wanted = brute_groups([int(x) for x in values[own]], radius)
            assert len({(label[i], w) for i, w in zip(own, wanted, strict=True)}) == len(set(label[own])) == len(set(wanted))


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def check_near(rows, found):
    prints = [brute_print(x or "") for _, x in rows]
    roots = brute_groups(prints)
    least = {}
    for (doc_id, _), root in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[root] = min(least.get(root, doc_id), doc_id)
    wanted = [(i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True)]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_op8_near_duplicates(odd, rows_of):
    rows, df = odd
    for bucket in (4096, 2):  # with the second, buckets are split in every round
        check_near(rows, rows_of(simhash.near_duplicates(df, bucket=bucket)))


def test_one_of_each_group_stays(odd, spark):
    rows, df = odd
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    groups = brute_groups([brute_print(x or "") for _, x in rows])
    assert kept.count() == len(set(groups))
    unique = [(i, x) for i, (_, x) in enumerate(rows)]
    own = simhash.one_of_each(spark.createDataFrame(unique, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in own.collect()) == sorted(set(groups))


def windows(texts, length):
    seen = {}
    for k, text in enumerate(texts):
        for at in range(len(text) - length + 1):
            seen.setdefault(text[at : at + length], []).append((k, at))
    return seen


def brute_repeats(texts, length, first_too):
    """Covered bytes of each text."""
    masks = [np.zeros(len(x), bool) for x in texts]
    for places in windows(texts, length).values():
        for k, at in places[0 if first_too else 1 :] if len(places) > 1 else []:
            masks[k][at : at + length] = True
    return masks


def test_anchors_and_suffix_order(monkeypatch):
    rng = random.Random(3)
    length, gram = 12, 5
    for t in range(60):
        texts = [bytes(rng.choices(b"ab" if t % 3 else b"abcdef", k=rng.randint(0, 60))) for _ in range(5)]
        monkeypatch.setattr(suffixes, "CHUNK", rng.choice([40, 1000]))
        monkeypatch.setattr(suffixes, "SEGMENT", rng.choice([7, 1000]))
        runs, anchor = [], {}
        for found in suffixes.Anchors(length, gram).of(texts):
            for k, first, n, name, _ in zip(*(x.tolist() for x in found), strict=True):
                runs.append((k, first, n))
                for at in range(first, first + n):
                    assert anchor.setdefault(texts[k][at : at + length], name) == name
        places = sorted((k, at) for k, first, n in runs for at in range(first, first + n))
        seen = windows(texts, length)
        assert places == sorted(x for own in seen.values() for x in own)
        runs.sort()
        if runs:
            again, before = (suffixes.resolve([texts[k][first : first + n + length - 1] for k, first, n in runs], length, x) for x in (True, False))
            for (k, first, n), a, b in zip(runs, again, before, strict=True):
                for i in range(n):
                    own = seen[texts[k][first + i : first + i + length]]
                    assert bool(np.unpackbits(np.frombuffer(a, "u1"))[i]) == (len(own) > 1)
                    assert bool(np.unpackbits(np.frombuffer(b, "u1"))[i]) == (own[0] != (k, first + i))


def test_op10_repeats(odd, rows_of):
    rows, df = odd
    texts = [(x or "").encode() for _, x in rows]
    wanted = []
    for (doc_id, _), text, mask in zip(rows, texts, brute_repeats(texts, 200, True), strict=True):
        edges = np.flatnonzero(np.diff(np.r_[False, mask].astype(int)) == 1)
        wanted.append((doc_id, len(text), int(mask.sum()), len(edges), hashlib.sha256(bytes(np.frombuffer(text, "u1")[~mask])).hexdigest()))
    for runs in (1 << 14, 1):  # with the second, windows are grouped by digests
        assert rows_of(suffixes.repeated_bytes(df, runs=runs)) == sorted(wanted, key=repr)


def test_first_copies_stay(spark, rows_of):
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdeé ", k=300))
    texts = ["".join(rng.choices("abcdeé ", k=n)) for n in (50, 400, 300, 0)]
    texts = [texts[0] + passage, texts[1], passage + texts[2], passage * 2, texts[1]]
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(texts)], "doc_id long, text string, n_chars long")
    for runs in (1 << 14, 1):
        found = rows_of(suffixes.without_repeats(df, runs=runs))
        assert [f[1] for f in found[:2]] == texts[:2]
        for (_, text, n), whole, mask in zip(found, texts, brute_repeats([x.encode() for x in texts], 200, False), strict=True):
            assert n == len(text)
            ends = np.cumsum([len(c.encode()) for c in whole])
            kept = [c for c, e in zip(whole, ends, strict=True) if not mask[e - len(c.encode()) : e].all()]
            assert text == "".join(kept)


def test_op2_fingerprints(odd, rows_of):
    rows, df = odd
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    texts, wanted = [x or "" for _, x in order], []
    for i, (doc_id, _) in enumerate(order):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        trees = [merkle.Tree.of(x) for x in (text, edited, following)]
        near = [merkle.likeness(trees[0], x) for x in trees[1:]]
        wanted.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(trees[0]), str(trees[1]), *near))
    for parts in (1, 7):
        assert rows_of(merkle.fingerprints(df, parts)) == sorted(wanted, key=repr)


def test_trees(odd):
    texts = sorted({x or "" for _, x in odd[0]})
    trees = [merkle.Tree.of(x) for x in texts]
    assert len({t.root for t in trees}) == len({str(t) for t in trees}) == len(texts)
    assert all(merkle.Tree.read(str(t)) == t for t in trees)
    long = max(texts, key=len)
    near = merkle.likeness(merkle.Tree.of(long), merkle.Tree.of(long.replace("the", "thee", 1)))
    assert 0.95 < near < 1
    gone, come = merkle.differing(merkle.Tree.of(long), merkle.Tree.of(long + " more words"))
    assert len(gone) <= 2 and 1 <= len(come) <= 3
    assert merkle.likeness(merkle.Tree.of(""), merkle.Tree.of("")) == 1 and merkle.likeness(merkle.Tree.of(""), merkle.Tree.of("a")) == 0


def test_empty_tables(empty, spark, rows_of):
    for made in (simhash.near_duplicates, suffixes.repeated_bytes, suffixes.without_repeats, merkle.fingerprints, simhash.one_of_each):
        assert made(empty).collect() == []
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert rows_of(simhash.near_duplicates(one)) == [(None, "0" * 16, None)]
    assert merkle.fingerprints(one).first()["near_next"] == 1


def test_many_rows_of_one_id_and_text(spark):
    """Their marks are gathered once, not once for each."""
    text = words(random.Random(4), 250)[:1500]
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text")).unionAll(spark.range(300).select(F.lit(None).cast("long"), F.lit(text)))
    found = suffixes.repeated_bytes(df).groupBy("n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in found] == [(len(text.encode()), 1, 3300)]


@pytest.mark.parametrize("repeated", [False, True])
def test_clashing_names(spark, repeated):
    rng = random.Random(5)
    passage = words(rng, 80)
    texts = [passage + " " + words(rng, 20), words(rng, 20) + " " + passage, words(rng, 30)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(1 if repeated else 9, texts[1])]
    names = "_gone _fp _id _print _key _own key own root sig h".split()
    df = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", *[F.lit("x").alias(c) for c in names], "text")
    plain = df.select("doc_id", "text")
    for made in (simhash.one_of_each, jaccard.one_of_each, suffixes.without_repeats):
        assert made(df).columns == df.columns
        assert sorted(map(tuple, made(df).select("doc_id", "text").collect())) == sorted(map(tuple, made(plain).collect()))

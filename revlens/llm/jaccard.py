"""Near-duplicate documents by the share of word shingles they have in common, exactly, without comparing all pairs.

Documents are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more. Then at most a
fifth of either set is missing in the other, which filters twice without losing a pair. First, of a fixed slice of
all shingles, those no other document has are counted: documents with more than a fifth of their set among them go.
Then the shingles of the rest are put in one order, rare ones first, and linked documents share one of the first
fifth and one more: they meet in a bucket. Copies of a set are one node and are never compared.

Each set has a sketch, the parity of its shingles in each of some bits, two to a shingle. Two sketches differ in no
more bits than the sets in shingles, so far ones are left out without losing a pair. First each set of a bucket is
compared with one hub, so that a large group of near copies is not squared. Then buckets whose sets are still in
several groups are compared within the task: bit planes of 64 sketches at a time, carry-save counters, and blocks
left early once all exceed what Jaccard 0.8 allows for their sizes. Of these, each set proposes the nearest one of
another group, and what is proposed is checked by whole sets and joins groups; last all pairs that are still near by
their sketches and in different groups. A bucket too large for a task is compared tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows, simhash
from revlens.session import written

WORDS = 5
#: Two sets are near if they share at least this part of their union: PARTS[0] / PARTS[1].
PARTS = (4, 5)
#: Shingles with a hash below this are counted in the first filter; the share must exceed 1 - 4/5.
SLICE = np.uint64(5 << 60)
#: Shingles of the slice that are gathered before they leave a task.
BATCH = 1 << 20
#: Sets of a bucket that one task compares; a larger bucket is compared by tiles of as many.
TILE = 1 << 13
#: Blocks of 64 sketches up to which single counts are cheaper than bit planes.
FEW = 1 << 11
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, no words: none."""
    own = text.translate(simhash.LOWER).split()
    if not own:
        return np.zeros(0, "u8")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), "u8", len(own))
    k = min(words, len(own))
    n = len(own) - k + 1
    out = np.full(n, k, "u8")
    for i in range(k):
        out = (out ^ (out >> np.uint64(31))) * _ODD[i % len(_ODD)] + hashes[i : i + n]
    out ^= out >> np.uint64(32)
    out *= _ODD[0]
    out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def sketch(own: np.ndarray) -> bytes:
    """Parities of the shingles by their hash, in a power of two of words, one for 32 shingles at least."""
    bits = 64 << max(0, -(-len(own) // 32) - 1).bit_length()
    odd = np.bincount((own & np.uint64(bits - 1)).astype("i8"), minlength=bits).astype("u1") & 1
    return np.packbits(odd, bitorder="little").tobytes()


def _spare(n: str):
    """How many of its n shingles a set's near ones may lack."""
    return F.floor(F.col(n) * (PARTS[1] - PARTS[0]) / F.lit(PARTS[1])).cast("int")


_FOUND = pa.schema([("h", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("m", pa.int32()), ("shared", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64())])
_KINDS = "h long, sig long, n int, m int, shared int, doc_id long, key long"


def _found(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.array(np.zeros(size, f.type.to_pandas_dtype())) for f in _FOUND], schema=_FOUND)


def _sliced(words: int):
    """A row for each document (n >= 0: shingles, m in the slice, shared: those another one here has), one for each
    shingle of the slice that one set here has (n = -1), and one for each that several have (n = -2)."""

    def done(held):
        sig = np.array([x[0] for x in held], "u8").view("i8")
        first = np.zeros(len(held), bool)
        first[np.unique(sig, return_index=True)[1]] = True
        own = [x[2] if f else x[2][:0] for x, f in zip(held, first, strict=True)]
        who = np.repeat(np.arange(len(held)), [len(x) for x in own])
        h = np.concatenate(own)
        order = np.argsort(h, kind="stable")
        h, who = h[order].view("i8"), who[order]
        start = np.r_[True, h[1:] != h[:-1]][: len(h)]
        single = start & np.r_[start[1:], True][: len(h)]
        shared = np.bincount(who[~single], minlength=len(held))
        spread = np.array([x[4] for x in held], "i8") ^ np.arange(len(held))  # copies and repeated ids go to many tasks
        yield _found(len(held), h=spread, sig=sig, n=[x[1] for x in held], m=[len(x[2]) for x in held], shared=shared, doc_id=[x[3] for x in held], key=[x[4] for x in held])
        alone, many = h[single], h[start & ~single]
        yield _found(len(alone), h=alone, sig=sig[who[single]], n=np.full(len(alone), -1))
        yield _found(len(many), h=many, n=np.full(len(many), -2))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in rows.slices(batches):
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), rows.blobs(batch.column(2)), strict=True):
                own = shingles(text, words)
                part = own[: np.searchsorted(own, SLICE)].copy()
                held.append((signature(own), len(own), part, doc_id, key))
                size += len(part) + 16
                if size >= BATCH:
                    yield from done(held)
                    held, size = [], 0
        if held:
            yield from done(held)

    return made


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of (h, sig): the documents' rows, and for each set how many of its shingles others have."""

    def runs(h, sig, n):
        start = np.r_[True, h[1:] != h[:-1]]
        run = np.cumsum(start) - 1
        one = n == -1
        new = one & np.r_[True, (h[1:] != h[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])]
        sets = np.bincount(run[new], minlength=run[-1] + 1) + 2 * np.bincount(run[~one], minlength=run[-1] + 1)
        found, times = np.unique(sig[new & (sets[run] > 1)], return_counts=True)
        return _found(len(found), sig=found, n=np.full(len(found), -1), shared=times)

    held = [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i4")]
    for batch in batches:
        n = batch.column(2).to_numpy()
        docs = batch.filter(pa.array(n >= 0))
        if docs.num_rows:
            yield pa.RecordBatch.from_arrays(docs.columns, schema=_FOUND)
        held = [np.r_[old, batch.column(i).to_numpy()[n < 0]] for i, old in enumerate(held)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last run may go on
        if cut:
            yield runs(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
    if len(held[0]):
        yield runs(*held)


def _sets(words: int):
    kinds = pa.schema([("sig", pa.int64()), ("n", pa.int32()), ("own", pa.binary()), ("sketch", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            out = []
            for sig, text in zip(batch.column(0).to_pylist(), rows.blobs(batch.column(1)), strict=True):
                own = shingles(text, words)
                if np.uint64(signature(own)).view("i8") == sig:  # else it is another text of that key
                    out.append((sig, len(own), own.tobytes(), sketch(own)))
            yield rows.batch({f.name: [r[i] for r in out] for i, f in enumerate(kinds)}, kinds)

    return made


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows.slices(batches, 256):
        own = [np.frombuffer(x, "i8") for x in batch.column(2).to_pylist()]
        sizes = [len(x) for x in own]
        if sizes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own)), pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), pa.array(np.repeat(batch.column(1).to_numpy(), sizes))], ["h", "sig", "n"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are near."""
    for batch in rows.slices(batches):
        near = []
        for one, two in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = np.sort(np.r_[np.frombuffer(one, "u8"), np.frombuffer(two, "u8")])
            common = int(np.count_nonzero(both[1:] == both[:-1]))
            near.append(PARTS[1] * common >= PARTS[0] * (len(both) - common))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(near, pa.bool_()))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sketches allow it."""
    for batch in rows.slices(batches):
        keep = []
        for n, m, one, two in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            x, y = _to_words([one], len(two)), _to_words([two], len(one))
            keep.append(int(np.bitwise_count(x ^ y).sum()) <= _apart(n + m))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _apart(sizes):
    """Shingles that two near sets of these sizes together differ in, at most."""
    return sizes * (PARTS[1] - PARTS[0]) // (PARTS[1] + PARTS[0])


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) that are near: by their sketches first, then by their whole sets."""
    one, two = (sets.select(F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    drawn = pairs.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
    alike = written(rows.mapped(drawn, _alike, "a long, b long"), "alike")
    one, two = (sets.select(F.col("sig").alias(k), F.col("own").alias(f"own_{k}")) for k in "ab")
    joined = alike.join(one, "a").join(two, "b").select("a", "b", "own_a", "own_b")
    return written(rows.mapped(joined, _near, "a long, b long"), "near")


def _fits(a: str, b: str):
    """Sizes of two sets that can be near."""
    return (F.col(a) * PARTS[1] >= F.col(b) * PARTS[0]) & (F.col(b) * PARTS[1] >= F.col(a) * PARTS[0])


def _to_words(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches of equal length as rows of words, folded to at most ``size`` bytes: parities of a smaller number of bits."""
    out = np.frombuffer(b"".join(sketches), "<u8").reshape(len(sketches), -1)
    while out.shape[1] * 8 > size:
        half = out.shape[1] // 2
        out = out[:, :half] ^ out[:, half:]
    return out


def _above(counters: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose count, in vertical bits, is greater than their word's radius."""
    more, same = np.zeros(len(radius), "<u8"), np.full(len(radius), simhash.FULL)
    for i in reversed(range(len(counters))):
        bit = np.uint64(0) - ((radius >> np.uint64(i)) & simhash.ONE)
        more |= same & counters[i] & ~bit
        same &= ~(counters[i] ^ bit)
    return more


def close(laid: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's sketch and a block of 64 (laid[block, lane, words]): those with hits, and the hits as bits."""
    at, over = np.arange(len(word)), ~valid[word]
    counters = [np.zeros(len(word), "<u8") for _ in range(max(1, int(radius.max(initial=0)).bit_length()))]
    radius, done = radius.astype("u8"), 0
    left = ~over
    while done < laid.shape[2] and len(at) > FEW:
        planes = simhash.planes_of(laid[:, :, done])
        for j in range(64):
            carry = planes[j][word] ^ (np.uint64(0) - ((query[:, done] >> np.uint64(j)) & simhash.ONE))
            for c in counters:
                c ^= carry
                carry &= ~c
            over |= carry
        left = ~(over | _above(counters, radius))
        open_ = left != 0
        if 2 * np.count_nonzero(open_) < len(open_):
            at, query, word, over, radius, left = at[open_], query[open_], word[open_], over[open_], radius[open_], left[open_]
            counters = [c[open_] for c in counters]
        done += 1
    if done < laid.shape[2]:  # few blocks are left: their lanes are counted one by one, from the first word on
        step = max(1, (1 << 21) // (64 * laid.shape[2]))
        for k in range(0, len(at), step):
            own = slice(k, k + step)
            far = np.bitwise_count(query[own, None, :] ^ laid[word[own]]).sum(axis=2, dtype="u8")
            near = np.packbits((far <= radius[own, None]).astype("u1"), axis=1, bitorder="little").view("<u8")[:, 0]
            left[own] &= near & valid[word[own]]
    found = np.flatnonzero(left)
    return at[found], left[found]


def bucket_pairs(key: np.ndarray, tile: np.ndarray, sig: np.ndarray, root: np.ndarray, n: np.ndarray, sketches: list[bytes]) -> tuple[np.ndarray, ...]:
    """(member, member, bits apart) within runs of equal keys: sketches near, sizes that fit, different groups and, in a
    key of two tiles, different tiles. A pair may come twice."""
    size = np.array([len(x) for x in sketches])
    out = []
    for width in np.unique(size):
        lanes = np.flatnonzero(size == width)
        asks = np.flatnonzero((size == width) | (size == 2 * width))
        lanes = lanes[np.lexsort((n[lanes], key[lanes]))]
        starts = np.flatnonzero(np.r_[True, key[lanes][1:] != key[lanes][:-1]])
        counts = np.diff(np.r_[starts, len(lanes)])
        blocks = -(-counts // 64)
        base = np.cumsum(blocks) - blocks
        group = np.repeat(np.arange(len(counts)), counts)
        place = base[group] * 64 + np.arange(len(lanes)) - starts[group]
        member = np.full(int(blocks.sum()) * 64, -1)
        member[place] = lanes
        laid = np.zeros((len(member), width // 8), "<u8")
        laid[place] = _to_words([sketches[i] for i in lanes], width)
        laid = laid.reshape(-1, 64, width // 8)
        valid = np.packbits((member >= 0).reshape(-1, 64).astype("u1"), axis=1, bitorder="little").view("<u8")[:, 0]
        sizes = np.where(member >= 0, n[member], 0).reshape(-1, 64)
        greatest, least = sizes.max(axis=1), np.where(member.reshape(-1, 64) >= 0, sizes, 1 << 40).min(axis=1)
        asked = np.zeros((len(key), width // 8), "<u8")
        for own in np.unique(size[asks]):
            of = asks[size[asks] == own]
            asked[of] = _to_words([sketches[i] for i in of], width)
        spot = np.searchsorted(key[lanes][starts], key[asks])
        there = np.where(spot < len(starts), key[lanes][starts][np.minimum(spot, len(starts) - 1)] == key[asks], False)
        asks, spot = asks[there], spot[there]
        times = blocks[spot]
        ends = np.cumsum(times)
        at = 0
        while at < len(asks):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + simhash.COMBOS, side="right")))
            per = times[at:stop]
            who = np.repeat(asks[at:stop], per)
            word = np.repeat(base[spot[at:stop]], per) + np.arange(len(who)) - np.repeat(np.cumsum(per) - per, per)
            fits = (PARTS[1] * n[who] >= PARTS[0] * least[word]) & (PARTS[1] * greatest[word] >= PARTS[0] * n[who])
            who, word = who[fits], word[fits]
            pair, hits = close(laid, valid, asked[who], word, _apart(n[who] + greatest[word]))
            which, lane = np.nonzero(np.unpackbits(hits.view("u1").reshape(-1, 8), axis=1, bitorder="little"))
            one, two = who[pair[which]], member[word[pair[which]] * 64 + lane]
            far = np.bitwise_count(asked[one] ^ laid.reshape(len(member), -1)[word[pair[which]] * 64 + lane]).sum(axis=1, dtype="i8")
            right = (sig[one] != sig[two]) & (root[one] != root[two]) & (far <= _apart(n[one] + n[two]))
            right &= (PARTS[1] * n[one] >= PARTS[0] * n[two]) & (PARTS[1] * n[two] >= PARTS[0] * n[one])
            right &= (tile[one] < 0) | (tile[one] != tile[two])
            out.append((one[right], two[right], far[right]))
            at = stop
    return tuple(np.concatenate([x[i] for x in out]) for i in range(3)) if out else (np.zeros(0, int),) * 3


def _met(nearest: bool):
    """Pairs (a, b) from rows in the order of their key; with ``nearest`` only each set's nearest one in its bucket."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(held: pa.Table) -> pa.RecordBatch:
        key, tile, sig, root, n = (held.column(c).to_numpy() for c in ("key", "tile", "sig", "root", "n"))
        one, two, far = bucket_pairs(key, tile, sig, root, n.astype("i8"), held.column("sketch").to_pylist())
        if nearest:
            both = np.r_[one, two], np.r_[two, one], np.r_[far, far]
            order = np.lexsort((sig[both[1]], both[2] / (n[both[0]] + n[both[1]]), both[0]))
            one, two = both[0][order], both[1][order]
            first = np.r_[True, one[1:] != one[:-1]][: len(one)]
            one, two = one[first], two[first]
        a, b = np.minimum(sig[one], sig[two]), np.maximum(sig[one], sig[two])
        ab = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], schema=schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            own = pa.Table.from_batches(held)
            key = own.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
            if cut:
                yield pairs(own.slice(0, cut))
                held = own.slice(cut).to_batches()
        if held and sum(b.num_rows for b in held):
            yield pairs(pa.Table.from_batches(held))

    return met


def _between(prefix: DataFrame, found: DataFrame, sets: DataFrame, nearest: bool) -> DataFrame:
    """Links (a, b) of near sets that share a bucket and that ``found`` leaves in different groups."""
    spark = prefix.sparkSession
    roots = written(simhash.components(found), "roots")
    placed = written(prefix.join(roots, prefix.sig == roots.node, "left").select("h", "sig", "n", F.coalesce("root", "sig").alias("root")), "placed")
    apart = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("c")).where("low < high")
    tiles = F.ceil(F.col("c") / TILE).cast("long")
    open_ = placed.join(apart.select("h", tiles.alias("tiles")), "h").join(sets.select("sig", "sketch"), "sig")
    tile = F.pmod(F.xxhash64("sig", F.lit(1)), F.col("tiles"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    spread = open_.withColumn("tile", tile).withColumn("other", other)
    # a key for each two tiles, ordered so that both sides have the same; rows of one tile are compared with each other
    spread = spread.withColumn("key", F.xxhash64("h", F.least("tile", "other"), F.greatest("tile", "other")))
    spread = spread.withColumn("tile", F.when(F.col("tile") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("tile")))
    dealt = spread.select("key", "tile", "sig", "root", "n", "sketch").repartition(rows.partitions(spark), "key").sortWithinPartitions("key", "sig")
    return _linked(rows.mapped(dealt, _met(nearest), "a long, b long"), sets)


def links(sets: DataFrame) -> DataFrame:
    """Links (a, b) between sets (sig, n, own, sketch) that join all groups of near ones."""
    each = written(rows.mapped(sets.select("sig", "n", "own"), _exploded, "h long, sig long, n int"), "shingles")
    common = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    shared = each.join(common, "h").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))  # as long as its text at most
    # Shingles that one set has come first and are in no bucket.
    take = F.lit(1) + _spare("n") - (F.col("n") - F.size("own"))
    first = shared.where(take > 0).select(F.explode(F.slice("own", F.lit(1), take)).alias("own"), "sig", "n")
    prefix = written(first.select(F.col("own.h").alias("h"), "sig", "n"), "prefixes")

    hubs = prefix.groupBy("h").agg(F.min(F.struct("sig", "n")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1")
    pairs = prefix.join(hubs.select("h", F.col("hub.sig").alias("a"), F.col("hub.n").alias("an")), "h")
    out = _linked(pairs.where((F.col("a") < F.col("sig")) & _fits("an", "n")).select("a", F.col("sig").alias("b")), sets)
    out = written(out.unionAll(_between(prefix, out, sets, True)), "nearest")
    return out.unionAll(_between(prefix, out, sets, False))


def by_prints(own: DataFrame, prints: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between sets (prints: key, sig) of texts (own: key, text) whose SimHash fingerprints, op8's, are equal
    or differ in ``radius`` bits at most."""
    bits = simhash.fingerprints(own.select(F.col("key").alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "fp")
    both = written(prints.select("key", "sig").distinct().join(bits.distinct(), "key").select("fp", "sig").distinct(), "both")
    first = written(both.groupBy("fp").agg(F.min("sig").alias("first")), "first")
    same = both.join(first, "fp").where("sig <> first").select(F.col("first").alias("a"), F.col("sig").alias("b"))
    one, two = (first.select(F.col("fp").alias(f"fp_{k}"), F.col("first").alias(k)) for k in "ab")
    near = simhash.links(first.select("fp"), radius).select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b"))
    return same.unionAll(near.join(one, "fp_a").join(two, "fp_b").select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int | None = None) -> DataFrame:
    """A row for each document: doc_id, fingerprint (hex, of its set), component_id (smallest doc_id that links reach).

    A null or empty text has the empty set, which is near to itself only. A null doc_id gets a row and never is a
    component's id unless all its ids are null. With a ``radius``, documents that SimHash links within as many bits
    are linked too, so that the groups are SimHash's, joined where its bits miss near sets.
    """
    spark = docs.sparkSession
    own = rows.id_text(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    dealt = rows.mapped(own, _sliced(words), _KINDS).repartition(rows.partitions(spark), "h").sortWithinPartitions("h", "sig", "n")
    found = written(rows.mapped(dealt, _counted, _KINDS), "slices")
    prints = found.where("n >= 0").select("doc_id", "key", "sig")
    # Copies in several tasks count a shared shingle more than once, which only keeps more sets.
    known = F.max("m") - F.sum("shared")
    sums = found.groupBy("sig").agg(F.max("n").alias("n"), known.alias("alone"), F.min(F.when(F.col("n") >= 0, F.col("key"))).alias("key"), F.min(F.when(F.col("n") >= 0, F.col("doc_id"))).alias("least"))
    classes = written(sums, "classes")
    some = classes.where((F.col("n") > 0) & (F.col("alone") <= _spare("n"))).select("sig", "key")
    texts = own.join(written(some, "some"), "key").select("sig", "text")
    sets = written(rows.mapped(texts, _sets(words), "sig long, n int, own binary, sketch binary").dropDuplicates(["sig"]), "sets")

    linked = links(sets) if radius is None else by_prints(own, prints, radius).unionAll(links(sets))
    groups = written(simhash.components(linked), "groups")
    rooted = groups.join(classes, groups.node == classes.sig).select("sig", "root", "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rooted.join(least, "root").select("sig", "component_id")
    single = classes.join(groups.select(F.col("node").alias("sig")), "sig", "left_anti").select("sig", F.col("least").alias("component_id"))
    ids = written(joined.unionAll(single), "components")
    return prints.join(ids, "sig").select("doc_id", F.lower(F.lpad(F.hex("sig"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int | None = None) -> DataFrame:
    """The documents, with all their columns, without near-duplicates; rows are told apart as in simhash.one_of_each."""
    return simhash.least_of_each(docs, near_duplicates(docs, words, radius), lambda text: signature(shingles(text, words)))

"""Near-duplicate documents by SimHash, compared bit plane by bit plane.

Fingerprints within ``RADIUS`` bits agree on at least two of five blocks of bits, so only those that share two
blocks meet. Where many share them, the rest of the bits is cut into four classes, of which one must agree too,
and so on, until a bucket is small; nothing is capped. In a bucket, fingerprints lie as bit planes, 64 to a
word: an exclusive-or of a plane with a query's bit gives one bit of 64 distances, bitwise counters add these up
with carry-save, and words whose distances all exceed the radius are left early. A bucket returns links to one
member of each of its groups, not all pairs; groups that overlap are joined over all buckets afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from revlens.llm import rows
from revlens.session import written

WORDS, SEED, RADIUS = 3, 42, 3
#: Fingerprints of a bucket that are compared with each other; larger buckets are split further.
BUCKET = 4096
COMBOS = 1 << 15
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's word shingles; no words: zero."""
    own = text.translate(LOWER).split()
    if not own:
        return 0
    if len(own) <= words:
        return xxhash.xxh64_intdigest(b" ".join(own), SEED)
    joined, n = b" ".join(own), len(own) - words + 1
    ends = list(accumulate(len(w) + 1 for w in own))
    cuts = map(slice, islice([0, *ends], n), [e - 1 for e in ends[words - 1 :]])
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED))
    counts = np.zeros(64, "int64")
    for at in range(0, n, 1 << 15):
        own_hashes = np.fromiter(islice(hashes, 1 << 15), "<u8", min(1 << 15, n - at))
        counts += np.unpackbits(own_hashes.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="int64")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of each row; a null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            bits = np.array([fingerprint(x, words) for x in rows.blobs(batch.column(1))], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view("<i8"))], schema=schema)

    return rows.mapped(rows.id_text(docs), made, "doc_id long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(radius: int) -> list[int]:
    """Masks of the first round: every two of radius + 2 blocks."""
    cuts = [round(i * 64 / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [a | b for a, b in combinations(blocks, 2)]


def _rounds(radius: int) -> list[list[int]]:
    """Masks of each round; in later ones radius + 1 classes of bits, dealt differently each time."""
    n = radius + 1
    deal = [lambda b: b % n, lambda b: b // n % n, lambda b: b // (n * n) % n]
    return [_blocks(radius), *([sum(1 << b for b in range(64) if of(b) == k) for k in range(n)] for of in deal)]


def planes_of(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints laid out 64 to a row: plane j has a word for each row."""
    return np.stack([np.packbits(((values >> np.uint64(j)) & ONE).astype("u1"), axis=1, bitorder="little").view("<u8")[:, 0] for j in range(64)])


def near(planes: np.ndarray, valid: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query and a word of 64 fingerprints: the pairs that have hits, and the hits as bits."""
    at = np.arange(len(query))
    counters = [np.zeros(len(query), "<u8") for _ in range(max(1, radius.bit_length()))]
    over = ~valid[word]
    for j in range(64):
        carry = planes[j][word] ^ (np.uint64(0) - ((query >> np.uint64(j)) & ONE))
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if j % 8 == 7:
            open_ = over != FULL
            if 2 * np.count_nonzero(open_) < len(open_):
                at, query, word, over = at[open_], query[open_], word[open_], over[open_]
                counters = [c[open_] for c in counters]
                if not len(at):
                    break
    more, same = np.zeros(len(at), "<u8"), np.full(len(at), FULL)
    for i in reversed(range(len(counters))):
        if radius >> i & 1:
            same &= counters[i]
        else:
            more |= same & counters[i]
            same &= ~counters[i]
    hits = ~(over | more)
    found = np.flatnonzero(hits)
    return at[found], hits[found]


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the members of each linked group the smallest label among them."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        differ = low < high
        if not differ.any():
            return
        np.minimum.at(label, high[differ], low[differ])
        while not (label[label] == label).all():
            label[:] = label[label]


def bucket_links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, member that stands for its group) within runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    per = -(-sizes // 64)
    base = np.cumsum(per) - per
    group = np.repeat(np.arange(len(sizes)), sizes)
    place = base[group] * 64 + np.arange(len(keys)) - starts[group]
    laid = np.zeros((int(per.sum()), 64), "<u8")
    laid.reshape(-1)[place] = values
    there = np.zeros(laid.shape, "u1")
    there.reshape(-1)[place] = 1
    planes, valid = planes_of(laid), np.packbits(there, axis=1, bitorder="little").view("<u8")[:, 0]
    label = np.arange(laid.size)
    times = per[group]
    ends = np.cumsum(times)
    at = 0
    while at < len(keys):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMBOS, side="right")))
        own, n = np.arange(at, stop), times[at:stop]
        member = np.repeat(own, n)
        word = base[group[member]] + np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n)
        pair, hits = near(planes, valid, values[member], word, radius)
        lanes = np.unpackbits(hits.view("u1").reshape(-1, 8), axis=1, bitorder="little")
        which, lane = np.nonzero(lanes)
        join(label, place[member[pair[which]]], word[pair[which]] * 64 + lane)
        at = stop
    root = label[place]
    linked = root != place
    return values[linked], laid.reshape(-1)[root[linked]]


def _links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, "<i8"), np.zeros(0, "<u8")

        def links(keys, values):
            a, b = bucket_links(keys, values, radius)
            return pa.RecordBatch.from_arrays([pa.array(x.view("<i8")) for x in (a, b)], schema=schema)

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            values = np.r_[values, batch.column(1).to_numpy().view("<u8")]
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last bucket may go on
            if cut:
                yield links(keys[:cut], values[:cut])
                keys, values = keys[cut:], values[cut:]
        if len(keys):
            yield links(keys, values)

    return linked


def links(classes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links between different fingerprints (column fp, distinct) that join all groups within ``radius`` bits."""
    spark = classes.sparkSession
    keyed, found = classes.select(F.lit(0).cast("long").alias("key"), "fp"), []
    rounds = _rounds(radius)
    for masks in rounds:
        keys = [F.xxhash64("key", F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for k, mask in enumerate(masks)]
        # Two keys with one hash only make a bucket larger: distances are always compared in full.
        keyed = keyed.select(F.explode(F.array(*keys)).alias("key"), "fp")
        sizes = written(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        small = sizes.where(F.col("n") <= bucket) if masks is not rounds[-1] else sizes
        own = keyed.join(small.select("key"), "key").repartition(rows.partitions(spark), "key").sortWithinPartitions("key", "fp")
        found.append(rows.mapped(own.select("key", "fp"), _links(radius), "a long, b long"))
        large = sizes.where(F.col("n") > bucket)
        if masks is rounds[-1] or large.isEmpty():
            break
        keyed = keyed.join(large.select("key"), "key")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node that can be reached.

    Rounds of large-star and small-star until nothing changes; each round is stored in the shared folder.
    """
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        digest = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(digest) == state or not digest[0]:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = tuple(digest)
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """A row for each document: doc_id, fingerprint (hex), component_id (smallest doc_id that links reach).

    A null or empty text has fingerprint zero and is linked like any other; equal fingerprints are one node, so
    copies are never compared. A null doc_id gets a row and never is a component's id unless all its ids are null.
    """
    prints = written(fingerprints(docs, words), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    groups = written(components(links(classes.select("fp"), radius, bucket)), "groups")
    rooted = groups.join(classes, groups.node == classes.fp).select("fp", "root", "least")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    joined = rooted.join(least, "root").select("fp", "component_id")
    alone = classes.join(groups.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    ids = written(joined.unionAll(alone), "components")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The documents, with all their columns, without near-duplicates: of each group the smallest doc_id stays.

    Where ids are null or occur more than once, rows are told apart by their fingerprints, and of rows that agree in
    both one stays.
    """
    return least_of_each(docs, near_duplicates(docs, words, radius, bucket), lambda text: fingerprint(text, words))


def least_of_each(docs: DataFrame, found: DataFrame, bits_of: Callable[[bytes], int]) -> DataFrame:
    """Of each group in ``found`` (doc_id, fingerprint, component_id) the smallest doc_id; ``bits_of`` gives a text's fingerprint."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    gone_id, own_print, kept_id, kept_print = (rows.unused(docs, name) for name in ("_gone", "_fp", "_id", "_print"))
    if ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        gone = written(found.where("doc_id <> component_id").select("doc_id"), "gone")
        return docs.join(gone.select(F.col("doc_id").alias(gone_id)), F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")
    schema, at = StructType([*docs.schema, StructField(own_print, LongType())]), docs.columns.index("text")

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            bits = np.array([bits_of(x) for x in rows.blobs(batch.column(at))], "<u8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view("<i8"))], [*batch.schema.names, own_print])

    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(kept_id), F.col("fingerprint").alias(kept_print)).distinct()
    own = rows.mapped(docs, marked, schema)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.lower(F.lpad(F.hex(own_print), 16, "0")) == F.col(kept_print))
    return own.join(written(kept, "kept"), same, "left_semi").dropDuplicates(["doc_id", own_print]).drop(own_print)

"""Passages that occur twice, by suffix order over the places where a repeat is possible.

Every window of ``LENGTH`` bytes has an anchor: the leftmost of its ``GRAM``-byte strings with the lowest hash.
Equal windows have equal anchors at equal places, so only windows whose anchor occurs twice can repeat. An
occurrence of an anchor stands for the run of windows that it anchors; equal runs are counted, not compared.
Different runs under one anchor are put in suffix order, where windows that repeat lie next to each other, and
previous and next smaller positions tell which of them have an earlier match. Windows never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows
from revlens.session import written

LENGTH, GRAM = 200, 64
#: Bytes that are hashed at a time, and the window starts taken at a time from a long text.
CHUNK, SEGMENT = 1 << 18, 1 << 18
#: Bytes of runs that are put in suffix order at a time, and runs of one anchor that fit.
BATCH, RUNS = 1 << 20, 1 << 14

_PLACE = np.uint64((1 << 24) - 1)
_MULTIPLY = 0x9E3779B97F4A7C15


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random value of each byte; powers of an odd number and of its inverse, modulo 2^64."""
    values = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype="u8")
    inverse = pow(_MULTIPLY, -1, 1 << 64)
    powers, inverses = np.full(n, _MULTIPLY, "u8"), np.full(n, inverse, "u8")
    powers[0] = inverses[0] = 1
    return values, np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


class Anchors:
    """Finds anchors in many texts at once."""

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.width = length, gram, length - gram + 1
        self.values, self.powers, self.inverses = _tables(CHUNK + SEGMENT + 2 * length)

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """Hash of the gram at each place."""
        sums = np.zeros(len(data) + 1, "u8")
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        n = len(data) - self.gram + 1
        own = (sums[self.gram :] - sums[:n]) * self.inverses[:n]
        own ^= own >> np.uint64(32)
        own *= np.uint64(0xD6E8FEB86659FD93)
        own ^= own >> np.uint64(29)
        return own

    def lowest(self, own: np.ndarray) -> np.ndarray:
        """For each window start the place of its anchor: blockwise running minima from both sides."""
        w, n = self.width, len(own) - self.width + 1
        keyed = np.full(-(-len(own) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
        keyed[: len(own)] = (own & ~_PLACE) | np.arange(len(own), dtype="u8")
        blocks = keyed.reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & _PLACE).astype("int64")

    def of(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, first window, windows, anchor hash, hash of the run) for every run of windows with one anchor."""
        held, size = [], 0
        for k, text in enumerate(texts):
            for at in range(0, max(0, len(text) - self.length + 1), SEGMENT):
                own = text[at : at + SEGMENT + self.length - 1]
                held.append((k, at, own))
                size += len(own)
                if size >= CHUNK:
                    yield self._runs(held)
                    held, size = [], 0
        if held:
            yield self._runs(held)

    def _runs(self, held):
        joined = b"".join(x[2] for x in held)
        sizes = np.array([len(x[2]) for x in held], "int64")
        starts = np.cumsum(sizes) - sizes
        own = self.hashes(np.frombuffer(joined, "u1"))
        anchor = self.lowest(own)
        part = np.repeat(np.arange(len(held)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) - starts[part] + self.length <= sizes[part]
        change = np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])]
        first = np.flatnonzero(inside & change)
        last = np.flatnonzero(inside & np.r_[change[1:] | ~inside[1:], True])
        n = last - first + 1
        ends = (last + self.length).tolist()
        digest = np.fromiter(map(xxhash.xxh3_64_intdigest, map(joined.__getitem__, map(slice, first.tolist(), ends))), "u8", len(first))
        of = part[first]
        offsets = np.array([x[1] for x in held], "int64")
        return np.array([x[0] for x in held], "int64")[of], first - starts[of] + offsets[of], n, own[anchor[first]].view("i8"), digest.view("i8")


def suffix_runs(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``starts`` (by ``length`` bytes, then by place), and where the next one matches in all of them.

    Ranks of 8 bytes are doubled until two of them, overlapping, cover the length.
    """
    padded = np.zeros(len(data) + 8, "u1")
    padded[: len(data)] = data
    rank = np.zeros(len(data), "u8")
    for i in range(8):
        rank = (rank << np.uint64(8)) | padded[i : i + len(data)]
    rank = np.unique(rank, return_inverse=True)[1].astype("u8")
    have = 8
    while 2 * have <= length:
        later = np.zeros(len(rank), "u8")
        later[:-have] = rank[have:] + np.uint64(1)
        rank = np.unique(rank * np.uint64(len(rank) + 2) + later, return_inverse=True)[1].astype("u8")
        have *= 2
    whole = rank[starts] * np.uint64(len(rank) + 2) + rank[starts + length - have]
    order = np.lexsort((starts, whole))
    return order, whole[order][1:] == whole[order][:-1]


def earlier(order: np.ndarray, match: np.ndarray) -> np.ndarray:
    """Which suffixes, in suffix order, have an earlier match: a smaller position before or after them in their run.

    ``order`` holds positions as ranks; ``match`` tells whether a suffix matches the next one.
    """
    run = np.r_[0, np.cumsum(~match)]
    n = len(order)
    before = np.minimum.accumulate(order - run * n)  # later runs are lower, so that minima start anew
    previous = np.r_[False, match & (before[:-1] + run[:-1] * n < order[1:])]
    back = np.minimum.accumulate((order + run * n)[::-1])[::-1]
    following = np.r_[match & (back[1:] - run[1:] * n < order[:-1]), False]
    return previous | following


def resolve(contexts: list[bytes], length: int, first_too: bool) -> list[bytes]:
    """For runs in the order of their places: which of their windows occur again (``first_too``), or earlier, as bits."""
    data = np.frombuffer(b"".join(contexts), "u1")
    sizes = np.array([len(x) for x in contexts], "int64")
    n = sizes - length + 1
    bases = np.cumsum(sizes) - sizes
    starts = np.repeat(bases - np.cumsum(n) + n, n) + np.arange(n.sum())
    order, match = suffix_runs(data, starts, length)
    marks = np.zeros(len(starts), bool)
    marks[order] = np.r_[match, False] | np.r_[False, match] if first_too else earlier(order, match)
    return [np.packbits(x).tobytes() for x in np.split(marks, np.cumsum(n)[:-1])]


def keyed(docs: DataFrame) -> DataFrame:
    """Documents with a key: the id, or a hash of the text where it is null. Texts of one key are told apart by their runs' hashes."""
    return rows.id_text(docs).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))


def occurrences(docs: DataFrame, length: int, gram: int, hash_only: bool = False) -> DataFrame:
    """A row for each run of windows with one anchor: anchor, run, key, at (first window * 256 + windows less 1)."""
    names = ["anchor"] if hash_only else ["anchor", "run", "key", "at"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in rows.slices(batches):
            key = batch.column(1).to_numpy()
            for text, first, n, anchor, run in anchors.of(rows.blobs(batch.column(0))):
                columns = [anchor] if hash_only else [anchor, run, key[text], (first << 8) | (n - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return rows.mapped(keyed(docs).select("text", "key"), found, ", ".join(f"{n} long" for n in names))


def _hash(passage: bytes) -> int:
    found = xxhash.xxh3_64_intdigest(passage)
    return found - (1 << 64) if found >> 63 else found


def _contexts(length: int):
    names = ["anchor", "run", "key", "at", "bytes"]
    kinds = pa.schema([(n, pa.int64()) for n in names[:4]] + [("bytes", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            out = [[], [], [], [], []]
            for text, key, wanted in zip(rows.blobs(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for own in wanted:
                    first, n = own["at"] >> 8, (own["at"] & 0xFF) + 1
                    passage = text[first : first + n + length - 1]
                    if _hash(passage) == own["run"]:  # else it is another text of that key
                        for column, x in zip(out, (own["anchor"], own["run"], key, own["at"], passage), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)

    return cut


def _resolved(length: int, first_too: bool):
    """Runs sorted by (anchor, key, at), whole anchors at a time, some MB together."""
    kinds = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("bits", pa.binary())])

    def done(anchor, run, contexts):
        bits = resolve(contexts, length, first_too)
        return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(run, pa.int64()), pa.array(bits, pa.binary())], schema=kinds)

    def suffix_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, run, contexts, size, group = [], [], [], 0, 0
        for batch in rows.slices(batches):
            for a, r, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if anchor and a != anchor[-1] and size >= BATCH:
                    yield done(anchor, run, contexts)
                    anchor, run, contexts, size = [], [], [], 0
                anchor.append(a)
                run.append(r)
                contexts.append(x)
                size += len(x)
        if anchor:
            yield done(anchor, run, contexts)

    return suffix_sorted


def _digests(length: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches, 64):
            out = [[], [], [], [], [], []]
            for a, r, k, at, x in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                for i in range(len(x) - length + 1):
                    own = x[i : i + length]
                    for column, y in zip(out, (a, r, k, (at >> 8) + i << 8, _hash(own), xxhash.xxh3_128_digest(own)), strict=True):
                        column.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(out)], ["anchor", "run", "key", "at", "single", "digest"])

    return made


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, first_too: bool = False, runs: int = RUNS) -> DataFrame:
    """Windows to remove: a row for each document with any: key, own = list of (at, run, bits; null bits: all its windows).

    ``first_too``: every window that occurs twice; otherwise the first occurrence, by key and place, stays.
    """
    spark = docs.sparkSession
    counts = occurrences(docs, length, gram, hash_only=True).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    twice = written(counts.where("n > 1").select("anchor"), "anchors")
    found = written(occurrences(docs, length, gram).join(twice, "anchor"), "occurrences")
    classes = written(found.groupBy("anchor", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "at")).alias("first")), "runs")
    mixed = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "mixed")

    # The bytes of one example of each run whose anchor has several runs.
    wanted = classes.join(mixed.select("anchor"), "anchor").select(F.col("first.key").alias("key"), F.struct("anchor", "run", F.col("first.at").alias("at")).alias("own"))
    lists = wanted.groupBy("key").agg(F.collect_set("own").alias("own"))  # as long as its text at most
    texts = keyed(docs).join(lists, "key").select("text", "key", "own")
    cut = written(rows.mapped(texts, _contexts(length), "anchor long, run long, key long, at long, bytes binary").dropDuplicates(["anchor", "run"]), "contexts")

    few = cut.join(mixed.where(F.col("d") <= runs).select("anchor"), "anchor")
    ordered = few.select("anchor", "run", "bytes", "key", "at").repartition(rows.partitions(spark), "anchor").sortWithinPartitions("anchor", "key", "at").select("anchor", "run", "bytes")
    bits = written(rows.mapped(ordered, _resolved(length, first_too), "anchor long, run long, bits binary"), "windows")
    large = mixed.where(F.col("d") > runs)
    plain = written(classes.join(bits, ["anchor", "run"], "left"), "plain")  # a table of its own, so that hot runs of the other side are split

    first = (F.col("first.key") == F.col("key")) & (F.col("first.at") == F.col("at"))
    whole = F.col("n") > 1 if first_too else ~first
    marked = found.join(plain, ["anchor", "run"]).where(whole | F.col("bits").isNotNull())
    marked = marked.select("key", F.struct("at", "run", F.when(~whole, F.col("bits")).alias("bits")).alias("own"))
    if not large.isEmpty():
        marked = marked.unionAll(_large(cut.join(large.select("anchor"), "anchor"), classes, length, first_too))
    return marked.groupBy("key").agg(F.collect_set("own").alias("own"))  # rows with one id and one text give the same marks


def _large(cut: DataFrame, classes: DataFrame, length: int, first_too: bool) -> DataFrame:
    """Anchors with more runs than one task puts in order: their windows are grouped by 128-bit digests instead."""
    kinds = "anchor long, run long, key long, at long, single long, digest binary"
    windows = written(rows.mapped(cut.select("anchor", "run", "key", "at", "bytes"), _digests(length), kinds), "digests")
    groups = windows.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("w"), F.min(F.struct("key", "at")).alias("least")).where("w > 1")
    own = windows.join(groups, ["anchor", "digest"])
    if first_too:
        own = own.join(classes.where("n = 1").select("anchor", "run"), ["anchor", "run"])  # the others are marked as a whole
    else:
        own = own.where((F.col("least.key") != F.col("key")) | (F.col("least.at") != F.col("at")))
    return own.select("key", F.struct("at", F.col("single").alias("run"), F.lit(None).cast("binary").alias("bits")).alias("own"))


def removed(text: bytes, own: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the marked windows cover."""
    if not own:
        return []
    starts = []
    for mark in own:
        first, n = mark["at"] >> 8, (mark["at"] & 0xFF) + 1
        if _hash(text[first : first + n + length - 1]) == mark["run"]:  # else it is another text of that key
            starts.append(first + (np.arange(n) if mark["bits"] is None else np.flatnonzero(np.unpackbits(np.frombuffer(mark["bits"], "u1"), count=n))))
    places = np.unique(np.concatenate(starts)) if starts else np.zeros(0, "int64")
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > length)
    return list(zip(places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + length).tolist(), strict=True))


def kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, first_too: bool = True, runs: int = RUNS) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty; texts shorter than ``length`` lose nothing. Rows with one id and one text are two
    occurrences of it; with ``first_too`` unset they both stay. Null ids are told apart by their texts.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            out = []
            for doc_id, text, own in zip(batch.column(0).to_pylist(), rows.blobs(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                spans = removed(text, own, length)
                out.append((doc_id, len(text), sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept(text, spans)).hexdigest()))
            yield rows.batch({f.name: [r[i] for r in out] for i, f in enumerate(schema)}, schema)

    joined = keyed(docs).join(repeats(docs, length, gram, first_too, runs), "key", "left").select("doc_id", "text", "own")
    return rows.mapped(joined, summed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, runs: int = RUNS) -> DataFrame:
    """Documents, with all their columns, without the passages that occurred earlier (by id, then place).

    Only whole characters inside a passage go; n_chars, where it is a column, follows. A document may end up empty.
    """
    names = docs.columns
    own_key, own_marks = rows.unused(docs, "_key"), rows.unused(docs, "_own")
    marks = repeats(docs, length, gram, False, runs).select(F.col("key").alias(own_key), F.col("own").alias(own_marks))
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))
    joined = docs.join(marks, key == F.col(own_key), "left").drop(own_key)
    schema, at, n_chars = docs.schema, names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            columns = batch.columns[:-1]
            texts, marks = columns[at].cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist()
            changed = [i for i, own in enumerate(marks) if own and texts[i]]
            if changed:
                sizes = columns[n_chars].to_pylist() if n_chars is not None else None
                for i in changed:
                    spans = [(_character(texts[i], a, 1), _character(texts[i], b, -1)) for a, b in removed(texts[i], marks[i], length)]
                    texts[i] = kept(texts[i], spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i].decode())
                columns[at] = pa.array(texts, pa.binary()).cast(columns[at].type)
                if sizes is not None:
                    columns[n_chars] = pa.array(sizes, columns[n_chars].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapped(joined, cut, schema)


def _character(text: bytes, at: int, step: int) -> int:
    """The next place, in the direction of ``step``, where a character begins or the text ends."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at += step
    return at

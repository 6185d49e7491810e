"""Documents that hold passages of benchmark items, by a prefix-filtered join on word shingles.

A window of an item occurs in a document only if all its shingles do, so the rarest one, by counts over all
documents, is prefix enough: only documents that have it, at a place where the window fits, are compared with
the window word by word. Items are taken in blocks of bounded size: each block's windows go to all executors,
and all documents pass by. Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows

WINDOW, SHINGLE = 10, 3
#: Text of the items that are looked for in one pass.
BLOCK_BYTES = 1 << 20

_KEPT = set(range(48, 58)) | set(range(97, 123)) | set(range(128, 256))
#: Lower case for A-Z; every other ASCII character that is no digit or letter parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEPT else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Windows:
    """The windows of a block of items, and their shingles as numbers."""

    def __init__(self, items: list[tuple[object, bytes]], window: int, shingle: int):
        split = [(name, own) for name, text in items if (own := words_of(text))]
        self.names = sorted({"null" if name is None else str(name) for name, _ in split})
        number = {name: k for k, name in enumerate(self.names)}
        self.words: dict[bytes, int] = {}
        holders: dict[tuple[int, ...], set[int]] = {}
        for name, own in split:
            ids = tuple(self.words.setdefault(w, len(self.words)) for w in own)
            n = min(window, len(ids))
            for at in range(len(ids) - n + 1):
                holders.setdefault(ids[at : at + n], set()).add(number["null" if name is None else str(name)])
        self.windows = sorted(holders, key=lambda w: (len(w), w))
        self.lengths = np.array([len(w) for w in self.windows], "int64")
        self.ids = np.full((len(self.windows), window), -2, "int32")
        for k, w in enumerate(self.windows):
            self.ids[k, : len(w)] = w
        self.items = [np.array(sorted(holders[w]), "int64") for w in self.windows]
        self.shingle = shingle
        #: For each shingle size, the shingles as numbers. Windows shorter than a shingle are their own.
        self.codes = {n: np.unique([c for w in self.windows if min(shingle, len(w)) == n for c in self.shingles(w, n)]) for n in {min(shingle, len(w)) for w in self.windows}}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def shingles(self, window: tuple[int, ...], n: int) -> list[int]:
        return [self.code(window[i : i + n]) for i in range(len(window) - n + 1)]

    def code(self, own: tuple[int, ...]) -> int:
        out = 0
        for x in own:
            out = out * len(self.words) + x
        return out

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's rarest shingle; of equal ones the smallest, at its first place."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, w in enumerate(self.windows):
            n = min(self.shingle, len(w))
            codes = self.shingles(w, n)
            at = min(range(len(codes)), key=lambda i: (counts.get((n, codes[i]), 0), codes[i], i))
            found.setdefault(n, []).append((codes[at], at, k))
        self.prefix = {n: tuple(np.array(x, "int64") for x in zip(*sorted(own), strict=True)) for n, own in found.items()}

    def numbered(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts one after the other, -1 for any other word and after each text; words of each text."""
        split = [words_of(x) for x in texts]
        sizes = np.array([len(x) for x in split], "int64")
        flat = chain.from_iterable(chain(x, (b"",)) for x in split)
        return np.fromiter(map(self.words.get, flat, repeat(-1)), "int32", int(sizes.sum()) + len(texts)), sizes

    def coded(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where n known words follow each other, and the numbers of these shingles."""
        if len(ids) < n:
            return np.zeros(0, "int64"), np.zeros(0, "int64")
        known = ids >= 0
        run = known[: len(ids) - n + 1].copy()
        for i in range(1, n):
            run &= known[i : len(ids) - n + 1 + i]
        at = np.flatnonzero(run)
        code = np.zeros(len(at), "int64")
        for i in range(n):
            code = code * len(self.words) + ids[at + i]
        return at, code

    def counted(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for n, codes in self.codes.items():
            own = self.coded(ids, n)[1]
            place = np.searchsorted(codes, own)
            place[place == len(codes)] = 0
            found = np.bincount(place[codes[place] == own], minlength=len(codes))
            yield n, codes, found

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) of every occurrence."""
        places, which = [], []
        for n, (codes, offsets, windows) in self.prefix.items():
            at, own = self.coded(ids, n)
            low, high = np.searchsorted(codes, own), np.searchsorted(codes, own, side="right")
            some = np.flatnonzero(high > low)
            for part in np.array_split(some, max(1, len(some) // 20_000)):
                times = high[part] - low[part]
                k = np.repeat(low[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
                window, start = windows[k], np.repeat(at[part], times) - offsets[k]
                fits = (start >= 0) & (start + self.lengths[window] <= len(ids))
                window, start = window[fits], start[fits]
                right = np.ones(len(window), bool)
                for i in range(self.ids.shape[1]):
                    inside = right & (i < self.lengths[window])
                    right[inside] = ids[start[inside] + i] == self.ids[window[inside], i]
                places.append(start[right])
                which.append(window[right])
        return (np.concatenate(places), np.concatenate(which)) if places else (np.zeros(0, "int64"), np.zeros(0, "int64"))

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], dict[int, set[str]]]:
        """Words of each text; for each text which words are hit; the items of the texts that have any."""
        ids, sizes = self.numbered(texts)
        place, window = self.occurrences(ids)
        edge = np.zeros(len(ids) + 1, "int64")
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.lengths[window], -1)
        starts = np.cumsum(sizes + 1) - sizes - 1
        covered = np.cumsum(edge[:-1]) > 0
        doc = np.searchsorted(starts, place, side="right") - 1
        found: dict[int, set[str]] = {}
        for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
            found.setdefault(d, set()).update(self.names[i] for i in self.items[w])
        return sizes, [covered[a : a + n] for a, n in zip(starts, sizes, strict=True)], found


def blocks(items: DataFrame, docs: DataFrame, window: int, shingle: int, size: int) -> Iterator:
    """Broadcast windows of one block of items after the other, their shingles counted over all documents."""
    spark = docs.sparkSession
    own = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    held: list[tuple[object, bytes]] = []
    rest = ((r["item_id"], r["text"].encode()) for r in own.toLocalIterator())
    for item in chain(rest, (None,)):
        if item is not None:
            held.append(item)
        if held and (item is None or sum(len(x[1]) for x in held) >= size):
            windows = Windows(held, window, shingle)
            held = []
            if windows.windows:
                windows.order(counts(docs, windows))
                yield spark.sparkContext.broadcast(windows)


def counts(docs: DataFrame, windows: Windows) -> dict[tuple[int, int], int]:
    """How often each of the windows' shingles occurs in all documents; summed in each task before it is sent."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        total = {n: np.zeros(len(codes), "int64") for n, codes in windows.codes.items()}
        for batch in rows.slices(batches):
            for n, _, found in windows.counted(windows.numbered(rows.blobs(batch.column(0)))[0]):
                total[n] += found
        for n, codes in windows.codes.items():
            some = total[n] > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), n, "int32")), pa.array(codes[some]), pa.array(total[n][some])], ["n", "code", "times"])

    made = rows.mapped(docs.select(F.col("text").cast("string").alias("text")), counted, "n int, code long, times long")
    return {(r["n"], r["code"]): r["t"] for r in made.groupBy("n", "code").agg(F.sum("times").alias("t")).collect()}  # a row for each shingle of the block at most


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words, items without words no windows. Items with one item_id count once. Equal
    windows of several items count for each of them. Without items nothing is hit. Repeated rows each get a row.
    """
    marked = rows.id_text(docs).select("doc_id", "text", F.lit(None).cast("binary").alias("hit"), F.lit(None).cast("array<string>").alias("items"))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])

    def marks(shared):
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows.slices(batches):
                _, covered, found = shared.value.hits(rows.blobs(batch.column(1)))
                hit, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for d, own in found.items():
                    bits = np.packbits(covered[d])
                    hit[d] = (bits | np.frombuffer(hit[d], "u1") if hit[d] else bits).tobytes()
                    names[d] = sorted(own.union(names[d] or ()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(hit, pa.binary()), pa.array(names, pa.list_(pa.string()))], schema=schema)

        return marked

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            n = [len(words_of(x)) for x in rows.blobs(batch.column(1))]
            hit = [int(np.unpackbits(np.frombuffer(x, "u1")).sum()) if x else 0 for x in batch.column(2).to_pylist()]
            names = [x or [] for x in batch.column(3).to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in names], pa.int64()), pa.array(digests, pa.string()), pa.array([x > 0 for x in hit])], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    def at_once(shared):
        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            empty = hashlib.sha256(b"").hexdigest()
            for batch in rows.slices(batches):
                sizes, covered, found = shared.value.hits(rows.blobs(batch.column(1)))
                hit, names, digests = np.zeros(len(sizes), "int64"), np.zeros(len(sizes), "int64"), [empty] * len(sizes)
                for d, own in found.items():
                    hit[d], names[d], digests[d] = covered[d].sum(), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(hit), pa.array(names), pa.array(digests, pa.string()), pa.array(hit > 0)], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return marked

    kinds = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    found = list(blocks(items, docs, window, shingle, block))
    if len(found) == 1:
        return rows.mapped(marked.select("doc_id", "text"), at_once(found[0]), kinds)
    for shared in found:  # documents pass through all blocks, one after the other, in one stage
        marked = rows.mapped(marked, marks(shared), "doc_id long, text string, hit binary, items array<string>")
    return rows.mapped(marked, summed, kinds)


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK_BYTES) -> DataFrame:
    """The documents, with all their columns, that hold no window of any item."""
    at = docs.columns.index("text")

    def kept(shared):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows.slices(batches):
                found = shared.value.hits(rows.blobs(batch.column(at)))[2]
                yield batch.filter(pc.invert(pa.array(np.isin(np.arange(batch.num_rows), list(found)))))

        return clean

    out = docs
    for shared in blocks(items, docs, window, shingle, block):
        out = rows.mapped(out, kept(shared), docs.schema)
    return out

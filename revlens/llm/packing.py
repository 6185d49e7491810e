"""Best-fit decreasing packing of token sequences.

Lengths are whole numbers up to the capacity, so documents of one length are alike: the driver packs counts by
length (at most ``capacity`` of them, whatever the input) and gets runs "these documents of this length go to
these sequences at this place". Each document then finds its run by its rank among those of its length. The
result is the one that packing document by document, longest first, into the tightest open sequence gives.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import rows, tokens
from revlens.session import written

CAPACITY = 2048

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64()), ("ids", pa.list_(pa.int32())),
    ]
)


class OpenBins:
    """Open sequences by what is left in them, under a segment tree that knows which remainders occur."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # (first sequence, how many)

    def put(self, left: int, first: int, count: int) -> None:
        if count and left:
            self.runs[left].append((first, count))
            self._mark(left, True)

    def take(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        if not self.runs[left]:
            self._mark(left, False)
        return run

    def _mark(self, left: int, there: bool) -> None:
        at = left + self.size
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest remainder of at least ``need``: up from its leaf to the first subtree on the right, then down."""
        at = need + self.size
        if self.any[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.any[at + 1]:
                at += 1
                break
            at //= 2
        if at <= 1:
            return None
        while at < self.size:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, place) for so many items of each length."""
    bins, runs, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, rest = 0, counts[length]
        while rest:
            left = bins.tightest(length)
            if left is None:
                left, each = capacity, capacity // length
                first, there = made, -(-rest // each)
                made += there
            else:
                each, (first, there) = left // length, bins.take(left)
            # A sequence that takes an item is the tightest for the next one of that length, until it is full.
            full, over = min(there, rest // each), 0
            if full < there:
                over = rest - full * each
            for i in range(each):
                if full:
                    runs.append((length, rank, full, first, capacity - left + i * length))
                    rank += full
            for i in range(over):
                runs.append((length, rank, 1, first + full, capacity - left + i * length))
                rank += 1
            bins.put(left - each * length, first, full)
            if over:
                bins.put(left - over * length, first + full, 1)
            used = full + bool(over)
            bins.put(left, first + used, there - used)
            rest -= full * each + over
    return runs


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` ids, stored; only longer documents are cut.

    A null or empty text is its end id alone; repeated rows are packed as often as they occur; a null doc_id stays.
    ``part`` and ``nth`` number the pieces of a length within the task that made them.
    """
    definition = tokens.vocabulary(docs.sparkSession, tokenizer)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, seen, part = tokens.words(tokens.LowerWords, definition, "I"), Counter(), TaskContext.get().partitionId()
        for batch in (x for whole in batches for x in tokens.portions(whole, 1)):
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), found.ids(batch.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    length = len(own) // 4
                    out.append((doc_id, k, at // 4, length, zlib.crc32(own), part, seen[length], np.frombuffer(own, "<i4") if with_ids else None))
                    seen[length] += 1
            yield rows.batch({f.name: [r[i] for r in out] for i, f in enumerate(PIECES)}, PIECES)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, ids array<int>"
    made = rows.mapped(rows.id_text(docs), cut, kinds, words=True)
    return written(made if with_ids else made.drop("ids"), "pieces")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. Columns part and nth go."""
    spark = made.sparkSession
    counts = written(made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    runs = np.array(best_fit(totals, capacity), dtype="int64").reshape(-1, 5)
    order = np.lexsort((runs[:, 1], runs[:, 0]))
    plan = spark.sparkContext.broadcast(runs[order])  # grows with the number of lengths, not of documents
    ranked = made.join(offsets, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        runs = plan.value
        # Runs in the order (length, first rank); the last one that begins at or before an item is its own.
        length, rank = length.to_numpy(), rank.to_numpy()
        low, high = np.searchsorted(runs[:, 0], length), np.searchsorted(runs[:, 0], length, side="right") - 1
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            right = open_ & (runs[middle, 1] <= rank)
            low, high = np.where(right, middle, low), np.where(open_ & ~right, middle - 1, high)
        own = runs[low]
        return pa.StructArray.from_arrays([pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], ["sequence_id", "offset"])

    return ranked.withColumn("at", place("length", "rank")).select(*[c for c in made.columns if c not in ("part", "nth")], "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces that carry them; at most ``capacity`` ids meet in a row."""
    own = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
    return own.select("sequence_id", F.flatten("own.ids").alias("ids"))

"""Text quality by a generalised additive model with pairwise interactions.

Each feature is cut into bins; boosting goes round the features, and each small tree on one feature adds its leaf
values to that feature's lookup table. Then the pairs of features that explain most of what is left get tables of
two dimensions in the same way. A score is the sum of one entry of each table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import features, rows

#: Labelled rows used for training at most.
SAMPLE = 20_000
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 32, 150, 10, 60, 0.1, 3
#: Rows whose crc32(doc_id as text) leaves this remainder are never learnt from.
PARTS, HELD_OUT = 3, 1


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _best_split(slope: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of neighbouring bins in two, and where the second part begins."""
    g, h = np.cumsum(slope)[:-1], np.cumsum(weight)[:-1]
    if not len(g):
        return 0.0, 0
    total, mass = slope.sum(), weight.sum()
    gain = g**2 / (h + 1) + (total - g) ** 2 / (mass - h + 1) - total**2 / (mass + 1)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def tree(slope: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """Leaf value of each bin, for a tree that splits the leaf with the largest gain."""
    parts = [(0, len(slope))]
    while len(parts) < leaves:
        found = [(_best_split(slope[a:b], weight[a:b]), a, b) for a, b in parts]
        (gain, at), a, b = max(found, key=lambda x: (x[0][0], -x[1]))
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(slope))
    for a, b in parts:
        out[a:b] = slope[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def quarters(slope: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a table in four by one cut of each axis: gain, and value of each cell."""
    g, h = slope.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(slope.shape)
    total, mass = g[-1, -1], h[-1, -1]

    def corners(x, whole):
        a = x[:-1, :-1]
        b, c = x[:-1, -1:] - a, x[-1:, :-1] - a
        return a, b, c, whole - a - b - c

    gain = sum(s**2 / (m + 1) for s, m in zip(corners(g, total), corners(h, mass), strict=True)) - total**2 / (mass + 1)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.zeros(slope.shape)
    for a, b in ((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))):
        out[a, b] = slope[a, b].sum() / (weight[a, b].sum() + 1)
    return float(gain[i, j]), out


@dataclass
class Additive:
    cuts: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, numbers: np.ndarray, label: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, pairs: int = PAIRS, pair_rounds: int = PAIR_ROUNDS) -> Additive:
        """With one class only, its rate for every text; without rows one half."""
        rate = (label.sum() + 0.5) / (len(label) + 1)
        cuts = [_cuts(column, bins) for column in numbers.T]
        model = cls(cuts, float(np.log(rate / (1 - rate))), [np.zeros(len(c) + 1) for c in cuts])
        if len(set(label.tolist())) < 2:
            return model
        placed = model.bins(numbers)
        score = np.full(len(label), model.base)

        def left():
            p = 1 / (1 + np.exp(-score))
            return label - p, p * (1 - p)

        for _ in range(rounds):
            for j, table in enumerate(model.tables):
                slope, weight = left()
                sums = [np.bincount(placed[:, j], x, len(table)) for x in (slope, weight)]
                step = RATE * tree(*sums, LEAVES)
                table += step
                score += step[placed[:, j]]
        for j, table in enumerate(model.tables):  # a table's mean belongs to the base
            mean = table[placed[:, j]].mean()
            table -= mean
            model.base += mean
        slope, weight = left()

        def sums(i, j, slope, weight):
            shape = len(model.tables[i]), len(model.tables[j])
            at = placed[:, i] * shape[1] + placed[:, j]
            return at, [np.bincount(at, x, shape[0] * shape[1]).reshape(shape) for x in (slope, weight)]

        gains = [(quarters(*sums(i, j, slope, weight)[1])[0], i, j) for i in range(len(cuts)) for j in range(i)]
        model.pairs = [(i, j) for gain, i, j in sorted(gains, key=lambda x: (-x[0], x[1:]))[:pairs] if gain > 0]
        model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
        for _ in range(pair_rounds):
            for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
                at, (g, h) = sums(i, j, *left())
                step = RATE * quarters(g, h)[1]
                table += step
                score += step.reshape(-1)[at]
        return model

    def bins(self, numbers: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, column, side="right") for c, column in zip(self.cuts, numbers.T, strict=True)])

    def score(self, numbers: np.ndarray) -> np.ndarray:
        placed = self.bins(numbers)
        total = np.full(len(numbers), self.base)
        for j, table in enumerate(self.tables):
            total += table[placed[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[placed[:, i], placed[:, j]]
        return 1 / (1 + np.exp(-total))


def held_out(doc_id: int | None) -> bool:
    """A null id is held out: nothing is learnt from it."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % PARTS == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Additive:
    """A model of labels.quality from at most ``bound`` labelled documents outside the held-out part."""
    learnt = labels.where(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % PARTS != HELD_OUT)
    data = features.described(features.sampled(docs, learnt, ["quality"], bound), ["quality"], False)
    return Additive.fit(data["numbers"], data["quality"])


def quality(docs: DataFrame, model: Additive) -> DataFrame:
    """A row for each document: doc_id, held_out, score, predicted.

    Null texts are empty; these get a score like any other. Repeated rows and null ids each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows.slices(batches):
            numbers = np.array([features.numbers(x) for x in rows.texts(batch.column(1))], "float64").reshape(-1, len(features.NAMES))
            score = shared.value.score(numbers)
            held = [held_out(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype("int32"))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapped(rows.id_text(docs), scored, "doc_id long, held_out boolean, score double, predicted int")

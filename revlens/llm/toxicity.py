"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other; each model sees the probabilities of those before it. It is
trained on out-of-fold probabilities, which are as uncertain as those it meets later. Features are the words and
word beginnings that tell most about the category, chosen within the rows a model is trained on, and numbers
about the text. Training rows are a bounded sample of the labelled ones; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm import features, rows

#: What labels tell, in the order of the chain.
CATEGORIES = ("low_quality", "toxic")
#: Labelled rows used for training at most, words of a model, folds.
SAMPLE, WORDS, FOLDS = 12_000, 1_000, 3
STEPS, PENALTY = 150, 2e-4


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Linear:
    words: np.ndarray  # word numbers, ascending
    weights: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    other: np.ndarray  # weights of numbers and earlier probabilities
    base: float

    @classmethod
    def fit(cls, words: list[np.ndarray], more: np.ndarray, label: np.ndarray, n_words: int) -> Linear:
        """Logistic regression by accelerated gradient steps. With one class only, its rate for every text."""
        rate = (label.sum() + 0.5) / (len(label) + 1)
        zero = np.zeros(more.shape[1])
        if len(set(label.tolist())) < 2:
            return cls(np.zeros(0, "int32"), np.zeros(0), zero, zero + 1, zero, float(_logit(np.array(rate)) if len(label) else -9.0))
        chosen = choose(words, label, n_words)
        middle, scale = more.mean(0), more.std(0) + 1e-6
        x = np.zeros((len(label), len(chosen) + more.shape[1] + 1), "float32")
        for i, own in enumerate(words):
            x[i, np.searchsorted(chosen, own[np.isin(own, chosen, assume_unique=True)])] = 1
        x[:, len(chosen) : -1] = np.clip((more - middle) / scale, -4, 4)
        x[:, -1] = 1
        w = np.zeros(x.shape[1], "float32")
        w[-1] = _logit(np.array(rate))
        ahead, momentum = w.copy(), 1.0
        step = 4 * len(label) / _largest(x)
        for _ in range(STEPS):
            slope = x.T @ (_sigmoid(x @ ahead) - label).astype("float32") / len(label) + np.float32(PENALTY) * ahead
            following = ahead - np.float32(step) * slope
            grown = (1 + (1 + 4 * momentum * momentum) ** 0.5) / 2
            ahead = following + np.float32((momentum - 1) / grown) * (following - w)
            w, momentum = following, grown
        k = len(chosen)
        return cls(chosen, w[:k].astype("float64"), middle, scale, w[k:-1].astype("float64"), float(w[-1]))

    def probability(self, words: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        """``words``: ascending word numbers of each text."""
        sizes = np.array([len(x) for x in words], "int64")
        total = np.zeros(len(words))
        if len(self.words) and sizes.sum():
            flat = np.concatenate(words)
            place = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            value = np.where(self.words[place] == flat, self.weights[place], 0.0)
            total = np.bincount(np.repeat(np.arange(len(words)), sizes), value, len(words))
        return _sigmoid(self.base + total + np.clip((more - self.middle) / self.scale, -4, 4) @ self.other)


def _largest(x: np.ndarray) -> float:
    """Largest eigenvalue of x'x, by power iteration, with some room."""
    v = np.ones(x.shape[1], "float32")
    size = 1.0
    for _ in range(12):
        v = x.T @ (x @ v)
        size = float(np.linalg.norm(v))
        v /= size
    return 1.1 * size


def choose(words: list[np.ndarray], label: np.ndarray, n: int) -> np.ndarray:
    """The word numbers whose presence is most surprising if it did not depend on the label."""
    flat, sizes = np.concatenate(words), [len(x) for x in words]
    yes = np.repeat(label > 0, sizes)
    a, b = np.bincount(flat[yes], minlength=features.SPACE), np.bincount(flat[~yes], minlength=features.SPACE)
    seen = np.flatnonzero(a + b >= 3)
    rate = label.mean()
    expected = (a + b)[seen] * rate
    order = np.lexsort((seen, -((a[seen] - expected) ** 2 / (expected * (1 - rate)))))
    return np.sort(seen[order[:n]]).astype("int32")


@dataclass
class Chain:
    names: tuple[str, ...]
    models: list[Linear]

    def probabilities(self, words: list[np.ndarray], numbers: np.ndarray) -> np.ndarray:
        """A column for each category."""
        more, out = numbers, []
        for model in self.models:
            out.append(model.probability(words, more))
            more = np.column_stack([more, _logit(out[-1])])
        return np.column_stack(out)


def fit(docs: DataFrame, labels: DataFrame, names: tuple[str, ...] = CATEGORIES, bound: int = SAMPLE, words: int = WORDS, folds: int = FOLDS) -> Chain:
    """A chain from at most ``bound`` labelled documents. ``labels``: doc_id and a column of 0 or 1 for each category."""
    data = features.described(features.sampled(docs, labels, list(names), bound), list(names), True)
    own, more = data["words"], data["numbers"]
    fold = np.arange(len(own)) % folds
    models = []
    for k, name in enumerate(names):
        label = data[name]
        models.append(Linear.fit(own, more, label, words))
        if k + 1 < len(names):
            unseen = np.zeros(len(own))
            for f in range(folds):
                train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                if len(test):
                    part = Linear.fit([own[i] for i in train], more[train], label[train], words)
                    unseen[test] = part.probability([own[i] for i in test], more[test])
            more = np.column_stack([more, _logit(unseen)])
    return Chain(tuple(names), models)


def label_columns(labels: DataFrame) -> DataFrame:
    """Chain categories from the table of labels: low quality, then toxicity."""
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


def described(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    words = [np.sort(np.fromiter(found, "int32", len(found))) for found in map(features.word_hashes, texts)]
    return words, np.array([features.numbers(x) for x in texts], "float64").reshape(-1, len(features.NAMES))


def toxicity(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """A row for each document: doc_id, p_<category> for each category, toxic (1 if the last one is at least ``threshold``).

    Null texts are empty and scored as such; repeated rows and null ids each get a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in rows.slices(batches):
            p = chain.probabilities(*described(rows.texts(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x) for x in p.T], pa.array((p[:, -1] >= threshold).astype("int32"))], ["doc_id", *[f"p_{n}" for n in chain.names], "toxic"])

    return rows.mapped(rows.id_text(docs), scored, "doc_id long" + "".join(f", p_{n} double" for n in chain.names) + ", toxic int")


def without_toxic(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """The documents, with all their columns, whose last category's probability is below ``threshold``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in rows.slices(batches):
            p = chain.probabilities(*described(rows.texts(batch.column(at))))
            yield batch.filter(pc.less(pa.array(p[:, -1]), threshold))

    return rows.mapped(docs, kept, docs.schema)

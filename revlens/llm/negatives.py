"""Hard negatives by a multiway tree of split points (GNAT), exact.

Inner products with an anchor become distances: every row gets one more component, which makes all rows equally long,
and the anchor a zero there. The more a row scores, the nearer it is, and a window of scores is an annulus. Each node
of the tree has split points; a row goes to the nearest one. A split point keeps the least and greatest distance from
itself to the rows below each of its siblings: if the distances that the annulus allows do not meet that range, the
sibling's rows need not be looked at. In the leaves, scores are exact whole numbers.

The upper tree's split points come from a bounded sample; all rows are sent down it, and the ranges hold for all rows.
The rows below each of its leaves are dealt to pages, each with a tree of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import rows, vectors
from revlens.session import written

#: Split points of a node, rows of a page's leaf, rows of the sample for the upper tree and the first bounds.
FAN, LEAF, SAMPLE = 8, 64, 8192
#: Levels of a tree at most; a leaf there may be larger.
DEEPEST = 100
NONE = np.iinfo(np.int64).min


class Space:
    """Whole-number vectors of one width; ``most`` is the greatest squared length."""

    def __init__(self, width: int, most: int):
        self.width, self.most = width, most
        # Sums of products are whole numbers below 2 ** 53, hence exact as doubles, unless the components are huge.
        self.kind = np.float64 if 4 * most < 2**53 else np.int64
        self.slack = 1e-6 * math.sqrt(most) + 1e-9

    def load(self, column: pa.Array) -> np.ndarray:
        return vectors.matrix(column, self.width).astype(self.kind)

    def squares(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)

    def scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x @ y.T).astype(np.int64)

    def extra(self, x: np.ndarray) -> np.ndarray:
        """The component that gives all rows the same length."""
        return np.sqrt(np.maximum(0.0, self.most - self.squares(x).astype(float)))

    def nearest(self, x: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Number of the nearest split point by whole-number distances: the same in every run."""
        return np.argmin(self.squares(splits) - 2 * (x @ splits.T), axis=1)

    def apart(self, x: np.ndarray, splits: np.ndarray) -> np.ndarray:
        """Distances of rows to split points."""
        flat = self.squares(x)[:, None] + self.squares(splits) - 2 * (x @ splits.T)
        return np.sqrt(np.maximum(0.0, flat + (self.extra(x)[:, None] - self.extra(splits)) ** 2))

    def reach(self, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance of an anchor of this squared length to a row of this score."""
        return np.sqrt(np.maximum(0.0, length + float(self.most) - 2.0 * score))


class Asks:
    """Windows of scores round anchors: each wants its k best rows of its own label, or of any other."""

    def __init__(self, space: Space, asks: pa.Table, same: bool, k: int):
        get = partial(vectors.whole, asks)
        self.same, self.k = same, k
        self.vectors, self.ids, self.label, self.twin = space.load(get("vector")), get("id").to_numpy(), get("label").to_numpy(), get("twin").to_numpy()
        low = get("low")
        self.anchor = np.repeat(np.arange(len(self.ids)), np.diff(low.offsets.to_numpy()))
        self.window = np.arange(len(self.anchor)) - np.searchsorted(self.anchor, self.anchor)
        self.low, self.high = low.flatten().to_numpy(), get("high").flatten().to_numpy()
        self.best = np.full((len(self.anchor), k), NONE)  # ascending: the k best scores found so far

    @property
    def least(self) -> np.ndarray:
        """Scores below it are of no use."""
        return np.maximum(self.low, self.best[:, 0])

    def look(self, own: np.ndarray, scores: np.ndarray, label: np.ndarray, ids: np.ndarray, keep: bool = True) -> tuple[np.ndarray, ...]:
        """Hits among rows: (ask, row, score), all that may be among the best; the best scores are brought up to date."""
        anchor = self.anchor[own]
        right = (label == self.label[anchor, None]) == self.same
        right &= ids != self.ids[anchor, None]
        right &= (scores >= self.least[own, None]) & (scores <= self.high[own, None])
        self.best[own] = np.sort(np.concatenate([self.best[own], np.where(right, scores, NONE)], axis=1), axis=1)[:, -self.k :]
        ask, row = np.nonzero(right)
        return own[ask], row, scores[ask, row]


class Tree:
    """Nodes of split points with their children (nodes, or leaves as ~number) and ranges[i, j]: from split i to the rows below j."""

    def __init__(self, space: Space, x: np.ndarray, leaf: int):
        self.space, self.splits, self.children, self.leaves = space, [], [], []
        self._grow(x, np.arange(len(x)), leaf, DEEPEST)
        self.low, self.high = [], []
        for splits in self.splits:
            self.low.append(np.full((len(splits), len(splits)), np.inf))
            self.high.append(np.full((len(splits), len(splits)), -np.inf))

    def _grow(self, x: np.ndarray, own: np.ndarray, leaf: int, levels: int) -> int:
        splits = self._choose(x[own]) if len(own) > leaf and levels else x[:0]
        if len(splits) < 2:
            self.leaves.append(own)
            return ~(len(self.leaves) - 1)
        node = len(self.splits)
        self.splits.append(splits)
        self.children.append([])
        to = self.space.nearest(x[own], splits)
        self.children[node] = [self._grow(x, own[to == j], leaf, levels - 1) for j in range(len(splits))]
        return node

    def _choose(self, x: np.ndarray) -> np.ndarray:
        """Split points far from each other: each next one is the farthest from those before, of a spread of rows."""
        spread = x[np.linspace(0, len(x) - 1, min(len(x), 4 * FAN)).astype(int)]
        chosen = [0]
        far = self.space.apart(spread, spread)
        while len(chosen) < FAN:
            gap = far[:, chosen].min(axis=1)
            if gap.max() <= self.space.slack:
                break
            chosen.append(int(gap.argmax()))
        return np.unique(spread[chosen], axis=0)

    def send(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row; the ranges on its way are widened to hold it."""
        leaf = np.zeros(len(x), np.int64)
        todo = [(0 if self.splits else ~0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if node < 0 or not len(own):
                leaf[own] = ~node if node < 0 else 0
                continue
            to, apart = self.space.nearest(x[own], self.splits[node]), self.space.apart(x[own], self.splits[node])
            for j, child in enumerate(self.children[node]):
                below = to == j
                if below.any():
                    self.low[node][:, j] = np.minimum(self.low[node][:, j], apart[below].min(axis=0))
                    self.high[node][:, j] = np.maximum(self.high[node][:, j], apart[below].max(axis=0))
                    todo.append((child, own[below]))
        return leaf

    def open(self, node: int, asks: Asks, own: np.ndarray) -> np.ndarray:
        """Of the asks ``own``, which (rows) may find something below which child (columns)."""
        anchor, at = np.unique(asks.anchor[own], return_inverse=True)
        x, splits = asks.vectors[anchor], self.splits[node]
        length = self.space.squares(x).astype(float)
        apart = self.space.reach(length[:, None], x @ splits.T)[at]
        length = length[at]
        inner, outer = self.space.reach(length, asks.high[own].astype(float)), self.space.reach(length, asks.least[own].astype(float))
        least = np.maximum(apart - outer[:, None], inner[:, None] - apart) - self.space.slack
        most = apart + outer[:, None] + self.space.slack
        meets = (self.low[node] <= most[:, :, None]) & (self.high[node] >= least[:, :, None])
        return meets.all(axis=1) & (self.low[node][0] < np.inf) & (asks.least[own] <= asks.high[own])[:, None]


class Page:
    def __init__(self, space: Space, page: pa.Table):
        get = partial(vectors.whole, page)
        ids = get("id")
        self.space, self.x, self.label = space, space.load(get("vector")), get("label").to_numpy()
        self.null, self.ids = ids.is_null().to_numpy(zero_copy_only=False), vectors.longs(ids)
        self.tree = Tree(space, self.x, LEAF)
        self.tree.send(self.x)

    def search(self, asks: Asks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ask, row, score) of the best rows of this page."""
        hits = []
        todo = [(0 if self.tree.splits else ~0, np.arange(len(asks.anchor)))]
        while todo:
            node, own = todo.pop()
            if node >= 0:
                opened = self.tree.open(node, asks, own)
                # The last one pushed is searched first: children that most asks must open come first and raise the bounds.
                todo += [(self.tree.children[node][j], own[opened[:, j]]) for j in np.argsort(opened.sum(axis=0), kind="stable") if opened[:, j].any()]
                continue
            at = self.tree.leaves[~node]
            anchor, of = np.unique(asks.anchor[own], return_inverse=True)
            scores = self.space.scores(asks.vectors[anchor], self.x[at])[of]
            ids = np.where(self.null[at], NONE, self.ids[at])
            ask, row, score = asks.look(own, scores, self.label[at], ids)
            hits.append((ask, at[row], score))
        ask, row, score = (np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, int) for i in range(3))
        order = np.lexsort((self.ids[row], -score, ask))
        ask, row, score = ask[order], row[order], score[order]
        first = np.arange(len(ask)) - np.searchsorted(ask, ask) < asks.k
        return ask[first], row[first], score[first]


HITS = "id long, twin long, window int, found long, score long"
_HITS = pa.schema([("id", pa.int64()), ("twin", pa.int64()), ("window", pa.int32()), ("found", pa.int64()), ("score", pa.int64())])
ROW = "id long, label long, vector array<double>"


class Index:
    """The upper tree over all rows (id, label, vector of whole numbers), and the first page of each of its leaves."""

    def __init__(self, data: DataFrame):
        self.data, self.spark = data, data.sparkSession
        squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
        facts = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(squares).alias("most")).first()
        self.n = facts["n"]
        space = self.space = Space(max(1, facts["width"] or 1), int(facts["most"] or 0))
        sample = data.where("id is not null").orderBy(F.xxhash64("id", "vector"), "label").limit(SAMPLE).toArrow()
        self.known = Page(space, sample)
        tree = self.tree = Tree(space, self.known.x, max(1, math.ceil(len(self.known.x) * vectors.PAGE / max(1, self.n))))
        shared = self.spark.sparkContext.broadcast(tree)

        def facts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Ranges (node, i, j, low, high) and counts (-1, leaf, 0) of a task's rows."""
            own, counts = shared.value, np.zeros(len(tree.leaves), np.int64)
            for batch in rows.slices(batches, vectors.PAGE):
                counts += np.bincount(own.send(space.load(batch.column("vector"))), minlength=len(counts))
            lines = [(-1, leaf, 0, 0.0, 0.0, int(n)) for leaf, n in enumerate(counts) if n]
            for node, low in enumerate(own.low):
                lines += [(node, int(i), int(j), low[i, j], own.high[node][i, j], 0) for i, j in np.argwhere(low < np.inf)]
            names = ["node", "i", "j", "low", "high", "n"]
            schema = pa.schema([(c, pa.float64() if c in ("low", "high") else pa.int64()) for c in names])
            if lines:
                yield rows.batch(dict(zip(names, zip(*lines, strict=True), strict=True)), schema)

        each = rows.mapped(data, facts_of, "node long, i long, j long, low double, high double, n long")
        counts = [0] * len(tree.leaves)
        for r in each.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():  # bounded by the tree
            if r["node"] < 0:
                counts[r["i"]] = r["n"]
            else:
                tree.low[r["node"]][r["i"], r["j"]], tree.high[r["node"]][r["i"], r["j"]] = r["low"], r["high"]
        pages = [math.ceil(n / vectors.PAGE) for n in counts]
        self.pages, self.first = pages, [sum(pages[:i]) for i in range(len(pages))]
        self.shared = self.spark.sparkContext.broadcast((tree, self.known))

    def dealt(self) -> DataFrame:
        """Rows with the page they lie in: rows of a leaf are dealt to its pages at random."""
        shared, space, pages, first = self.shared, self.space, np.array(self.pages), np.array(self.first)
        schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64())), ("page", pa.int64())])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = shared.value[0]
            for batch in rows.slices(batches, vectors.PAGE):
                leaf = tree.send(space.load(batch.column("vector")))
                page = first[leaf] + batch.column("salt").to_numpy() % pages[leaf]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(page)], schema=schema)

        salted = self.data.withColumn("salt", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(1 << 40)))
        return rows.mapped(salted, placed, ROW + ", page long")

    def asks(self, wanted: DataFrame, same: bool, k: int) -> DataFrame:
        """A row for each page that may hold some of the k best of an anchor's windows; the sample gives the first bounds.

        ``wanted``: id, twin, label, vector and arrays low, high of scores.
        """
        shared, space, pages, first = self.shared, self.space, self.pages, self.first
        names = ["id", "twin", "label", "vector", "low", "high"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        schema = pa.schema([*zip(names, kinds, strict=True), ("page", pa.int64())])

        def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, known = shared.value
            for batch in rows.slices(batches, vectors.CHUNK):
                own = Asks(space, pa.Table.from_batches([batch.select(names)]), same, k)
                known.search(own)
                to: list[tuple[int, np.ndarray]] = []
                todo = [(0 if tree.splits else ~0, np.arange(len(own.anchor)))]
                while todo:
                    node, of = todo.pop()
                    if node < 0:
                        to.append((~node, np.unique(own.anchor[of])))
                        continue
                    opened = tree.open(node, own, of)
                    todo += [(child, of[opened[:, j]]) for j, child in enumerate(tree.children[node]) if opened[:, j].any()]
                offsets = np.searchsorted(own.anchor, np.arange(len(own.ids) + 1))
                bounds = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(own.least))
                for leaf, anchors in to:
                    part = batch.select(names).set_column(4, "low", bounds).take(pa.array(anchors))
                    for page in range(first[leaf], first[leaf] + pages[leaf]):
                        yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(part.columns, kinds, strict=True)), pa.array(np.full(len(anchors), page))], schema=schema)

        return rows.mapped(wanted.select(*names), sent, "id long, twin long, label long, vector array<double>, low array<long>, high array<long>, page long")

    def best(self, wanted: DataFrame, same: bool, k: int) -> DataFrame:
        """id, twin, window, rank (from 1), found, score: the k best rows of each window, ties to the smaller id."""
        space = self.space

        def opened(page: pa.Table) -> Page:
            return Page(space, page)

        def asked(page: Page, chunk: pa.Table) -> Iterator[pa.RecordBatch]:
            asks = Asks(space, chunk, same, k)
            ask, row, score = page.search(asks)
            of = asks.anchor[ask]
            columns = [pa.array(asks.ids[of]), pa.array(asks.twin[of]), pa.array(asks.window[ask], pa.int32()), vectors.nullable(page.ids[row], page.null[row]), pa.array(score)]
            if len(ask):
                yield pa.RecordBatch.from_arrays(columns, schema=_HITS)

        hits = vectors.meetings(self.dealt(), self.asks(wanted, same, k), opened, asked, HITS)
        order = Window.partitionBy("id", "twin", "window").orderBy(F.desc("score"), F.asc_nulls_last("found"))
        return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relabelled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): labels of ids divisible by 7 are one off."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.alias("label"), "embedding")


def hard_negatives(points: DataFrame, anchors: DataFrame, positives: int = 5, k: int = 10) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score, positive_rank.

    Both tables have vec_id, label and embedding; other columns are left out. A component x counts as floor(256 * x),
    a score is the inner product with the anchor; higher ones come first, ties to the smaller vec_id, null ids last.
    An anchor's positives are its first rows of the same label. For each, the first k rows of other labels whose score
    is 0.3 to 0.9 of the positive's. With fewer rows there are fewer results, and none for an empty table.

    Rows with a null label, a null vector, or a null or non-finite component take no part, nor do anchors with a null
    vec_id. A shorter vector counts as one that ends in zeros. Rows with the anchor's own vec_id are left out; rows
    repeated under another id are rows of their own; a repeated anchor answers once for each label and vector.
    Scores are 64-bit. The sample only bounds the search: the result is exact.
    """
    takes_part = F.col("label").isNotNull() & vectors.finite("embedding")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    typed = [F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole.alias("vector")]
    index = Index(points.where(takes_part).select(*typed))
    twin = F.xxhash64("label", "vector").alias("twin")
    own = anchors.where(takes_part & F.col("vec_id").isNotNull()).select(*typed).select("id", twin, "label", "vector").distinct()
    own = written(own.repartitionByRange(F.xxhash64("id")), "anchors")
    every = [F.array(F.lit(x).cast("long")).alias(c) for c, x in (("low", NONE + 1), ("high", vectors.LAST))]
    found = written(index.best(own.select("*", *every), True, positives), "positives")
    score = F.transform("p", lambda p: p["score"])
    listed = found.groupBy("id", "twin").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "found"))).alias("p"))  # at most ``positives``
    low = F.transform(score, lambda s: F.ceil(s.cast("decimal(25,0)") * 30 / 100).cast("long"))
    high = F.transform(score, lambda s: F.floor(s.cast("decimal(25,0)") * 90 / 100).cast("long"))
    windows = own.join(listed, ["id", "twin"]).select("id", "twin", "label", "vector", low.alias("low"), high.alias("high"))
    negatives = index.best(windows, False, k).select("id", "twin", (F.col("window") + 1).alias("positive_rank"), "rank", F.col("found").alias("negative_id"), F.col("score").alias("negative_score"))
    with_positive = found.select("id", "twin", F.col("rank").alias("positive_rank"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(with_positive, ["id", "twin", "positive_rank"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")

"""Approximate nearest neighbours by counting collisions on single projections.

Rows are dealt to pages. A page keeps, for each of LINES projections, its rows sorted by their place on that line. A
query opens a window round its own place on every line; a row in the window of a line collides there. Windows grow
with the radius searched (virtual rehashing: the arrays stay, only the window's borders move on), collisions are
counted as rows enter, and a row that collides on a SHARE of all lines is verified by its distance. The radius ends
at the k-th distance known: first that among a sample of rows, then that among the page's verified rows.

Lines are drawn in orthogonal sets, since a neighbour's gaps on them then add up to its distance, which makes counts
steadier than independent ones. A row at the last radius collides on a line with a probability of 0.77 (WIDTH 1.2).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm import rows, vectors
from revlens.session import written

LINES, WIDTH, SHARE = 64, 1.2, 0.7
#: Radii of the rounds, as parts of the last one.
RADII = np.array([0.85, 0.93, 1.0])
#: Rows, the least by a hash of id and vector, that give each query its first radius.
SAMPLE = 4096
#: A query that found less than k points looks again, this much farther; at last everywhere.
WIDER = (1.2, 1.5, 2.0)


def lines(width: int, seed: int = 7) -> np.ndarray:
    """Directions, as rows, of length sqrt(width): the gap of two points on one has their distance as its mean square root."""
    rng = np.random.default_rng(seed)
    sets = [np.linalg.qr(rng.normal(size=(width, width)))[0].T for _ in range(math.ceil(LINES / width))]
    return np.concatenate(sets)[:LINES] * math.sqrt(width)


def distances(vectors_: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors_ - query) ** 2).sum(axis=1))


class Page:
    """Sorted arrays of one page: on each line the rows by their place, and the places."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, vectors_: np.ndarray, along: np.ndarray):
        self.ids, self.null, self.vectors = ids, null, vectors_
        places = vectors_ @ along.T
        self.order = np.argsort(places, axis=0, kind="stable").T.copy()
        self.places = np.take_along_axis(places.T, self.order, axis=1)
        self.along = along

    def search(self, own: np.ndarray, queries: np.ndarray, last: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: its number, and the rows found with their distances, at most k."""
        centres = queries @ self.along.T
        half = WIDTH * last[:, None] * RADII
        edges = []
        for line, places in enumerate(self.places):
            at = centres[:, line, None]
            edges.append((np.searchsorted(places, at - half, "left"), np.searchsorted(places, at + half, "right")))
        low, high = (np.stack([e[i] for e in edges], axis=2) for i in (0, 1))  # query, radius, line
        enough = math.ceil(SHARE * len(self.along))
        for q in range(len(queries)):
            count = np.zeros(len(self.ids), np.int64)
            mine = ~self.null & (self.ids == own[q])
            done, found, gaps, end = mine.copy(), np.zeros(0, int), np.zeros(0), last[q]
            before_low, before_high = high[q, 0], high[q, 0]
            for r, part in enumerate(RADII):
                pieces = [order[a:b] for order, a, b in zip(self.order, low[q, r], before_low, strict=True)]
                pieces += [order[a:b] for order, a, b in zip(self.order, before_high, high[q, r], strict=True)]
                before_low, before_high = low[q, r], high[q, r]
                count += np.bincount(np.concatenate(pieces), minlength=len(count))
                new = np.flatnonzero((count >= enough) & ~done)
                done[new] = True
                gap = distances(self.vectors[new], queries[q])
                near = gap <= end
                found, gaps = np.concatenate([found, new[near]]), np.concatenate([gaps, gap[near]])
                if len(found) > k:
                    best = vectors.least(gaps, self.ids[found], k)
                    found, gaps = found[best], gaps[best]
                if len(found) == k:
                    end = min(end, gaps.max())
                if last[q] * part >= end:
                    break
            yield q, found, gaps


def nearest(points: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k points that were found nearest to each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    Both tables have vec_id and embedding; other columns are left out. Nearest first, ties to the smaller vec_id, null
    ids last. Rows with a null or zero vector, or with a null or non-finite component, take no part. A shorter vector
    counts as one that ends in zeros. Points with the query's own id are left out; rows repeated under another id are
    points of their own; a repeated query answers once for each vector. Empty tables give no rows.

    Every point is in a page, and every query goes to every page; candidates have no cap. Queries with less than k
    finds go round again with wider windows, at last with such as hold all. The result is approximate: a point may
    collide too seldom. With the constants here, recall is above 0.99 on unit vectors of 64 components.
    """
    spark = points.sparkSession
    takes_part = vectors.finite("embedding") & F.exists("embedding", lambda x: x != 0)
    typed = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")]
    points, queries = points.select(*typed).where(takes_part), queries.select(*typed).where(takes_part & F.col("vec_id").isNotNull()).distinct()
    facts = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width")).first()
    wide = queries.agg(F.max(F.size("embedding"))).first()[0]
    pages, width = max(1, math.ceil(facts["n"] / vectors.PAGE)), max(facts["width"] or 1, wide or 1)
    sample = points.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).toArrow()
    shared = spark.sparkContext.broadcast((vectors.longs(vectors.whole(sample, "vec_id")), vectors.matrix(vectors.whole(sample, "embedding"), width)))
    along = lines(width)

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their first radius: the distance of the k-th of the sample, just above it."""
        ids, known = shared.value
        for batch in rows.slices(batches, vectors.CHUNK):
            own = vectors.longs(batch.column("vec_id"))
            radius = []
            for id_, query in zip(own, vectors.matrix(batch.column("embedding"), width), strict=True):
                gap = np.sort(distances(known[ids != id_], query))
                radius.append(gap[k - 1] * (1 + 1e-9) if len(gap) >= k else math.inf)
            yield batch.append_column("radius", pa.array(radius, pa.float64()))

    def opened(page: pa.Table) -> Page:
        ids = vectors.whole(page, "vec_id")
        return Page(vectors.longs(ids), ids.is_null().to_numpy(zero_copy_only=False), vectors.matrix(vectors.whole(page, "embedding"), width), along)

    out = pa.schema([("query_id", pa.int64()), ("twin", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def asked(page: Page, asks: pa.Table) -> Iterator[pa.RecordBatch]:
        own, twin, last = (vectors.whole(asks, c).to_numpy() for c in ("vec_id", "twin", "radius"))
        for q, found, gaps in page.search(own, vectors.matrix(vectors.whole(asks, "embedding"), width), last, k):
            if len(found):
                ids = vectors.nullable(page.ids[found], page.null[found])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), own[q])), pa.array(np.full(len(found), twin[q])), ids, pa.array(gaps)], schema=out)

    dealt = points.withColumn("page", F.pmod(F.xxhash64("vec_id", "embedding", F.monotonically_increasing_id()), F.lit(pages)).cast("long"))
    named = rows.mapped(queries, bounded, "vec_id long, embedding array<double>, radius double").withColumn("twin", F.xxhash64("embedding"))
    named = written(named, "queries")
    order = Window.partitionBy("query_id", "twin").orderBy("score", F.asc_nulls_last("vec_id"))
    best, short, widening = None, named, iter(WIDER)
    while True:
        asks = short.withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pages - 1).cast("long"))))
        met = vectors.meetings(dealt, asks, opened, asked, "query_id long, twin long, vec_id long, score double")
        found = written(met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest")
        counts = found.groupBy(F.col("query_id").alias("vec_id"), "twin").agg(F.count(F.lit(1)).alias("n"))
        short = short.join(counts, ["vec_id", "twin"], "left").where((F.coalesce("n", F.lit(0)) < k) & (F.col("radius") < math.inf)).drop("n")
        short = written(short.withColumn("radius", F.col("radius") * next(widening, math.inf)), "short")
        full = found.join(short.select(F.col("vec_id").alias("query_id"), "twin"), ["query_id", "twin"], "left_anti")
        best = full if best is None else best.unionByName(full)
        if short.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score")

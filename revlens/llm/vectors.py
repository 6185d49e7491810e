"""Vectors as NumPy rows, and pages of rows that meet the queries sent to them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm import rows

#: Rows of a page, and queries that are looked up in it at a time.
PAGE, CHUNK = 2048, 256
LAST = np.iinfo(np.int64).max


def finite(vector: str) -> Column:
    """There is a vector, and all its components are numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def longs(column: pa.Array, null: int = LAST) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False).astype(np.int64)


def table(batches: list[pa.RecordBatch], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches(batches, schema).combine_chunks()


def whole(table: pa.Table, name: str) -> pa.Array:
    """A column in one piece."""
    column = table.column(name)
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


Opened = Callable[[pa.Table], object]
Asked = Callable[[object, pa.Table], Iterator[pa.RecordBatch]]


def meetings(pages: DataFrame, asks: DataFrame, opened: Opened, asked: Asked, schema: str) -> DataFrame:
    """Rows of ``pages`` and ``asks`` with the same ``page``: asked(opened(the page's rows), a chunk of asks).

    Both have the column ``page``, a long. A page's rows come first in its task, then the asks stream by; a task
    holds one page and one chunk. Pages are of a bounded size and have as many asks as each other, by and large.
    """
    ask_only = [c for c in asks.columns if c not in pages.columns]
    rows_, calls = pages.withColumn("_ask", F.lit(0)), asks.withColumn("_ask", F.lit(1))
    both = rows_.unionByName(calls, allowMissingColumns=True)
    dealt = both.repartition(rows.partitions(pages.sparkSession), "page").sortWithinPartitions("page", "_ask")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, page = None, [], None
        for batch in rows.slices(batches, CHUNK):
            number, ask = batch.column("page").to_numpy(), batch.column("_ask").to_numpy()
            cuts = np.flatnonzero((np.diff(number) != 0) | (np.diff(ask) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(start, stop - start)
                if at != number[start]:
                    at, held, page = number[start], [], None
                if not ask[start]:
                    held.append(part)
                elif held or page is not None:
                    if page is None:
                        page, held = opened(table(held, batch.schema).drop_columns(ask_only)), []
                    yield from asked(page, table([part], batch.schema))

    return rows.mapped(dealt, met, schema)


def least(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least scores, ties to the smaller id."""
    return np.lexsort((ids, scores))[:k]


def nullable(ids: np.ndarray, null: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=null)

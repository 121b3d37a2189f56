"""Scoring of a large vector table against a small set of query vectors.

The vector table is never shuffled, joined or copied: each task streams Arrow batches of
it past a query matrix and keeps only what can still matter (the best k, or everything
at or above a threshold).  Query vectors are the user's request; they are sent out in
blocks of ``QUERY_BLOCK`` so that no task or closure holds more than one block, and any
number of queries is handled by further passes.

A matrix product proposes the pairs with a small safety margin; the surviving pairs are
then summed element by element in a fixed order, so a score does not depend on how rows
were batched, and equals the same sum made in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_BLOCK = 512
# Bytes that a task's products, and the vectors of the pairs it sums, take at a time.
BYTES_AT_ONCE = 16 << 20


def dot_product(a: Column, b: Column) -> Column:
    """Dot product of two array columns, accumulated in DOUBLE."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(dot_product(a, a))


def vector_matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an Arrow list column as a float64 matrix of the given width."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(column) * width:
        raise ValueError(f"every vector must have {width} elements")
    return flat.reshape(len(column), width).astype(np.float64)


def exact_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Row-wise dot products summed from the first element to the last."""
    total = np.zeros(len(left))
    for a, b in zip(np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)):
        total += a * b
    return total


def pair_dots(vectors: np.ndarray, queries: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``exact_dots`` of the named pairs, however many they are and however wide the vectors."""
    step = max(1, BYTES_AT_ONCE // (32 * max(1, vectors.shape[1])))
    parts = [exact_dots(vectors[rows[at : at + step]], queries[cols[at : at + step]]) for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def rows_at_once(queries: int, width: int) -> int:
    """Rows of a batch to be multiplied at a time: their products and places, and the rows themselves, stay in bounds."""
    return max(1, BYTES_AT_ONCE // (8 * (4 * queries + 2 * width)))


def _margin(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Per query, more than the rounding error a dot product of this width can have."""
    longest = np.sqrt((vectors**2).sum(axis=1)).max(initial=0.0)
    unit = 8 * vectors.shape[1] * np.finfo(np.float64).eps
    return unit * longest * np.sqrt((queries**2).sum(axis=1))


class RunningBest:
    """The best ``k`` (score descending, id ascending) of every query seen so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floor = np.full(len(queries), -np.inf)
        self.kept = None
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.waiting_rows = 0

    def add(self, vectors: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        step = rows_at_once(len(self.queries), vectors.shape[1])
        for start in range(0, len(vectors), step):
            part = slice(start, start + step)
            self._add(vectors[part], ids[part], keys[part])

    def _add(self, vectors, ids, keys) -> None:
        rough = vectors @ self.queries.T
        margin = _margin(vectors, self.queries)
        floor = self.floor
        if len(vectors) > self.k:
            kth = np.partition(rough, len(vectors) - self.k, axis=0)[len(vectors) - self.k]
            floor = np.maximum(floor, kth - margin)
        rows, cols = np.nonzero(rough >= floor - margin)
        exact = pair_dots(vectors, self.queries, rows, cols)
        self.waiting.append((cols, exact, ids[rows], keys[rows]))
        self.waiting_rows += len(rows)
        if self.waiting_rows > self.k * len(self.queries):
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        """Reduce to the best ``k`` per query and raise the floors accordingly."""
        parts = ([self.kept] if self.kept else []) + self.waiting
        cols, scores, ids, keys = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -scores, cols))
        cols, scores, ids, keys = cols[order], scores[order], ids[order], keys[order]
        place = np.arange(len(cols)) - np.searchsorted(cols, cols)
        keep, last = place < self.k, place == self.k - 1
        self.floor[cols[last]] = scores[last]
        self.kept = (cols[keep], scores[keep], ids[keep], keys[keep])
        self.waiting, self.waiting_rows = [], 0
        return self.kept


def query_blocks(query_vectors: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (ids, matrix, floors) from rows (query_id, position, vector, floor).

    The vectors of a query with several images are added up: the score of an image is
    the sum of its dot products with all query images, which is its dot product with
    their sum.

    The table of queries is small by nature (a user's request); it is fetched one block
    at a time.  Blocks partition it by hash of the query, so together they cover it.
    """
    rows = query_vectors.take(QUERY_BLOCK + 1)
    blocks = 1 if len(rows) <= QUERY_BLOCK else -(-query_vectors.count() // QUERY_BLOCK)
    for block in range(blocks):
        if blocks > 1:
            mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block
            rows = query_vectors.where(mine).collect()
        if rows:
            rows.sort(key=lambda row: (row["query_id"], row["position"]))
            ids, starts = np.unique([row["query_id"] for row in rows], return_index=True)
            parts = np.array([row["vector"] for row in rows], dtype=np.float64)
            floors = np.array([row["floor"] for row in rows], dtype=np.float64)
            yield ids.astype(np.int64), np.add.reduceat(parts, starts, axis=0), floors[starts]


def nearest(vectors: DataFrame, query_vectors: DataFrame, k: int) -> DataFrame:
    """Per task of ``vectors`` (image_id, sku_key, vector), the best ``k`` per query.

    A superset of the global best ``k``; the caller cuts across tasks.
    """
    schema = "query_id bigint, image_id bigint, sku_key string, score double"

    def scorer(query_ids: np.ndarray, matrix: np.ndarray):
        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = RunningBest(matrix, k)
            for batch in batches:
                best.add(
                    vector_matrix(batch.column("vector"), matrix.shape[1]),
                    batch.column("image_id").to_numpy(zero_copy_only=False),
                    batch.column("sku_key").to_numpy(zero_copy_only=False),
                )
            if best.kept or best.waiting:
                cols, scores, ids, keys = best.cut()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(query_ids[cols], pa.int64()),
                        pa.array(ids, pa.int64()),
                        pa.array(keys, pa.string()),
                        pa.array(scores, pa.float64()),
                    ],
                    names=["query_id", "image_id", "sku_key", "score"],
                )

        return score

    source = vectors.select("image_id", "sku_key", "vector").where(F.col("vector").isNotNull())
    blocks = query_blocks(query_vectors.select("*", F.lit(0.0).alias("floor")))
    passes = [source.mapInArrow(scorer(ids, matrix), schema) for ids, matrix, _ in blocks]
    if not passes:
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, passes)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(exact_dots(matrix, matrix))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def similar(vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Pairs of ``vectors`` (text_vec_id, vector) and queries (query_id, vector, floor)
    whose cosine similarity reaches the query's floor.  No shuffle; only passing pairs
    leave the scan."""
    schema = "query_id bigint, text_vec_id bigint, text_similarity double"

    def scorer(query_ids: np.ndarray, matrix: np.ndarray, floors: np.ndarray):
        units = _unit_rows(matrix)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            step = rows_at_once(len(units), units.shape[1])
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    rows = _unit_rows(vector_matrix(part.column("vector"), units.shape[1]))
                    rough = rows @ units.T
                    at, cols = np.nonzero(rough >= floors - _margin(rows, units))
                    exact = pair_dots(rows, units, at, cols)
                    keep = exact >= floors[cols]
                    ids = part.column("text_vec_id").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(query_ids[cols[keep]], pa.int64()),
                            pa.array(ids[at[keep]], pa.int64()),
                            pa.array(exact[keep], pa.float64()),
                        ],
                        names=["query_id", "text_vec_id", "text_similarity"],
                    )

        return score

    source = vectors.select("text_vec_id", "vector").where(F.col("vector").isNotNull())
    blocks = query_blocks(query_vectors.select("*", F.lit(0).alias("position")))
    passes = [source.mapInArrow(scorer(*block), schema) for block in blocks]
    if not passes:
        return vectors.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, passes)

"""Shared by the vector searches: cleaning, blocks of bounded size, running top-k lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def whole(v: Column) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros to `dim`."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    offsets = np.asarray(vectors.offsets)
    flat = np.asarray(vectors.values, np.float64)[offsets[0] : offsets[-1]] if n else np.zeros(0)
    size = np.diff(offsets)
    if n and (size == dim).all():
        return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def chunks(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """cell -> (first chunk, number of chunks): small cells share a chunk of up to `most` rows, large ones are split."""
    out, at, filled = {}, 0, 0
    for cell in sorted(counts):
        n = counts[cell]
        if n > most:
            if filled:
                at, filled = at + 1, 0
            parts = -(-n // most)
            out[cell] = (at, parts)
            at += parts
        else:
            if filled and filled + n > most:
                at, filled = at + 1, 0
            out[cell] = (at, 1)
            filled += n
    return out


class Best:
    """The k best (score, smaller id first) candidates of each of n queries, seen so far; an id counts once, with its best score."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None, hold: int = 1_000_000, distinct: bool = False):
        """distinct: no candidate's id comes twice for a query."""
        self.k, self.hold, self.distinct = k, hold, distinct
        self.worst = np.full(n, -np.inf) if floor is None else floor.astype(np.float64).copy()
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append((query, ids, score))
        self.held += len(query)
        if self.held > self.hold:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate([p[f] for p in self.parts]) for f in range(3))
        if not self.distinct:
            order = np.lexsort((-s, i, q))
            q, i, s = q[order], i[order], s[order]
            new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]))
            q, i, s = q[new], i[new], s[new]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        q, i, s, rank = q[keep], i[keep], s[keep], rank[keep]
        full = rank == self.k - 1
        self.worst[q[full]] = np.maximum(self.worst[q[full]], s[full])
        self.parts, self.held = [(q, i, s)], len(q)
        return q, i, s


def merge(found: DataFrame, k: int) -> DataFrame:
    """The k best of the partial lists, an id once for a query, with its best score: (query_id, rank, vec_id, score)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    one = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def spread_pairs(df: DataFrame, tasks: int, *by: str) -> DataFrame:
    """Dealt by block to so many tasks, which AQE leaves apart however small they are: their work isn't in their size."""
    return df.repartition(tasks, *by)

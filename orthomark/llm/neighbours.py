"""Nearest neighbours by inner product as a block matrix join.

Query groups and candidate chunks form a grid of tiles, one task group each. In a tile both sides
are rounded to int8 with one scale a vector; their product matrix (exact in float, block by
block) gives every inner product up to an error that the rounding residuals bound:
|<x,y> - <x',y'>| <= |x - x'| |y| + |x'| |y - y'|. A candidate whose upper bound stays under the
``k``-th best lower bound of the query cannot be among its ``k`` nearest; the others are computed in
double precision from the original vectors. The best ``k`` of each tile are merged by a heap a query.
Nothing is sampled, so the result is exact.

Each tile holds at most ``MOST`` candidates and queries, fewer where vectors are longer than ``VALUES / MOST``
components; smaller tables are cut in ``CHUNKS`` chunks. The bounds hold for vectors whose largest
component lies in ``RANGE``; products of any other vector are computed in double precision at once.

Defined results: vectors that are null, empty, all zero or hold null or non-finite components take no
part; vectors of different lengths are not compared; of rows with one id the smallest vector counts.
Products beyond double precision are infinite and tie; sums of opposite infinities count as the smallest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomark.operators.walk import arranged, whole_groups
from orthomark.session import cut_lineage

CHUNKS, MOST, K = 16, 32_768, 20
#: Components of one side of a tile, 8 bytes each.
VALUES = MOST * 256
RANGE = (1e-150, 1e150)
#: Queries of one product at a time.
ROWS = 256
#: Dimensions of one product: 127 * 127 * 1024 < 2^24, so float sums of int8 products are exact.
SLICE = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, lengths of the rounded rows, lengths of the residuals."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    rounded = q * scale[:, None]
    return q, scale, np.linalg.norm(rounded, axis=1), np.linalg.norm(x - rounded, axis=1)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, components added in order."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(x.shape[1]):
            total += x[:, d] * y[:, d]
    return np.where(np.isnan(total), -np.inf, total)


def ranged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ones for those out of ``RANGE``, and which these are."""
    largest = np.abs(x).max(axis=1)
    odd = (largest < RANGE[0]) | (largest > RANGE[1])
    return np.where(odd[:, None], 1.0, x) if odd.any() else x, odd


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the k nearest candidates of a tile for every query."""
    queries, vectors = queries.astype(np.float64), vectors.astype(np.float64)
    plain, c_odd = ranged(vectors)
    cq, c_scale, _, c_rest = quantise(plain)
    c_norm = np.linalg.norm(plain, axis=1)
    cq = cq.astype(np.float32).T
    out: tuple[list, list, list] = ([], [], [])
    for at in range(0, len(queries), ROWS):
        block = queries[at:at + ROWS]
        plain, q_odd = ranged(block)
        q, q_scale, q_norm, q_rest = quantise(plain)
        q = q.astype(np.float32)
        product = np.zeros((len(block), len(ids)))
        for d in range(0, block.shape[1], SLICE):
            product += q[:, d:d + SLICE] @ cq[d:d + SLICE]
        product *= q_scale[:, None] * c_scale
        # More than the bound by what rounding can do to these sums and to the exact ones.
        hair = 1e-15 * (block.shape[1] + 8)
        error = (q_rest[:, None] * c_norm + q_norm[:, None] * c_rest) * (1 + 1e-9) + hair * (q_norm + q_rest)[:, None] * c_norm
        own = query_ids[at:at + ROWS, None] == ids
        odd = q_odd[:, None] | c_odd
        lower, upper = np.where(own | odd, -np.inf, product - error), np.where(odd, np.inf, product + error)
        least = -np.inf if len(ids) <= k else np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k][:, None]
        row, column = np.nonzero((upper >= least) & ~own)
        for part in range(0, len(row), 1 << 18):  # many equal vectors may survive together
            piece = slice(part, part + (1 << 18))
            out[2].append(exact(block[row[piece]], vectors[column[piece]]))
        out[0].append(query_ids[at + row])
        out[1].append(ids[column])
    query, found = np.concatenate(out[0]), np.concatenate(out[1])
    score = np.concatenate(out[2]) if out[2] else np.zeros(0)
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    start = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
    best = place < k
    return query[best], found[best], score[best]


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("vector").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest other rows of every query row, nearest first, ties
    to the smaller id. ``is_query`` is an expression over vec_id."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter("vec_id is not null").filter(usable(F.col("vector")))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumn("query", is_query))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("query").alias("q"), F.max(F.size("vector")).alias("d")).first()
    most = max(1, min(MOST, VALUES // max(sizes.d or 1, 1)))
    chunks, groups = max(CHUNKS, -(-sizes.n // most)), max(1, -(-sizes.q // most))
    chunk, group = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    candidates = rows.select(F.size("vector").alias("size"), every(groups).alias("g"), chunk.alias("c"), F.lit(False).alias("asks"), "vec_id", "vector")
    asking = rows.filter("query").select(F.size("vector").alias("size"), group.alias("g"), every(chunks).alias("c"), F.lit(True).alias("asks"), "vec_id", "vector")

    def compare(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, matrix = table.column("vec_id").to_numpy(), _matrix(table)
        if asks.all() or not asks.any():
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        else:
            found = tile(ids[asks], matrix[asks], ids[~asks], matrix[~asks], k)
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, starts in whole_groups(batches, ["query_id"]):
            query, ids, scores = (frame[c].tolist() for c in ("query_id", "vec_id", "score"))
            out = []
            for s, e in zip(starts[:-1], starts[1:]):
                best = heapq.nsmallest(k, ((-scores[x], ids[x]) for x in range(s, e)))
                out.extend((query[s], rank + 1, found, -score) for rank, (score, found) in enumerate(best))
            yield pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])

    tiles = candidates.unionByName(asking).groupBy("size", "g", "c").applyInArrow(compare, "query_id long, vec_id long, score double")
    return arranged(tiles, ["query_id"]).mapInPandas(merge, "query_id long, rank int, vec_id long, score double")

"""Nearest neighbours by inner product, as a block matrix join.

Vectors are dealt into blocks of queries and blocks of candidates; each pair of blocks is a tile, one task's
work. In a tile the vectors are quantised to int8 with a scale of their own, and a product of the quantised
matrices gives all inner products with a bound: with x = s q + r (r the rest after quantising), x.y differs from
s q . s' q' by at most |s q| |r'| + |r| |s' q'| + |r| |r'|. Pairs whose upper bound is below the k-th largest
lower bound of their query can't be among its k nearest; the others are recomputed in double precision from the
original vectors, and a heap for each query keeps its k best. The heaps of a query's tiles are merged at the end,
so the result is exact. Equal rows are collapsed before blocks are formed, and an identifier of several vectors
counts once, by its largest lower bound and then by its largest score, before anything is cut.

Candidates are sent once per block of queries and queries once per block of candidates; blocks are bounded in rows
and, for long vectors, in bytes, so memory is bounded, and the products of int8 values stay exact in the floats that
BLAS multiplies. Vectors too large or small for the squares that bounds are made of have none: they are never ruled out.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a
query meets candidates of its own length only; candidates with the query's identifier are its own and take no
part; rows that repeat an identifier count once, with the largest score; ties go to the smaller identifier; an
empty table gives an empty result. Only the identifier and vector are read. A score beyond the range of doubles is
infinite, and one whose sum meets infinities of both signs is -inf.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import settle, ship

QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 8192
#: Bytes of vectors of a block, as doubles, where its rows are not few enough already.
BLOCK_BYTES = 32 << 20
#: Vectors whose largest component lies within have squares, and sums of them, in the range of doubles.
RANGE = (1e-140, 1e140)
#: Queries that a tile multiplies at once, and pairs that it recomputes at once.
STEP = 256
PAIRS = 1 << 16


def takes_part(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Quantised:
    """Vectors as int8 values times a scale, with the norms that bound the error."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        largest = np.abs(vectors).max(axis=1)
        self.unbounded = (largest < RANGE[0]) | (largest > RANGE[1])
        self.scale = np.where(self.unbounded, 1.0, largest) / 127
        vectors = np.where(self.unbounded[:, None], 0.0, vectors) if self.unbounded.any() else vectors
        values = np.rint(vectors / self.scale[:, None]).astype(np.int8)
        kept = values * self.scale[:, None]
        self.kept_norm = np.linalg.norm(kept, axis=1)
        self.rest_norm = np.linalg.norm(vectors - kept, axis=1)
        # below 2**24 a float32 holds sums of int8 products exactly
        self.values = values.astype(np.float32 if vectors.shape[1] * 127 * 127 < 2**24 else np.float64)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of matching rows, summed from the first component to the last, so that equal rows always give equal sums."""
    total = np.zeros(len(x))
    with np.errstate(over="ignore", invalid="ignore"):
        for a, b in zip(x.T, y.T, strict=True):
            total += a * b
    return np.where(np.isnan(total), -np.inf, total)


def tile(queries: Quantised, candidates: Quantised, query_ids: np.ndarray, ids: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """For each query its k best (-score, id) of the candidates, best first."""
    best: list[list[tuple[float, int]]] = []
    by_id = np.argsort(ids, kind="stable")
    firsts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id[:1]] - 1))
    repeats = len(firsts) < len(ids)
    for a in range(0, len(query_ids), STEP):
        part = slice(a, a + STEP)
        product = (queries.values[part] @ candidates.values.T).astype(np.float64)
        product *= queries.scale[part, None] * candidates.scale
        bound = queries.kept_norm[part, None] * candidates.rest_norm + queries.rest_norm[part, None] * (candidates.kept_norm + candidates.rest_norm)
        bound = bound * (1 + 1e-9) + 1e-9 * queries.kept_norm[part, None] * candidates.kept_norm
        if queries.unbounded[part].any() or candidates.unbounded.any():
            bound[queries.unbounded[part, None] | candidates.unbounded] = np.inf
        own = query_ids[part, None] == ids
        low = np.where(own, -np.inf, product - bound)
        if repeats:
            low = np.maximum.reduceat(low[:, by_id], firsts, axis=1)
        if low.shape[1] > k:
            low = np.partition(low, -k, axis=1)[:, -k]
        else:
            low = np.full(len(low), -np.inf)
        rows, columns = np.nonzero((product + bound >= low[:, None]) & ~own)
        scores = np.empty(len(rows))
        for b in range(0, len(rows), PAIRS):
            r, c = rows[b : b + PAIRS], columns[b : b + PAIRS]
            scores[b : b + PAIRS] = inner_products(queries.vectors[part][r], candidates.vectors[c])
        if repeats:
            order = np.lexsort((-scores, ids[columns], rows))
            rows, columns, scores = rows[order], columns[order], scores[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (ids[columns[1:]] != ids[columns[:-1]])
            rows, columns, scores = rows[new], columns[new], scores[new]
        starts = np.searchsorted(rows, np.arange(len(low) + 1))
        for q in range(len(low)):
            mine = slice(starts[q], starts[q + 1])
            best.append(heapq.nsmallest(k, zip((-scores[mine]).tolist(), ids[columns[mine]].tolist(), strict=True)))
    return best


def _matrix(vectors: pa.ChunkedArray, rows: int) -> np.ndarray:
    return vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _tiled(k: int, schema: pa.Schema) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        query_ids, ids = left["id"].to_numpy(), right["id"].to_numpy()
        found = tile(Quantised(_matrix(left["vector"], len(query_ids))), Quantised(_matrix(right["vector"], len(ids))), query_ids, ids, k)
        flat = [(q, i, -s) for q, best in zip(query_ids.tolist(), found, strict=True) for s, i in best]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*flat, strict=True) if flat else ([], [], []), schema.types, strict=True)], schema=schema)

    return run


def _blocks(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k nearest of each query among all other vectors: query_id, rank from 1, vec_id, score.

    Identifiers are whole numbers; is_query is a condition on them (and on other columns of vectors).
    """
    ship(vectors.sparkSession)
    own = vectors.where(F.col(id_col).isNotNull() & takes_part(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks"))
    own = settle(own.groupBy("id", "vector").agg(F.bool_or("asks").alias("asks")).withColumn("dim", F.size("vector")))
    size = F.col("dim").cast("long") * 8
    n, asked, n_bytes, asked_bytes = own.agg(F.count(F.lit(1)), F.count_if("asks"), F.sum(size), F.sum(F.when(F.col("asks"), size))).first()
    across = 1 + max(n // CANDIDATE_BLOCK, (n_bytes or 0) // BLOCK_BYTES)
    down = 1 + max(asked // QUERY_BLOCK, (asked_bytes or 0) // BLOCK_BYTES)
    block = F.xxhash64("id")
    candidates = own.select("id", "vector", "dim", F.pmod(block, F.lit(across)).alias("right"), _blocks(down).alias("left"))
    queries = own.where("asks").select("id", "vector", "dim", _blocks(across).alias("right"), F.pmod(block, F.lit(down)).alias("left"))
    key = ("dim", "left", "right")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    best = queries.groupBy(*key).cogroup(candidates.groupBy(*key)).applyInArrow(_tiled(k, schema), "query_id long, vec_id long, score double")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""The companies that no other beats in every respect.

A row beats another if it is as good in all metrics and better in one. Rows that are equal in all metrics don't beat each other; a row
that lacks a metric can't be compared and is left out.

Fronts are merged in rounds. Each partition first leaves only its own front (what a part beats, the whole beats), or fronts where it is larger than BLOCK. In each round `fan_in` fronts
meet in one and leave theirs, as long as they are small: with many metrics a front can be nearly all rows, and then
meeting in one task would not end well. So rounds stop when they no longer shrink the rows by much, and what is left, the candidates, is settled in
blocks: each block of BLOCK candidates meets each other one in a task of its own, and a candidate stays if no block has
one that beats it. No two rows are joined, and no task holds more than two blocks, or fan_in fronts of rounds that shrink.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.scratch import settle, ship

BLOCK = 8192
FAN_IN = 4
#: A round goes on only if the one before left this part of its rows at most.
SHRINKS = 0.7


def beaten(points: np.ndarray, by: np.ndarray, step: int = 256) -> np.ndarray:
    """Which of the points a row of `by` beats; larger is better in all columns."""
    out = np.zeros(len(points), bool)
    if not len(by):
        return out
    # rows with large sums beat most, so they are tried first, and only on what still stands
    by = by[np.argsort(-by.sum(axis=1), kind="stable")]
    open_ = np.arange(len(points))
    for i in range(0, len(by), step):
        if not len(open_):
            break
        part, own = by[i : i + step], points[open_]
        as_good, better = np.ones((len(own), len(part)), bool), np.zeros((len(own), len(part)), bool)
        for d in range(points.shape[1]):
            as_good &= part[None, :, d] >= own[:, None, d]
            better |= part[None, :, d] > own[:, None, d]
        gone = (as_good & better).any(axis=1)
        out[open_[gone]] = True
        open_ = open_[~gone]
    return out


def front(points: np.ndarray) -> np.ndarray:
    """Which points nothing beats, block by block against what stands so far."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    kept = np.zeros(0, np.int64)
    # nothing beats a point with a larger sum, but for rounding of the sum; so those that stand are tried both ways
    for i in range(0, len(order), 1024):
        own = order[i : i + 1024]
        own = own[~beaten(points[own], points[kept])]
        own = own[~beaten(points[own], points[own])]
        kept = np.concatenate([kept[~beaten(points[kept], points[own])], own])
    out = np.zeros(len(points), bool)
    out[kept] = True
    return out


def _points(table: pa.Table | pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([table[f"m{i}"].to_numpy() if isinstance(table, pa.Table) else table.column(f"m{i}").to_numpy() for i in range(n)], axis=1)


def _local(n: int):
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            held = held.filter(pa.array(front(_points(held, n))))
            if held.num_rows > BLOCK:
                # a large front is left to the blocks, so that a task holds no more than this
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    return local


def _tried(n: int):
    schema = pa.schema([("row", pa.int64())])

    def against(key: tuple, table: pa.Table) -> pa.Table:
        """Of the candidates of the first block, those that one of the second beats."""
        own = table.filter(pa.compute.equal(table["role"], 0))
        other = own if key[0].as_py() == key[1].as_py() else table.filter(pa.compute.equal(table["role"], 1))
        return pa.table([own["row"].filter(pa.array(beaten(_points(own, n), _points(other, n))))], schema=schema)

    return against


def pareto_front(metrics: DataFrame, better: dict[str, str], id_col: str = "instrument_id", fan_in: int = FAN_IN) -> DataFrame:
    """id_col and the metrics of the rows that no other beats; better: for each metric 'high' or 'low'.

    NaN counts as missing. Of equal rows all stay.
    """
    if set(better.values()) - {"high", "low"}:
        raise ValueError("a metric is better 'high' or 'low'")
    ship(metrics.sparkSession)
    names, n = list(better), len(better)
    whole = metrics.where(" AND ".join(f"`{m}` IS NOT NULL AND NOT isnan(`{m}`)" for m in names))
    sign = {m: 1.0 if how == "high" else -1.0 for m, how in better.items()}
    own = whole.select(F.col(id_col).alias("id"), *(F.col(m).cast("double").alias(f"v{i}") for i, m in enumerate(names)), *((F.col(m).cast("double") * sign[m]).alias(f"m{i}") for i, m in enumerate(names)))
    left = settle(own.mapInArrow(_local(n), own.schema))
    rows, parts, before = left.count(), left.rdd.getNumPartitions(), None
    while parts > 1 and rows > BLOCK and (before is None or rows <= SHRINKS * before):
        parts = -(-parts // fan_in)
        # dealt by the metrics, so that equal rows meet and each part has a share of all kinds
        left = settle(left.repartition(parts, *(f"m{i}" for i in range(n))).mapInArrow(_local(n), own.schema))
        before, rows = rows, left.count()
    left = settle(left.withColumn("row", F.monotonically_increasing_id()))
    n_blocks = 1 + rows // BLOCK
    block = left.select("row", *(f"m{i}" for i in range(n)), F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int").alias("block"))
    pairs = lambda role, a, b: block.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).select(F.col(a).alias("a"), F.col(b).alias("b"), F.lit(role).alias("role"), "row", *(f"m{i}" for i in range(n)))
    tried = pairs(0, "block", "other").union(pairs(1, "other", "block").where("a <> b"))
    gone = tried.groupBy("a", "b").applyInArrow(_tried(n), "row long").distinct()
    stay = left.join(gone, "row", "left_anti")
    return stay.select(F.col("id").alias(id_col), *(F.col(f"v{i}").alias(m) for i, m in enumerate(names)))

"""Shards cut from a Hilbert curve over several metadata dimensions.

Each dimension is quantised to 2**BITS levels at its own quantiles, so that levels hold like numbers of
rows; texts by the rank of their whole values, counted row by row. The levels give each row an index along the
Hilbert curve; rows sorted by that index are cut into runs of equal row counts. Rows of a run are close in
all dimensions at once, so the minimum and maximum of each dimension in a shard's files let readers skip it.
Rows that are to stay together (equal texts, by a digest) all take the smallest index among them and follow each
other, so they share a shard or lie in neighbouring ones.

Only identifiers, sizes, digests and levels are shuffled, never texts. Ranks come from a range partitioning
on (index, digest, tie-breaks), whose partitions are small where many rows share an index, plus the row counts
of the partitions before; those are as many as partitions.

Defined results: null in a dimension is its own lowest level; a null text has no bytes; repeated rows each
get a slot of their own; fewer rows than shards leave the last shards empty; an empty table gives an empty
result. Rows are packed while they are placed, so other columns may have any name; what is added takes the place of columns of its name,
and in write_shards another name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.common import free_names, in_order, packed, rejoin, settle, ship, shuffle_partitions

BITS = 5


def hilbert_index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of points, one row each, with coordinates below 2**bits."""
    x = levels.T.astype(np.int64).copy()
    n = len(x)
    for step in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (step - 1))
            x[0] ^= np.where(high, step - 1, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for step in (1 << b for b in range(bits - 1, 0, -1)):
        turn ^= np.where(x[n - 1] & step, step - 1, 0)
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def levels_of(values: np.ndarray, bounds: list[list[float] | None]) -> np.ndarray:
    """For each value (a column for each dimension) its quantile bin from 1, or 0 for NaN; without bounds the value is its level."""
    return np.stack([v.astype(np.int64) if b is None else np.where(np.isnan(v), 0, 1 + np.searchsorted(b, v, side="left")) for v, b in zip(values.T, bounds, strict=True)], axis=1)


def _ranked(rows: DataFrame, dim: str, cuts: int) -> DataFrame:
    """Settled rows with `level` of a column of texts: which of `cuts` equal parts of all rows its value starts in, from 1; 0 for null."""
    values = rows.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.count(F.lit(1)).alias("n"))
    level = 1 + F.floor(F.col("rows_before") * cuts / F.col("rows_all"))
    levels = settle(in_order(values, [F.col(dim)], {"rows": F.col("n")}).select(dim, "n", level.cast("double").alias("level")))
    return rejoin(rows, levels, [dim], "n").select(*rows.columns, F.coalesce("_group.level", F.lit(0.0)).alias("level"))


def _curved(rows: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Packed rows with `curve`, the Hilbert index of their quantised dimensions."""
    kinds, cuts = {f.name: f.dataType.simpleString() for f in rows.schema["row"].dataType}, 2**bits - 1
    own = settle(rows.withColumns({f"dim{i}": F.col("row").getField(d) for i, d in enumerate(dims)}))
    shares = [k / cuts for k in range(1, cuts)]
    numbers = [i for i, d in enumerate(dims) if kinds[d] != "string"]
    found = own.agg(*(F.percentile_approx(F.col(f"dim{i}").cast("double"), shares, 10_000).alias(f"b{i}") for i in numbers)).first() if numbers else []
    cut_at = dict(zip(numbers, [sorted(set(b or [])) for b in found], strict=True))
    for i in range(len(dims)):
        if i not in cut_at:
            own = settle(_ranked(own, f"dim{i}", cuts).withColumnRenamed("level", f"level{i}"))
    points = [F.col(f"dim{i}").cast("double") if i in cut_at else F.col(f"level{i}") for i in range(len(dims))]
    bounds = [cut_at.get(i) for i in range(len(dims))]

    def curve(values: pd.Series) -> pd.Series:
        table = np.array(values.tolist(), np.float64).reshape(len(values), len(bounds))
        return pd.Series(hilbert_index(levels_of(table, bounds), bits))

    return own.select("row", F.pandas_udf(curve, "long")(F.array(*points)).alias("curve"))


def _unpacked(rows: DataFrame, *added: str) -> DataFrame:
    """The columns of packed rows, and those added, which take the place of columns of their name."""
    own = [f.name for f in rows.schema["row"].dataType if f.name.lower() not in added]
    return rows.select(*(F.col("row").getField(c).alias(c) for c in own), *added)


def with_curve(rows: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """rows with `curve`, the Hilbert index of their quantised dimensions, in the place of a column of that name."""
    return _unpacked(_curved(packed(rows), dims, bits), "curve")


def hilbert_shards(rows: DataFrame, dims: list[str], n_shards: int, ties: list[str], together: str | None = None) -> DataFrame:
    """rows with curve, shard and slot (from 0 within the shard), in the place of columns of these names; shard row counts differ by one at most.

    ties: columns that order rows of one index, the row's identifier among them. together: a column; rows that are equal
    in it follow each other.
    """
    ship(rows.sparkSession)
    indexed = settle(_curved(packed(rows), dims, BITS))
    of = F.col("row").getField
    lead, order = F.col("curve"), [of(c) for c in ties]
    if together:
        indexed = indexed.withColumn("together", of(together))
        groups = settle(indexed.where("together IS NOT NULL").groupBy("together").agg(F.min("curve").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        indexed = rejoin(indexed, groups, ["together"], "n")
        lead, order = F.coalesce("_group.lead", "curve"), [F.col("together"), *order]
    ranked = in_order(indexed.withColumn("lead", lead), [F.col("lead"), *order])
    shard = F.expr(f"CAST(_rank * {n_shards} div _n AS INT)")
    first = F.expr(f"(shard * _n + {n_shards - 1}) div {n_shards}")
    return _unpacked(ranked.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first), "curve", "shard", "slot")


def document_metadata(docs: DataFrame, dims: list[str], id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus overhead), text_crc32, text_sha256 and the dimensions; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("text_sha256"), *(F.col(d) for d in dims))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, str]:
    """docs as Parquet, a folder for each shard, in slot order; placed is hilbert_shards of their document_metadata.

    A row meets its place by identifier, CRC of the text and dimensions, null-safely; rows that are equal there are
    numbered on both sides by size, so each takes a place of its own. A large shard is several files, each a range of slots.
    Returns the names of the columns with shard and slot: these, with a number where docs has columns of these names.
    """
    names = [c for c in placed.columns if c in docs.columns and c not in (id_col, text_col, "doc_id", "size", "text_crc32", "text_sha256", "curve", "shard", "slot")]
    of = F.col("row").getField
    text = F.coalesce(of(text_col).cast("string"), F.lit(""))
    own = [of(id_col), F.crc32(F.encode(text, "UTF-8")), *(of(c) for c in names)]
    theirs = [F.col("doc_id"), F.col("text_crc32"), *(F.col(c) for c in names)]
    left = packed(docs).withColumns({f"key{i}": c for i, c in enumerate(own)} | {"nth": F.row_number().over(Window.partitionBy(*own).orderBy(F.octet_length(text)))})
    nth = F.row_number().over(Window.partitionBy(*theirs).orderBy("size", "shard", "slot"))
    right = placed.select(*(c.alias(f"at{i}") for i, c in enumerate(theirs)), nth.alias("at"), "shard", "slot")
    same = F.col("nth") == F.col("at")
    for i in range(len(own)):
        same &= F.col(f"key{i}").eqNullSafe(F.col(f"at{i}"))
    shard, slot = free_names(docs, "shard", "slot")
    rows = left.join(right, same).select("row.*", F.col("shard").alias(shard), F.col("slot").alias(slot))
    rows.repartitionByRange(shuffle_partitions(docs.sparkSession), shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).mode("overwrite").parquet(path)
    return shard, slot

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfold.sources.scratch import settle, shared_folder, ship  # noqa: F401

#: A word is a run of anything but ASCII white space; bytes.split() cuts UTF-8 text the same way.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes that may be sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Groups with at least one of so many of all rows are spread; there are no more such groups than this, so a number for each may be broadcast.
HOT = 10_000


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a number behind it where df has a column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = next(n for n in (name, *(f"{name}_{i}" for i in range(1, 2 + len(taken)))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def packed(df: DataFrame) -> DataFrame:
    """df with each row as a struct in the one column `row`, so that no name of a caller's column meets a helper's; row.* gives it back."""
    return df.select(F.struct("*").alias("row"))


def is_small(df: DataFrame) -> bool:
    """Whether a settled df of flat columns has at most BROADCAST_BYTES."""
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    n, *sizes = df.agg(F.count(F.lit(1)), *texts).first()
    return n * 8 * (2 + len(df.columns)) + sum(sizes) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """A settled df of flat columns, marked for broadcast if it is small; else Spark's joins shuffle it."""
    return F.broadcast(df) if is_small(df) else df


def in_order(rows: DataFrame, order: list[Column], sums: dict[str, Column] | None = None) -> DataFrame:
    """rows with _rank (from 0) in the order, _n (how many they are) and, for each of sums, its sum over the rows before and over all (<name>_before, <name>_all).

    Rows are dealt by ranges of the order, and each range starts where those before it end; only one row of each
    range is ever in one place. The order tells all rows apart that the caller wants apart.
    """
    spark = rows.sparkSession
    sums = {"_rank": F.lit(1).cast("long")} | (sums or {})
    valued = rows.withColumns({f"_v_{name}": value for name, value in sums.items()})
    dealt = settle(valued.repartitionByRange(shuffle_partitions(spark), *order).withColumn("_part", F.spark_partition_id()))
    ranges = dealt.groupBy("_part").agg(*(F.sum(f"_v_{name}").alias(f"_s_{name}") for name in sums))
    earlier, every = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = lambda c: F.coalesce(c, F.lit(0))
    starts = ranges.select("_part", *(zero(F.sum(f"_s_{n}").over(earlier)).alias(f"_b_{n}") for n in sums), *(F.sum(f"_s_{n}").over(every).alias(f"_a_{n}") for n in sums))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {n: F.col(f"_b_{n}") + zero(F.sum(f"_v_{n}").over(inside)) for n in sums}
    # as many rows as ranges, so it may be sent to all tasks
    placed = dealt.join(F.broadcast(starts), "_part")
    more = [c for n in sums if n != "_rank" for c in (before[n].alias(f"{n}_before"), F.col(f"_a_{n}").alias(f"{n}_all"))]
    return placed.select(*(placed[c] for c in rows.columns), before["_rank"].alias("_rank"), F.col("_a__rank").alias("_n"), *more)


def spread(rows: DataFrame, others: DataFrame, key: list[str], counts: DataFrame, size: str, n: int, how: str = "inner", lot: Column | None = None) -> DataFrame:
    """rows joined with others on key, where no key with many of the n rows is one task.

    counts (settled) has the number of rows of keys in the column size; keys that it lacks have few. Keys with at least one HOT-th of
    all rows are dealt into parts, of which eight times the shuffle partitions would hold all rows, by lot (a whole number; a
    number of the row, where rows are settled), and the rows of others go to each part. What is broadcast is two numbers for
    each such key, of which there are no more than HOT; keys that share a hash share their number of parts.
    """
    share = 8 * shuffle_partitions(rows.sparkSession)
    hot = counts.where(F.col(size) * HOT >= n).groupBy(F.xxhash64(*key).alias("_hash")).agg(F.max(1 + F.floor(F.col(size) * share / n)).cast("int").alias("_parts"))
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    lot = F.monotonically_increasing_id() if lot is None else lot
    dealt = rows.join(hot, F.xxhash64(*(rows[k] for k in key)) == hot["_hash"], "left").withColumn("_part", F.pmod(lot, parts).cast("int")).drop("_hash", "_parts")
    to_all = others.join(hot, F.xxhash64(*(others[k] for k in key)) == hot["_hash"], "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hash", "_parts")
    return dealt.join(to_all, [*key, "_part"], how).drop("_part")


def rejoin(rows: DataFrame, groups: DataFrame, key: list[str], size: str, lot: Column | None = None) -> DataFrame:
    """rows with `_group`, a struct of the other columns of the row of groups with their key, or null.

    groups are settled, and so are rows without a lot; size names the column of groups with the number of their rows. Rows of large groups are spread.
    """
    rest = F.struct(*(c for c in groups.columns if c not in key))
    found = spread(rows, groups.select(*key, rest.alias("_group")), key, groups, size, rows.count(), "left", lot)
    return found.select(*(F.col(c) for c in rows.columns), "_group")


def one_row(rows: DataFrame, key: list[Column], text_col: str) -> DataFrame:
    """Of packed rows that are equal in key, and so in text but for null and empty, one whole row: the smallest by the other columns.

    Each input partition sends at most one row of a key on.
    """
    # what holds a map has no order of its own
    own = lambda f: F.col("row").getField(f.name)
    order = [F.to_json(F.struct(own(f))) if re.search("map<|variant", f.dataType.simpleString()) else own(f) for f in rows.schema["row"].dataType if f.name != text_col]
    whole = rows.select(*(k.alias(f"key{i}") for i, k in enumerate(key)), F.struct(F.col("row").getField(text_col).isNull(), *order).alias("order"), "row")
    return whole.groupBy(*(f"key{i}" for i in range(len(key)))).agg(F.min_by("row", "order").alias("row")).select("row.*")


def release(work: int = 1 << 20) -> None:
    """Gives a worker's freed memory back to the system, at the end of a task or of a group of much work: idle workers stay."""
    if work >= 1 << 20:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one number, from which block counts follow."""
    return df.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as zstd over their byte planes, small for arrays whose high bytes vary little."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    packer = zstandard.ZstdCompressor(level=3).compressobj(size=planes.size)
    # plane by plane, so that no second copy of all is held
    return b"".join([*(packer.compress(planes[:, k].tobytes()) for k in range(planes.shape[1])), packer.flush()])


def unpack(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.array(raw.reshape(size, len(raw) // size).T, order="C").view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit integers, as packed differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending. Sorting whole numbers is many times as fast as np.unique's hashing."""
    ordered = np.sort(values)
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return ordered[new]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition is a leaf of the tree. Runs are numbered in `fan_in`-ary digits, two at least, and so are the ranges of digests
that each will own in the end. In each round the `fan_in` runs that differ in one digit of their numbers exchange rows, dealt by the
number of the run alone: a row goes to the one of them whose digit is that of its range. Each run then merges what it was sent, which
from the second round on is in order already (Spark sorts rows
by several columns with TimSort, which finds and merges such runs), and keeps of equal digests the
identifier that stays, in a streaming aggregation over the merged order. After as many rounds as there are digits, each run
holds all there is of its own range, and the runs in turn are one sorted list of the corpus's digests.

A run is sent what `fan_in` runs hold at most, so a text that a third of all rows share gathers nowhere: in the first round a run gets
the copies of `fan_in` leaves, and in each later one a row for each of `fan_in` runs. A digest that no other row has moves once per
round: 64 bytes, log(partitions) / log(fan_in) times, and twice at least.

The key is verified at each level: SHA-256 is accompanied by the length and a second, unrelated hash, and
rows merge only where all three agree. Built-in expressions only.

Defined results: null text counts as empty; rows that repeat a doc_id and its text count each in
group_size and share one verdict; a null doc_id stays only if all of its group are null; an empty table
gives an empty result. Only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import one_row, packed, rejoin, settle, shuffle_partitions, small

KEY = ("sha", "n_bytes", "mark")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("mark"))


def _owner(runs: int) -> Column:
    """The number of the run that owns a digest in the end: its first 48 bits, scaled to [0, runs)."""
    first = F.conv(F.substring(F.hex("sha"), 1, 12), 16, 10).cast("double")
    return F.floor(first * runs / 2.0**48).cast("long")


def merge_runs(rows: DataFrame, fan_in: int = 8, keep: str = "min") -> DataFrame:
    """Digest groups of rows (doc_id and KEY): KEY, keep_id, group_size."""
    best, last = (F.min, F.col("doc_id").isNull()) if keep == "min" else (F.max, F.col("doc_id").isNotNull())
    runs = fan_in * fan_in
    while runs < shuffle_partitions(rows.sparkSession):
        runs *= fan_in
    # an identifier in a struct isn't updated in place, so Spark aggregates in the order of the sort, without a hash table
    level = rows.select(*KEY, F.struct(last, "doc_id").alias("keep"), F.lit(1).cast("long").alias("size"), F.pmod(F.spark_partition_id(), F.lit(runs)).cast("long").alias("run"), _owner(runs).alias("owner"))
    unit = 1
    while unit < runs:
        digit = lambda number: F.floor(F.col(number) / unit) % fan_in  # noqa: B023, E731
        level = level.withColumn("run", F.col("run") + (digit("owner") - digit("run")) * unit)
        level = level.repartition("run").sortWithinPartitions("run", *KEY)
        level = level.groupBy("run", *KEY).agg(best("keep").alias("keep"), F.sum("size").alias("size"), F.first("owner").alias("owner"))
        unit *= fan_in
    return level.select(*KEY, F.col("keep.doc_id").alias("keep_id"), F.col("size").alias("group_size"))


def find_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    keep: 'min' or 'max', the identifier of a group that stays. Only groups of several rows are joined back.
    """
    rows = settle(_keyed(docs, id_col, text_col))
    groups = settle(merge_runs(rows, fan_in, keep).where("group_size > 1"))
    found = rejoin(rows, groups, list(KEY), "group_size")
    alone = F.col("_group").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("_group.keep_id"))
    size = F.when(alone, F.lit(1).cast("long")).otherwise(F.col("_group.group_size"))
    return found.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_bytes")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 8) -> DataFrame:
    """docs in their own columns with one row of each text.

    Of the rows that find_exact_duplicates keeps, those that repeat an identifier and its text tie; the smallest by
    its other columns stays. Texts are shuffled only if rows tie or more rows are dropped than may be broadcast.
    """
    found = find_exact_duplicates(docs, id_col, text_col, keep, fan_in)
    counted = found.groupBy(F.col("doc_id").alias("mark_id"), F.col("text_sha256").alias("mark_sha"), "kept").agg(F.count(F.lit(1)).alias("n"))
    marks = settle(counted.where("NOT kept OR n > 1"))
    rows = packed(docs)
    own, sha = F.col("row").getField(id_col), F.sha2(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")), 256)

    def matched(part: DataFrame, how: str) -> DataFrame:
        return rows.join(part, own.eqNullSafe(part["mark_id"]) & (sha == part["mark_sha"]), how)

    rest, tied = matched(small(marks), "left_anti").select("row.*"), marks.where("kept")
    return rest if tied.isEmpty() else rest.union(one_row(matched(small(tied), "left_semi"), [own, sha], text_col))

"""Orders and lines stored so that they join without a shuffle.

Both tables are bucketed by the order key into as many buckets and sorted by it, so each task joins one bucket of either by
merging; the shuffle is paid once, when they are written. Orders that many lines belong to are no concern here, as an order has few lines; lines without an
order key join with nothing and lie in a bucket of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators import portfolio
from tallyfold.sources.tables import Tables

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def store(tables: Tables, folder: str, prefix: str, buckets: int) -> None:
    """Writes the typed orders and lineitem to folder, as catalog tables named by prefix."""
    for name, key in KEYS.items():
        # one task for each bucket, so that a bucket is one sorted file
        dealt = tables.table(name).repartition(buckets, key)
        dealt.write.mode("overwrite").format("parquet").option("path", f"{folder}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(f"{prefix}_{name}")


def stored_fills(spark: SparkSession, prefix: str) -> DataFrame:
    """The fills (O01) of stored tables, joined bucket by bucket; an error where the plan would shuffle."""
    orders, lines = (spark.table(f"{prefix}_{name}").hint("merge") for name in KEYS)
    fills = portfolio.trades(orders, lines)
    if shuffles(fills):
        raise ValueError("the stored tables don't join without a shuffle: are they bucketed alike, and is spark.sql.sources.bucketing.enabled on?")
    return fills


def shuffles(df: DataFrame) -> int:
    """Exchanges in the plan of df."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def drop(spark: SparkSession, prefix: str) -> None:
    """Forgets the tables; their files stay in the folder."""
    for name in KEYS:
        spark.sql(f"DROP TABLE IF EXISTS {prefix}_{name}")


def bucket_sizes(spark: SparkSession, prefix: str) -> DataFrame:
    """table, bucket and rows, to see how even buckets are."""
    sizes = [spark.table(f"{prefix}_{name}").groupBy(F.lit(name).alias("table"), F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c?\d*", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("rows")) for name in KEYS]
    return sizes[0].union(sizes[1])

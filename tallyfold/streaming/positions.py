"""Positions as a stream: net quantity of each holding after each micro-batch of fills.

The sum of a holding is keyed state, which Spark keeps with the checkpoint. Each micro-batch writes the new quantities of the
holdings that it changed into a folder of its own, which a repeated batch writes anew; so after a restart from the checkpoint every
fill counts once, and the last quantity of each holding is that of O02 over all fills so far, in whatever
batches and order they came.

Sums don't depend on when a fill was traded, so by default no fill is too late. Where fills may be delivered more than once, `redelivered`
names the time between trade dates within which that happens: a watermark so far behind the latest trade date
bounds the keys that are remembered, and a fill further behind is dropped, since it can't be told from one delivered before. Trade
dates are cast to timestamps for this, as a watermark takes neither dates nor timestamps without a zone.

Null accounts and instruments are holdings of their own, as in O02. Fills that are equal in all of TIES, holding, date and quantity are one delivery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyfold.operators import portfolio
from tallyfold.sources.tables import Tables

BATCH = "batch"


def arriving_fills(tables: Tables, files_per_batch: int = 1000) -> DataFrame:
    """The fills (O01) of lineitem files as they arrive in their folder, joined with the orders there are."""
    return portfolio.trades(tables.table("orders"), tables.arriving("lineitem", files_per_batch))


def running_positions(fills: DataFrame, redelivered: str | None = None) -> DataFrame:
    """A stream of holdings with quantity and last_trade, for output mode update; zero quantities are kept, as they end a position."""
    dated = fills.withColumn("at", F.col("trade_date").cast("timestamp"))
    if redelivered is not None:
        dated = dated.withWatermark("at", redelivered).dropDuplicatesWithinWatermark([*portfolio.HOLDING, "trade_date", "signed_quantity", *portfolio.TIES])
    return dated.groupBy(*portfolio.HOLDING).agg(F.sum("signed_quantity").alias("quantity"), F.max("trade_date").alias("last_trade"))


def keep_positions(fills: DataFrame, folder: str, checkpoint: str, redelivered: str | None = None, once: bool = True) -> StreamingQuery:
    """Starts the stream that keeps positions in folder; once: it ends when all that has arrived is worked through."""

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")

    writer = running_positions(fills, redelivered).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


SCHEMA = "account_id long, instrument_id long, quantity double, last_trade date, batch long"


def current_positions(spark: SparkSession, folder: str) -> DataFrame:
    """The last quantity of each holding, without those that come to exactly zero: O02 of all fills so far."""
    changes = spark.read.schema(SCHEMA).parquet(folder)
    last = changes.groupBy(*portfolio.HOLDING).agg(F.max_by("quantity", BATCH).alias("quantity"))
    return last.where("quantity <> 0")


def current_values(spark: SparkSession, folder: str, latest: DataFrame) -> DataFrame:
    """O04 of the positions so far."""
    return portfolio.market_value(current_positions(spark, folder), latest)

"""Positions as of any date from a snapshot and the fills after it.

Fills are kept in a folder for each period (a month or a year) of their trade date, and for the end of closed periods the positions
are kept as well. Positions add up, so a snapshot is a sum of rows: those that it was closed with, and for each late fill, one that is traded before the
end of a period already closed, a row with its change in every snapshot from its period on. Nothing that was written is changed.

A date is answered from the last snapshot before its period and the fills of the periods from there on: folders of earlier fills
aren't read.

Each batch writes folders of its own, and writes them anew if it is repeated, so a batch that was lost midway is simply run again. One writer
at a time adds batches or closes periods. Fills without a trade date belong to no period and are refused.
"""

from __future__ import annotations

from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.operators.portfolio import HOLDING

FILLS = "account_id long, instrument_id long, trade_date date, signed_quantity double, period date, batch long"
POSITIONS = "account_id long, instrument_id long, quantity double, period date, batch string"


class Snapshots:
    """The fills and snapshots of one folder; period: 'month' or 'year'."""

    def __init__(self, spark: SparkSession, folder: str, period: str = "month") -> None:
        self.spark, self.folder, self.period = spark, folder, period

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame, name: str) -> None:
        parts = ("period", "batch")
        # folders with many rows are split over tasks and files of about the advisory size, small ones are written together
        rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.folder}/{name}")

    def _start(self, day: date) -> date:
        return day.replace(day=1) if self.period == "month" else day.replace(month=1, day=1)

    def closed(self) -> list[date]:
        """Starts of the periods that have a snapshot, as many as folders."""
        return sorted(r.period for r in self._read("snapshots", POSITIONS).select("period").distinct().collect())

    def add(self, fills: DataFrame, batch: int) -> None:
        """Adds a batch of fills; snapshots of periods that they belong to or that follow are corrected."""
        own = fills.select(*HOLDING, "trade_date", "signed_quantity", F.trunc("trade_date", self.period).alias("period"), F.lit(batch).cast("long").alias("batch"))
        if not own.where("trade_date IS NULL").isEmpty():
            raise ValueError("a fill has no trade date")
        self._write(own, "fills")
        closed = self.closed()
        if closed:
            # one change for each holding and period, then one for each snapshot that it belongs into
            changes = own.where(F.col("period") <= F.lit(closed[-1])).groupBy(*HOLDING, "period").agg(F.sum("signed_quantity").alias("quantity"))
            ends = F.array(*map(F.lit, closed))
            late = changes.withColumn("at", F.explode(F.filter(ends, lambda end: end >= F.col("period"))))
            late = late.groupBy(*HOLDING, F.col("at").alias("period")).agg(F.sum("quantity").alias("quantity"))
            self._write(late.select(*HOLDING, "quantity", "period", F.lit(f"late-{batch}").alias("batch")), "snapshots")

    def close(self, last: date) -> None:
        """Makes a snapshot for the end of the period of `last`, from the snapshot before it and the fills since."""
        period = self._start(last)
        if period in self.closed():
            return
        rows = self._up_to(period, None).groupBy(*HOLDING).agg(F.sum("quantity").alias("quantity"))
        # a period without holdings has a snapshot too
        none = self.spark.createDataFrame([(None, None, 0.0)], "account_id long, instrument_id long, quantity double")
        self._write(rows.where("quantity <> 0").union(none).withColumns({"period": F.lit(period), "batch": F.lit("closed")}), "snapshots")

    def _up_to(self, period: date, day: date | None) -> DataFrame:
        """Rows that add up to the positions at the end of a period, or of a day in it."""
        before = [p for p in self.closed() if p < period]
        since = F.lit(True) if not before else F.col("period") > F.lit(before[-1])
        fills = self._read("fills", FILLS).where(since & (F.col("period") <= F.lit(period)))
        if day is not None:
            fills = fills.where(F.col("trade_date") <= F.lit(day))
        rows = fills.select(*HOLDING, F.col("signed_quantity").alias("quantity"))
        if before:
            rows = rows.union(self._read("snapshots", POSITIONS).where(F.col("period") == F.lit(before[-1])).select(*HOLDING, "quantity"))
        return rows

    def positions(self, as_of: date) -> DataFrame:
        """O02 as of a date, over all batches so far."""
        return self._up_to(self._start(as_of), as_of).groupBy(*HOLDING).agg(F.sum("quantity").alias("quantity")).where("quantity <> 0")

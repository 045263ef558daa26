"""Screening and ranking of companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numeric import ratio
from tallyfold.operators.companies import observed

#: Places that a metric is rounded to before it ranks.
PLACES = 6


def momentum(prices: DataFrame, lookback: int, skip: int) -> DataFrame:
    """Close `skip` observations ago over close `lookback` observations ago, less 1, for each instrument and date that has both."""
    order = Window.partitionBy("instrument_id").orderBy("price_date")
    found = observed(prices).select("instrument_id", "price_date", F.lag("close", skip).over(order).alias("late"), F.lag("close", lookback).over(order).alias("early"))
    return found.where("early IS NOT NULL AND late IS NOT NULL").select("instrument_id", "price_date", (ratio("late", "early") - 1).alias("momentum"))


def opportunities(metrics: DataFrame, rules: list[Column], by: str, k: int, held: DataFrame | None = None, group: str = "sector") -> DataFrame:
    """The best k of each group by a metric, of the rows that meet all rules and aren't held.

    The metric is rounded to PLACES; ties go to the smaller instrument_id. standing is the percent rank among all
    candidates of the group. It comes from counts of distinct values of the metric, so that the cut to k is the
    only window over the rows, which lets Spark prune before its exchange.
    """
    chosen = metrics
    for rule in rules:
        chosen = chosen.where(rule)
    if held is not None:
        chosen = chosen.join(held.select("instrument_id"), "instrument_id", "left_anti")
    scored = chosen.where(F.col(by).isNotNull()).select(F.col(group).alias("grouped"), "instrument_id", F.round(by, PLACES).alias("score"))
    place = F.row_number().over(Window.partitionBy("grouped").orderBy(F.col("score").desc(), "instrument_id"))
    best = scored.withColumn("place", place).where(F.col("place") <= k)
    values = scored.groupBy("grouped", "score").agg(F.count(F.lit(1)).alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("grouped").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = values.select(F.col("grouped").alias("g"), F.col("score").alias("s"), above.alias("above"), F.sum("n").over(Window.partitionBy("grouped")).alias("all"))
    joined = best.join(ranked, best["grouped"].eqNullSafe(ranked["g"]) & (F.col("score") == F.col("s")))
    standing = F.coalesce(ratio("above", F.col("all") - 1), F.lit(0.0))
    return joined.select(F.col("grouped").alias(group), "place", "instrument_id", F.col("score").alias(by), standing.alias("standing"))

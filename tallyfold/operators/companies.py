"""Return and risk statistics of companies.

Prices: instrument_id, price_date, close. Returns: instrument_id, price_date, ret. A day whose close is null is no
observation: every operator that reads prices, here and in portfolio and opportunities, goes by observed().
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.numeric import ratio
from tallyfold.functions.ordered import recurrence, running_sums


def _by_date():
    """The window that all ordered statistics share, so that a plan sorts once."""
    return Window.partitionBy("instrument_id").orderBy("price_date")


def daily_prices(fills: DataFrame) -> DataFrame:
    """Price of each instrument and day, weighted by volume; null if the volume is 0.

    fills: instrument_id, price_date, quantity, amount. They are summed before anything is shuffled, so what
    follows by instrument deals one row for each of its days.
    """
    grouped = fills.groupBy("instrument_id", "price_date").agg(F.sum("amount").alias("amount"), F.sum("quantity").alias("quantity"))
    return grouped.select("instrument_id", "price_date", ratio("amount", "quantity").alias("close"))


def observed(prices: DataFrame) -> DataFrame:
    """The prices that have a close."""
    return prices.where("close IS NOT NULL")


def returns(prices: DataFrame) -> DataFrame:
    """Close over the previous observed close, less 1, null where that is 0; without each instrument's first observation."""
    before = F.lag("close").over(_by_date())
    found = observed(prices).withColumn("before", before).where("before IS NOT NULL")
    return found.select("instrument_id", "price_date", (ratio("close", "before") - 1).alias("ret"))


def rolling_stats(rets: DataFrame, n: int) -> DataFrame:
    """Mean and sample deviation of the last n observations; null until there are n."""
    last = _by_date().rowsBetween(-(n - 1), 0)
    full = F.count("ret").over(last) == n
    return rets.select("instrument_id", "price_date", F.when(full, F.avg("ret").over(last)).alias("mean"), F.when(full, F.stddev_samp("ret").over(last)).alias("stddev"))


def max_drawdown(prices: DataFrame) -> DataFrame:
    """The least of close over the highest close so far, less 1."""
    peak = F.max("close").over(_by_date().rowsBetween(Window.unboundedPreceding, 0))
    fall = observed(prices).select("instrument_id", (ratio("close", peak) - 1).alias("fall"))
    return fall.groupBy("instrument_id").agg(F.min("fall").alias("max_drawdown"))


def risk_summary(rets: DataFrame, min_obs: int) -> DataFrame:
    """Observations, mean, sample deviation, mean over deviation (risk-free rate zero) and 5th percentile of returns.

    Only instruments with min_obs observations.
    """
    grouped = rets.groupBy("instrument_id").agg(F.count("ret").alias("observations"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("stddev"), F.percentile("ret", 0.05).alias("var_95"))
    return grouped.where(F.col("observations") >= min_obs).withColumn("sharpe", ratio("mean", "stddev"))


def market(rets: DataFrame) -> DataFrame:
    """Mean return of each date, all instruments alike."""
    return rets.groupBy("price_date").agg(F.avg("ret").alias("market"))


def beta(rets: DataFrame, min_obs: int) -> DataFrame:
    """Sample covariance with the equal-weight market over its sample variance; null if that is 0.

    The market has one row for each date; whether it is broadcast is left to Spark's check of its size.
    """
    joined = rets.join(market(rets), "price_date")
    grouped = joined.groupBy("instrument_id").agg(F.count("ret").alias("observations"), F.covar_samp("ret", "market").alias("cov"), F.var_samp("market").alias("var"))
    return grouped.where(F.col("observations") >= min_obs).select("instrument_id", "observations", ratio("cov", "var").alias("beta"))


def sector_correlation(rets: DataFrame, companies: DataFrame) -> DataFrame:
    """Correlation of the mean returns of two sectors over common dates, each pair once."""
    named = rets.join(companies.select("instrument_id", "sector"), "instrument_id").where("sector IS NOT NULL")
    daily = named.groupBy("sector", "price_date").agg(F.avg("ret").alias("ret"))
    left = daily.select("price_date", F.col("sector").alias("sector_a"), F.col("ret").alias("a"))
    right = daily.select("price_date", F.col("sector").alias("sector_b"), F.col("ret").alias("b"))
    pairs = left.join(right, "price_date").where("sector_a < sector_b")
    return pairs.groupBy("sector_a", "sector_b").agg(F.count(F.lit(1)).alias("dates"), F.corr("a", "b").alias("correlation"))


def peer_compare(risk: DataFrame, companies: DataFrame, metrics: tuple[str, ...] = ("mean", "stddev")) -> DataFrame:
    """Z-score of each metric within the sector, with the sector's median; null where the deviation is 0 or unknown.

    Sectors are few and large, so their statistics are aggregated and joined back.
    """
    own = risk.select("instrument_id", *metrics).join(companies.select("instrument_id", "sector"), "instrument_id")
    stats = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("avg", F.avg), ("dev", F.stddev_samp), ("median", F.median))]
    peers = own.groupBy("sector").agg(*stats).withColumnRenamed("sector", "peers")
    joined = own.join(peers, own["sector"].eqNullSafe(peers["peers"]))
    scores = [c for m in metrics for c in (ratio(F.col(m) - F.col(f"{m}_avg"), F.col(f"{m}_dev")).alias(f"{m}_z"), F.col(f"{m}_median"))]
    return joined.select("instrument_id", "sector", *scores)


def weighted_stats(rets: DataFrame, weight: float, bucket: str = "year") -> DataFrame:
    """Exponentially weighted mean and deviation after each observation: instrument_id, price_date, mean, deviation.

    The first observation is the mean, with deviation 0; each later one moves the mean by weight * (ret - mean), and the variance v to
    (1 - weight) * (v + weight * (ret - mean)**2), with the mean before it. Both are linear maps of what came before, so years of an instrument (spans
    of `bucket`) are composed on their own and joined in order. Returns without a value are no observations.
    """
    if not 0 < weight <= 1:
        raise ValueError("the weight lies above 0 and up to 1")
    key, order, span = ["instrument_id"], ["price_date"], F.trunc("price_date", bucket)
    seen = running_sums(rets.where("ret IS NOT NULL").select("instrument_id", "price_date", "ret"), key, order, {"earlier": F.lit(1).cast("long")}, span)
    first = F.col("earlier") == 0
    kept = F.when(first, 0.0).otherwise(1 - weight)
    means = recurrence(seen, key, order, kept, {"mean": F.when(first, F.col("ret")).otherwise(weight * F.col("ret"))}, span)
    moved = F.when(first, 0.0).otherwise((1 - weight) * weight * F.pow(F.col("ret") - F.col("mean_before"), F.lit(2.0)))
    found = recurrence(means, key, order, kept, {"variance": moved}, span)
    return found.select("instrument_id", "price_date", "mean", F.sqrt("variance").alias("deviation"))

"""Summaries of fixed size that can be merged, for spans and groupings that are asked for later.

Quantiles: a KLL sketch of the returns of each instrument and month. Sketches of any months merge into one whose error is that of a single
sketch of all: with 99 percent confidence, the rank of a quantile is off by no more than rank_error(k) of all observations. Up to
about k observations nothing is lost. O18 stays the exact form.

Distinct counts: a HyperLogLog sketch of the texts of each group. Sketches merge into any coarser grouping without the texts
or their digests; the relative standard error of a count is 1.04 / sqrt(2 ** LG). Where counts must be exact, the distinct digests of each group are kept
instead, which merge in the same way and grow with the distinct texts.

Sketches are made by partial aggregation, so a hot instrument or company sends one sketch from each task; building and merging are built in.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 400
LG = 14


def rank_error(k: int = K) -> float:
    """Error of a rank with 99 percent confidence, as a part of all observations (the fit published for KLL sketches)."""
    return 2.296 / k**0.9723


def count_error(lg: int = LG) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (lg / 2)


def quantile_sketches(rets: DataFrame, k: int = K) -> DataFrame:
    """instrument_id, month (its first day) and sketch of the returns that have a value."""
    seen = rets.where("ret IS NOT NULL AND NOT isnan(ret)")
    return seen.groupBy("instrument_id", F.trunc("price_date", "month").alias("month")).agg(F.kll_sketch_agg_double("ret", k).alias("sketch"))


def span_quantiles(sketches: DataFrame, ranks: dict[str, float], since: date | None = None, until: date | None = None, k: int = K) -> DataFrame:
    """Observations of each instrument in the months from that of since to that of until, and a column for each of ranks (0 to 1)."""
    of = sketches
    if since is not None:
        of = of.where(F.col("month") >= F.trunc(F.lit(since), "month"))
    if until is not None:
        of = of.where(F.col("month") <= F.lit(until))
    merged = of.groupBy("instrument_id").agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    values = (F.kll_sketch_get_quantile_double("sketch", F.lit(float(rank))).alias(name) for name, rank in ranks.items())
    return merged.select("instrument_id", F.kll_sketch_get_n_double("sketch").alias("observations"), *values)


def distinct_sketches(documents: DataFrame, by: tuple[str, ...] = ("company_id", "lang"), lg: int = LG) -> DataFrame:
    """The columns of `by`, documents and sketch of the texts; null texts count as documents only."""
    return documents.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), F.hll_sketch_agg("text", lg).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Documents and distinct_texts of a coarser grouping of sketches."""
    merged = sketches.groupBy(*by).agg(F.sum("documents").alias("documents"), F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*by, "documents", F.hll_sketch_estimate("sketch").alias("distinct_texts"))


def distinct_digests(documents: DataFrame, by: tuple[str, ...] = ("company_id", "lang")) -> DataFrame:
    """The columns of `by`, digest (SHA-256) and documents of each of its texts; null texts have a null digest."""
    return documents.groupBy(*by, F.unhex(F.sha2("text", 256)).alias("digest")).agg(F.count(F.lit(1)).alias("documents"))


def exact_distinct_counts(digests: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """O35, exact: documents and distinct_texts of a coarser grouping of digests.

    Digests are dealt by themselves first, so a group with most of the texts is no single task.
    """
    once = digests.groupBy(*by, "digest").agg(F.sum("documents").alias("documents"))
    return once.groupBy(*by).agg(F.sum("documents").alias("documents"), F.count("digest").alias("distinct_texts"))

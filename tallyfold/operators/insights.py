"""What texts and metrics say about companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.text import terms
from tallyfold.sources.scratch import settle


def company_terms(documents: DataFrame, k: int) -> DataFrame:
    """The k terms of each company with the largest tf x ln(N / df), companies being the unit.

    Scores are rounded to 6 places; ties go to the term first in code point order. Terms are counted per company
    before companies are counted per term, so a term that all use is one row per company there. These counts are
    settled: texts are read and cut once for the counts, the companies of a term and the number of companies.
    """
    counts = settle(documents.where("company_id IS NOT NULL").select("company_id", F.explode(terms("text")).alias("term")).groupBy("company_id", "term").agg(F.count(F.lit(1)).alias("tf")))
    spread = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = counts.agg(F.count_distinct("company_id").alias("n"))
    score = F.round(F.col("tf") * F.ln(F.col("n") / F.col("df")), 6)
    # n is a single row
    scored = counts.join(spread, "term").join(F.broadcast(n)).select("company_id", "term", "tf", "df", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("company_id").orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("place", place).where(F.col("place") <= k)


def document_summary(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, distinct texts, mean length, labelled share, mean quality and toxic rate per company and language.

    Quality and toxic rate are null where no document has a label. Texts are told apart by SHA-256, which alone is shuffled.
    """
    own = documents.select("doc_id", "company_id", "lang", "n_chars", F.sha2("text", 256).alias("digest"))
    joined = own.join(labels.withColumn("labelled", F.lit(1)), "doc_id", "left")
    return joined.groupBy("company_id", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_distinct("digest").alias("distinct_texts"), F.avg("n_chars").alias("mean_chars"),
        F.avg(F.coalesce("labelled", F.lit(0))).alias("labelled_share"), F.avg("quality").alias("mean_quality"), F.avg("toxic").alias("toxic_rate"),
    )


def company_profile(companies: DataFrame, risk: DataFrame, betas: DataFrame, momenta: DataFrame, drawdowns: DataFrame) -> DataFrame:
    """One row per company with its metrics; null where there isn't enough data. momenta: one row per instrument."""
    wide = companies
    for metrics in (risk, betas.drop("observations"), momenta.drop("price_date"), drawdowns):
        wide = wide.join(metrics, "instrument_id", "left")
    return wide

from datetime import date, timedelta

import numpy as np
import pandas as pd

from tallyfold.operators import sketches as sk

RETURNS = "instrument_id long, price_date date, ret double"


def returns(spark, n=120_000):
    """Skewed returns of two instruments over ten years."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"instrument_id": np.arange(n) % 2, "day": rng.integers(0, 3650, n), "ret": rng.lognormal(0, 3, n) - (np.arange(n) % 2) * 50})
    return frame, spark.createDataFrame(frame).selectExpr("instrument_id", "date_add(DATE '2010-01-01', CAST(day AS INT)) AS price_date", "ret")


def test_merged_quantiles_lie_within_the_error(spark):
    frame, rets = returns(spark)
    ranks = {f"q{int(1000 * r)}": r for r in (0.001, 0.01, 0.05, 0.25, 0.5, 0.75, 0.99)}
    made = sk.quantile_sketches(rets.repartition(9)).checkpoint()
    for since, until in ((None, None), (date(2012, 3, 1), date(2012, 8, 31)), (date(2019, 1, 1), None)):
        first = 0 if since is None else (since - date(2010, 1, 1)).days
        last = 10**6 if until is None else (until - date(2010, 1, 1)).days
        for r in sk.span_quantiles(made, ranks, since, until).collect():
            own = np.sort(frame[(frame.instrument_id == r.instrument_id) & (frame.day >= first) & (frame.day <= last)].ret.to_numpy())
            assert r.observations == len(own)
            for name, rank in ranks.items():
                low, high = (np.searchsorted(own, r[name], side) / len(own) for side in ("left", "right"))
                assert low - sk.rank_error() <= rank <= high + sk.rank_error()


def test_few_observations_are_exact(spark, rows):
    data = [(1, date(2020, 1, 1) + timedelta(20 * d), float(d)) for d in range(11)] + [(1, date(2020, 1, 5), None), (2, date(2020, 1, 5), float("nan"))]
    made = sk.quantile_sketches(spark.createDataFrame(data, RETURNS))
    assert rows(sk.span_quantiles(made, {"low": 0.0, "mid": 0.5, "high": 1.0})) == [(1, 11, 0.0, 5.0, 10.0)]
    assert sk.span_quantiles(made, {"mid": 0.5}, date(2031, 1, 1)).count() == 0
    # the span goes by months: that of the first day is whole
    assert rows(sk.span_quantiles(made, {"low": 0.0}, date(2020, 2, 20))) == [(1, 9, 2.0)]


def test_distinct_counts_roll_up(spark):
    docs = spark.range(60_000).selectExpr("concat('c', id % 3) AS company_id", "CASE WHEN id % 2 = 0 THEN 'en' WHEN id % 7 > 0 THEN 'de' END AS lang", "CASE WHEN id % 11 > 0 THEN CAST(id % 20000 AS STRING) END AS text").repartition(5)
    made = sk.distinct_sketches(docs).checkpoint()
    assert made.count() == 9
    for by in (("company_id", "lang"), ("company_id",), ("lang",), ()):
        exact = docs.groupBy(*by).agg({"*": "count"}).count()
        found = sk.distinct_counts(made, by)
        assert found.count() == exact
        direct = sk.distinct_counts(sk.distinct_sketches(docs, by), by)
        wanted = {tuple(r[: len(by)]): r[len(by)] for r in docs.groupBy(*by).agg(_distinct()).collect()}
        for df in (found, direct):
            assert all(abs(r.distinct_texts - wanted[tuple(r[: len(by)])]) <= 4 * sk.count_error() * wanted[tuple(r[: len(by)])] for r in df.collect())
        # the estimate of merged sketches is that of one sketch of all
        assert {tuple(r[: len(by)]): abs(r.distinct_texts / max(1, wanted[tuple(r[: len(by)])]) - 1) < 0.02 for r in found.collect()} == dict.fromkeys(wanted, True)


def _distinct():
    from pyspark.sql import functions as F

    return F.count_distinct("text")


def test_null_texts_and_no_documents(spark, rows):
    docs = spark.createDataFrame([("a", "en", None), ("a", "en", None), ("b", None, "x")], "company_id string, lang string, text string")
    assert rows(sk.distinct_counts(sk.distinct_sketches(docs), ("company_id",))) == [("a", 2, 0), ("b", 1, 1)]
    assert sk.distinct_counts(sk.distinct_sketches(docs.limit(0)), ("company_id",)).count() == 0


def test_digests_count_exactly_at_any_size(spark, rows):
    docs = spark.range(90_000).selectExpr("concat('c', id % 3) AS company_id", "CASE WHEN id % 2 = 0 THEN 'en' WHEN id % 7 > 0 THEN 'de' END AS lang", "CASE WHEN id % 11 > 0 THEN CAST(id % 40000 AS STRING) END AS text").repartition(5)
    made = sk.distinct_digests(docs).checkpoint()
    for by in (("company_id", "lang"), ("company_id",), ("lang",), ()):
        assert rows(sk.exact_distinct_counts(made, by)) == rows(docs.groupBy(*by).agg(_documents(), _distinct()))


def _documents():
    from pyspark.sql import functions as F

    return F.count("*")


def test_the_query_counts_many_texts_exactly(spark, tmp_path):
    from tallyfold.plans import registry

    spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 50000 AS STRING) AS text", "'en' AS lang", "concat('c', id % 2) AS source", "5L AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = {(r.level, r.company_id, r.lang, r.documents, r.distinct_texts) for r in registry.QUERIES["o35_distinct_counts"](spark, str(tmp_path)).collect()}
    assert found == {("company", "c0", None, 30_000, 25_000), ("company", "c1", None, 30_000, 25_000), ("language", None, "en", 60_000, 50_000), ("all", None, None, 60_000, 50_000)}

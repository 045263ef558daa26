from datetime import date

from pyspark.sql import functions as F

from tallyfold.operators import opportunities as op

D = [date(2020, 1, d) for d in range(1, 12)]


def test_momentum(spark, rows):
    prices = spark.createDataFrame([(1, D[k], float(c)) for k, c in enumerate((2, 3, 4, 5))], "instrument_id long, price_date date, close double")
    assert rows(op.momentum(prices, 2, 1)) == [(1, D[2], 0.5), (1, D[3], round(4 / 3 - 1, 9))]


def test_momentum_skips_null_closes(spark, rows):
    prices = spark.createDataFrame([(1, D[k], c) for k, c in enumerate((2.0, None, 3.0, 4.0))], "instrument_id long, price_date date, close double")
    assert rows(op.momentum(prices, 2, 1)) == [(1, D[3], 0.5)]


METRICS = "instrument_id long, sector string, mean double, observations long"


def test_opportunities_rules_ties_and_held(spark, rows):
    metrics = spark.createDataFrame([(1, "A", 0.5, 20), (2, "A", 0.5000000001, 20), (3, "A", 0.2, 20), (4, "A", 0.9, 5), (5, "A", 0.7, 20), (6, None, 0.1, 20), (7, "A", None, 20)], METRICS)
    held = spark.createDataFrame([(9, 5)], "account_id long, instrument_id long")
    found = rows(op.opportunities(metrics, [F.col("observations") >= 10], "mean", 2, held))
    assert found == [("A", 1, 1, 0.5, 0.0), ("A", 2, 2, 0.5, 0.0), (None, 1, 6, 0.1, 0.0)]


def test_standing_is_the_percent_rank(spark):
    metrics = spark.createDataFrame([(k, "A", float(k % 4), 20) for k in range(9)], METRICS)
    found = {r.instrument_id: r.standing for r in op.opportunities(metrics, [], "mean", 9).collect()}
    assert found[3] == 0.0 and found[7] == 0.0 and found[2] == 2 / 8 and found[1] == 4 / 8 and found[0] == 6 / 8


def test_window_is_pruned_before_its_exchange(spark):
    metrics = spark.range(100).selectExpr("id AS instrument_id", "CAST(id % 3 AS STRING) AS sector", "CAST(id AS DOUBLE) AS mean", "20L AS observations")
    assert "WindowGroupLimit" in op.opportunities(metrics, [], "mean", 2)._jdf.queryExecution().executedPlan().toString()

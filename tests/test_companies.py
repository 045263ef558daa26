import math
import statistics as st
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import companies as co

D = [date(2020, 1, d) for d in range(1, 12)]
PRICES = "instrument_id long, price_date date, close double"
RETURNS = "instrument_id long, price_date date, ret double"


@pytest.fixture(scope="module")
def prices(spark):
    # 3 has a gap in dates, 4 a single observation, 5 a constant price, 6 a null
    data = {1: {0: 10.0, 1: 12.0, 2: 9.0, 3: 9.0}, 3: {0: 4.0, 5: 5.0}, 4: {1: 3.0}, 5: {0: 2.0, 1: 2.0, 2: 2.0}, 6: {0: 2.0, 1: None, 2: 4.0}}
    return spark.createDataFrame([(i, D[d], c) for i, v in data.items() for d, c in v.items()], PRICES)


def test_daily_prices(spark, rows):
    fills = spark.createDataFrame([(1, D[0], 2.0, 10.0), (1, D[0], 3.0, 30.0), (2, D[0], 0.0, 5.0)], "instrument_id long, price_date date, quantity double, amount double")
    assert rows(co.daily_prices(fills)) == [(1, D[0], 8.0), (2, D[0], None)]


def test_returns_use_the_previous_observation(prices, rows):
    assert rows(co.returns(prices)) == [(1, D[1], 0.2), (1, D[2], -0.25), (1, D[3], 0.0), (3, D[5], 0.25), (5, D[1], 0.0), (5, D[2], 0.0), (6, D[2], 1.0)]


def test_rolling_stats_wait_for_n(spark, rows):
    rets = spark.createDataFrame([(1, D[k], float(k)) for k in range(4)], RETURNS)
    assert rows(co.rolling_stats(rets, 3)) == [(1, D[0], None, None), (1, D[1], None, None), (1, D[2], 1.0, 1.0), (1, D[3], 2.0, 1.0)]


def test_max_drawdown(prices, rows):
    assert rows(co.max_drawdown(prices)) == [(1, -0.25), (3, 0.0), (4, 0.0), (5, 0.0), (6, 0.0)]


def test_risk_summary(spark, rows):
    values = [0.1, -0.2, 0.3, 0.05]
    rets = spark.createDataFrame([(1, D[k], v) for k, v in enumerate(values)] + [(2, D[k], 0.0) for k in range(4)] + [(3, D[0], 1.0)], RETURNS)
    found = {r.instrument_id: r for r in co.risk_summary(rets, 2).collect()}
    assert found.keys() == {1, 2}
    assert math.isclose(found[1].mean, st.mean(values)) and math.isclose(found[1].stddev, st.stdev(values)) and math.isclose(found[1].sharpe, st.mean(values) / st.stdev(values))
    assert math.isclose(found[1].var_95, -0.2 + 0.15 * 0.25)
    assert found[2].sharpe is None


def test_beta_of_the_market_is_one(spark):
    rets = spark.createDataFrame([(i, D[d], m * r) for i, m in ((1, 1.0), (2, 2.0), (3, 0.0)) for d, r in enumerate((0.1, -0.1, 0.3))], RETURNS)
    found = {r.instrument_id: r.beta for r in co.beta(rets, 2).collect()}
    assert math.isclose(found[1], 1) and math.isclose(found[2], 2) and abs(found[3]) < 1e-12


def test_beta_of_a_still_market_is_null(spark):
    rets = spark.createDataFrame([(1, D[d], 0.0) for d in range(3)], RETURNS)
    assert co.beta(rets, 2).first().beta is None


def test_sector_correlation(spark, rows):
    rets = spark.createDataFrame([(i, D[d], m * r) for i, m in ((1, 1.0), (2, -2.0), (3, 1.0)) for d, r in enumerate((0.1, -0.1, 0.3))], RETURNS)
    companies = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "instrument_id long, sector string")
    assert rows(co.sector_correlation(rets, companies)) == [("A", "B", 3, -1.0)]


def test_peer_compare(spark, rows):
    risk = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, 7.0, 1.0), (4, 2.0, 2.0)], "instrument_id long, mean double, stddev double")
    companies = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, None)], "instrument_id long, sector string")
    z = round(1 / math.sqrt(2), 9)
    assert rows(co.peer_compare(risk, companies)) == [(1, "A", -z, 2.0, None, 5.0), (2, "A", z, 2.0, None, 5.0), (3, "B", None, 7.0, None, 1.0), (4, None, None, 2.0, None, 2.0)]


def test_null_closes_are_no_observations(spark, rows):
    prices = spark.createDataFrame([(1, D[0], 10.0), (1, D[1], None), (1, D[2], 20.0), (1, D[3], 30.0)], PRICES)
    assert rows(co.returns(prices)) == [(1, D[2], 1.0), (1, D[3], 0.5)]
    assert rows(co.max_drawdown(prices)) == [(1, 0.0)]


def test_fills_are_summed_before_they_are_dealt(spark):
    fills = spark.createDataFrame([(1, D[0], 2.0, 10.0)], "instrument_id long, price_date date, quantity double, amount double")
    plan = co.max_drawdown(co.daily_prices(fills))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2
    first = plan[plan.rindex("Exchange"):]
    assert "partial_sum" in first


def test_layout_changes_nothing(prices, rows):
    for other in (prices.repartition(1), prices.repartition(7), prices.orderBy(F.rand(3))):
        assert rows(co.returns(other)) == rows(co.returns(prices))


def plain_weighted(values, weight):
    mean = variance = None
    out = []
    for v in values:
        if mean is None:
            mean, variance = v, 0.0
        else:
            d = v - mean
            variance = (1 - weight) * (variance + weight * d * d)
            mean += weight * d
        out.append((mean, variance**0.5))
    return out


@pytest.mark.parametrize(("weight", "bucket"), [(0.06, "year"), (0.5, "month"), (1.0, "week"), (0.001, "month")])
def test_weighted_stats_equal_the_recurrence(spark, weight, bucket):
    rng = np.random.default_rng(1)
    series = {1: rng.normal(5, 1, 300).tolist(), 2: [0.25], 3: rng.normal(0, 1e-6, 40).tolist()}
    rows = [(i, date(2018, 1, 1) + timedelta(3 * d), v) for i, own in series.items() for d, v in enumerate(own)] + [(1, date(2017, 1, 1), None), (4, date(2017, 1, 1), None)]
    found = co.weighted_stats(spark.createDataFrame(rows, "instrument_id long, price_date date, ret double").repartition(5), weight, bucket)
    got = {(r.instrument_id, r.price_date): (r["mean"], r.deviation) for r in found.collect()}
    wanted = {(i, date(2018, 1, 1) + timedelta(3 * d)): v for i, own in series.items() for d, v in enumerate(plain_weighted(own, weight))}
    assert got.keys() == wanted.keys()
    assert all(got[k] == pytest.approx(wanted[k], rel=1e-9, abs=1e-15) for k in got)


def test_weighted_stats_of_a_long_series(spark):
    rng = np.random.default_rng(2)
    values = (rng.normal(0, 1, 100_000).cumsum() / 100 + rng.normal(0, 1, 100_000)).tolist()
    days = pd.DataFrame({"instrument_id": 1, "day": np.arange(100_000), "ret": values})
    rets = spark.createDataFrame(days).selectExpr("instrument_id", "date_add(DATE '1800-01-01', CAST(day AS INT)) AS price_date", "ret")
    found = co.weighted_stats(rets, 0.05).orderBy("price_date").toPandas()
    wanted = np.array(plain_weighted(values, 0.05))
    assert np.allclose(found[["mean", "deviation"]], wanted, rtol=1e-9, atol=1e-12)

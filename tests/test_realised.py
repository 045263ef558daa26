import random
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import ordered
from tallyfold.operators import realised as rl
from tests.test_portfolio import TRADES, trade


def fold(fills):
    """Matches and running average cost of each holding, fill by fill."""
    matches, costs, lots, cost = [], [], {}, {}
    for f in sorted(fills, key=lambda f: (f[:2], f[2], f[7:11], f[5], f[6])):
        key, day, left, price = f[:2], f[2], Fraction(f[5]), f[6]
        queue = lots.setdefault(key, [])
        held = sum(q for q, *_ in queue)
        while left and queue and queue[0][0] * left < 0:
            q, on, paid = queue[0]
            m = min(abs(q), abs(left))
            matches.append((*key, "LONG" if q > 0 else "SHORT", float(m), on, paid, day, price, float(m) * (price - paid) * (1 if q > 0 else -1)))
            queue[0] = (q - m if q > 0 else q + m, on, paid)
            left -= m if left > 0 else -m
            if not queue[0][0]:
                queue.pop(0)
        average = cost.get(key) if held and abs(held) > 0 and queue else None
        if left:
            before = abs(held) if held * left > 0 else 0
            average = ((Fraction(average) if before else 0) * before + abs(left) * Fraction(price)) / (before + abs(left))
            queue.append((left, day, price))
        cost[key] = average
        costs.append((*key, day, f[7], float(sum(q for q, *_ in queue)), None if average is None else float(average)))
    return matches, costs


def corpus(seed, n=400, holdings=9, hot=0.0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = (1, 1) if rng.random() < hot else (rng.randrange(3), rng.randrange(holdings))
        q = rng.choice([-3, -2, -1, -0.5, 1, 2, 2.5, 4]) * rng.choice([1, 1, 1, 3])
        day = date(2020, 1, 1) + timedelta(rng.randrange(500))
        price = float(rng.randrange(1, 60))
        out.append((*key, day, "SELL" if q < 0 else "BUY", float(abs(q)), float(q), price, i, 1, 1, abs(q) * price))
    return out


def merged(matches):
    """Quantities of equal matches put together: a lot may be cut where a part ends."""
    out = {}
    for m in matches:
        key = (m[:3], m[4:8])
        q, p = out.get(key, (0.0, 0.0))
        out[key] = (round(q + m[3], 6), round(p + m[8], 5))
    return out


@pytest.mark.parametrize(("bucket", "rows"), [("month", 10_000), ("year", 3), ("week", 7)])
def test_matches_equal_a_fold(spark, monkeypatch, bucket, rows):
    monkeypatch.setattr(rl, "ROWS", rows)
    for seed, hot in ((1, 0.0), (2, 0.6)):
        fills = corpus(seed, hot=hot)
        found = rl.fifo_matches(spark.createDataFrame(fills, TRADES).repartition(5), bucket).collect()
        assert merged(map(tuple, found)) == merged(fold(fills)[0])
        assert all(r.quantity > 0 for r in found)


@pytest.mark.parametrize("bucket", ["month", "year", "week"])
def test_average_cost_equals_a_fold(spark, bucket):
    for seed, hot in ((3, 0.0), (4, 0.6)):
        fills = corpus(seed, hot=hot)
        found = rl.average_cost(spark.createDataFrame(fills, TRADES).repartition(5), bucket)
        got = sorted((r.account_id, r.instrument_id, r.trade_date, r.l_orderkey, r.position, r.average_cost) for r in found.collect())
        wanted = sorted(fold(fills)[1], key=lambda r: r[:4])
        assert [g[:5] for g in got] == [w[:5] for w in wanted]
        for g, w in zip(got, wanted, strict=True):
            assert g[5] == (None if w[5] is None else pytest.approx(w[5], rel=1e-9)), (g, w)


def test_crossings_ties_and_partial_lots(spark, rows):
    fills = [
        trade(1, 10, 0, 5.0, 10), trade(1, 10, 1, 3.0, 12, 2), trade(1, 10, 2, -6.0, 20, 3),  # one lot whole, a third of the next
        trade(1, 11, 0, 2.0, 10), trade(1, 11, 1, -5.0, 11, 2), trade(1, 11, 2, 4.0, 9, 3),  # long, short, long
        trade(2, 10, 3, 1.0, 10, 1, 1), trade(2, 10, 3, -1.0, 15, 1, 2), trade(2, 10, 3, -1.0, 15, 1, 3),  # ties of one day
        trade(3, 10, 0, -2.0, 7), trade(3, 10, 1, -2.0, 9, 2), trade(3, 10, 5, 3.0, 5, 3),  # short all along
        trade(4, 10, 0, 2.0, 7), trade(4, 10, 1, 2.0, 7, 2), trade(5, 10, 0, 1.0, 7), trade(5, 10, 0, 1.0, 7),  # nothing closed; repeated rows
    ]
    found = rl.fifo_matches(spark.createDataFrame(fills, TRADES))
    D = [date(2020, 1, d) for d in range(1, 10)]
    assert rows(found) == sorted([
        (1, 10, "LONG", 5.0, D[0], 10.0, D[2], 20.0, 50.0), (1, 10, "LONG", 1.0, D[1], 12.0, D[2], 20.0, 8.0),
        (1, 11, "LONG", 2.0, D[0], 10.0, D[1], 11.0, 2.0), (1, 11, "SHORT", 3.0, D[1], 11.0, D[2], 9.0, 6.0),
        (2, 10, "LONG", 1.0, D[3], 10.0, D[3], 15.0, 5.0),
        (3, 10, "SHORT", 2.0, D[0], 7.0, D[5], 5.0, 4.0), (3, 10, "SHORT", 1.0, D[1], 9.0, D[5], 5.0, 4.0),
    ])
    assert rows(rl.realised_profit(found)) == [(1, 10, 6.0, 2, 58.0), (1, 11, 5.0, 2, 8.0), (2, 10, 1.0, 1, 5.0), (3, 10, 3.0, 2, 8.0)]


def test_nulls_and_no_fills(spark, rows):
    day = date(2020, 1, 1)
    fills = [(1, 10, day, "BUY", 2.0, 2.0, None, 1, 1, 1, 1.0), (1, 10, day, "SELL", 1.0, -1.0, 5.0, 2, 1, 1, 1.0), (1, 10, day, "BUY", None, None, 5.0, 3, 1, 1, 1.0), (None, None, day, "BUY", 2.0, 2.0, 3.0, 1, 1, 1, 1.0), (None, None, day, "SELL", 2.0, -2.0, 4.0, 2, 1, 1, 1.0), (None, None, day, "BUY", 1.0, 1.0, 9.0, 3, 1, 1, 1.0)]
    df = spark.createDataFrame(fills, TRADES)
    assert rows(rl.fifo_matches(df).select("account_id", "quantity", "profit")) == [(1, 1.0, None), (None, 2.0, 2.0)]
    assert rows(rl.average_cost(df).select("account_id", "l_orderkey", "position", "average_cost")) == [(1, 1, 2.0, None), (1, 2, 1.0, None), (None, 1, 2.0, 3.0), (None, 2, 0.0, None), (None, 3, 1.0, 9.0)]
    empty = spark.createDataFrame([], TRADES)
    assert rl.fifo_matches(empty).count() == 0 and rl.average_cost(empty).count() == 0


def test_holdings_of_one_direction_are_not_walked(spark, rows):
    fills = [trade(1, 10, 0, 2.0, 7), trade(1, 10, 1, 1.0, 8, 2), trade(2, 10, 0, -2.0, 7), trade(2, 10, 1, -1.0, 8, 2), trade(3, 10, 0, 2.0, 7), trade(3, 10, 1, -1.0, 8, 2), trade(4, 10, 0, 0.0, 7)]
    assert rows(rl._both_ways(spark.createDataFrame(fills, TRADES)).select("account_id").distinct()) == [(3,)]


def test_a_holding_with_most_fills_is_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rl, "ROWS", 40)
    hot = spark.range(12_000).selectExpr("IF(id % 6 = 0, id % 50, 1L) AS account_id", "1L AS instrument_id", "date_add(DATE '2001-01-01', CAST(id % 6000 AS INT)) AS trade_date", "IF(id % 3 = 0, 'SELL', 'BUY') AS side", "1D AS quantity", "IF(id % 3 = 0, -1D, 1D) AS signed_quantity", "CAST(id AS DOUBLE) AS price", "id AS l_orderkey", "1 AS l_linenumber", "1L AS l_suppkey", "1D AS l_extendedprice")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for found in (rl.fifo_matches(hot), rl.average_cost(hot)):
            sizes = [r[1] for r in found.groupBy(F.spark_partition_id()).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_prefix_maps_equal_a_loop():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 1000):
        first, scale, shift = rng.random(n) < 0.1, rng.choice([0.0, 0.5, 1.0, 0.9], n), rng.random(n)
        a, b, last = ordered.prefix_maps(first, scale, shift, (0.5, 2.0))
        own = (0.5, 2.0)
        for i in range(n):
            own = (1.0, 0.0) if first[i] else own
            assert (a[i], b[i]) == pytest.approx(own)
            own = (scale[i] * own[0], scale[i] * own[1] + shift[i])
        assert last == pytest.approx(own)
        both, pair = ordered.prefix_maps(first, scale, np.stack([shift, 2 * shift], axis=1), (0.5, 2.0)), ordered.prefix_maps(first, scale, 2 * shift, (0.5, 2.0))
        assert np.array_equal(both[1][:, 0], b) and np.array_equal(both[1][:, 1], pair[1]) and both[2][1].tolist() == [last[1], pair[2][1]]


@pytest.mark.parametrize("many", [5, 10_000])
def test_only_holdings_of_many_fills_are_cut(spark, monkeypatch, many):
    monkeypatch.setattr(rl, "MANY", many, raising=False)
    fills = corpus(4, hot=0.6)
    found = rl.average_cost(spark.createDataFrame(fills, TRADES).repartition(5))
    got = sorted((r.account_id, r.instrument_id, r.trade_date, r.l_orderkey, r.position, r.average_cost) for r in found.collect())
    wanted = sorted(fold(fills)[1], key=lambda r: r[:4])
    assert [(*g[:5], g[5] and round(g[5], 6)) for g in got] == [(*w[:5], w[5] and round(w[5], 6)) for w in wanted]
    if many == 10_000:
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()

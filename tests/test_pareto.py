import random

import numpy as np
import pytest

from tallyfold.operators import pareto

METRICS = "instrument_id long, mean double, risk double, momentum double"
BETTER = {"mean": "high", "risk": "low", "momentum": "high"}


def brute(rows):
    whole = [r for r in rows if all(v is not None and v == v for v in r[1:])]
    beats = lambda a, b: a[1] >= b[1] and a[2] <= b[2] and a[3] >= b[3] and a[1:] != b[1:]
    return sorted(r for r in whole if not any(beats(o, r) for o in whole))


def cloud(seed, n, steps):
    rng = random.Random(seed)
    return [(i, *(float(rng.randrange(steps)) for _ in range(3))) for i in range(n)]


@pytest.mark.parametrize(("n", "steps", "block"), [(600, 6, 8192), (600, 1000, 8192), (900, 1000, 10), (900, 40, 5), (0, 3, 8192), (1, 3, 8192)])
def test_equals_trying_all(spark, rows, monkeypatch, n, steps, block):
    monkeypatch.setattr(pareto, "BLOCK", block)
    points = cloud(n, n, steps)
    found = pareto.pareto_front(spark.createDataFrame(points, METRICS).repartition(9), BETTER, fan_in=2)
    assert found.columns == ["instrument_id", *BETTER] and rows(found) == brute(points)


def test_ties_nulls_and_nan(spark, rows):
    points = [(1, 2.0, 1.0, 0.0), (2, 2.0, 1.0, 0.0), (3, 2.0, 1.0, -1.0), (4, 9.0, 9.0, 9.0), (5, None, 0.0, 99.0), (6, 99.0, float("nan"), 99.0), (None, 0.0, 0.0, 0.0)]
    assert rows(pareto.pareto_front(spark.createDataFrame(points, METRICS), BETTER)) == sorted([(1, 2.0, 1.0, 0.0), (2, 2.0, 1.0, 0.0), (4, 9.0, 9.0, 9.0), (None, 0.0, 0.0, 0.0)], key=lambda r: (r[0] is None, r[0] or 0))


def test_a_front_of_all_rows_is_settled_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pareto, "BLOCK", 100)
    # mean and risk rise together, so nothing beats anything, and rounds don't shrink
    points = [(i, float(i), float(i), 0.0) for i in range(1500)]
    found = pareto.pareto_front(spark.createDataFrame(points, METRICS).repartition(8), BETTER)
    assert found.count() == 1500
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_front_of_points_whose_sums_are_rounded():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.choice([1e16, 1.0, 0.0, -1e16, 3.0], (300, 3)), rng.random((3000, 3))])
    wanted = [not any(((points >= p).all(axis=1)) & (points > p).any(axis=1)) for p in points]
    assert pareto.front(points).tolist() == wanted


def test_a_metric_is_high_or_low(spark):
    with pytest.raises(ValueError, match="'high' or 'low'"):
        pareto.pareto_front(spark.createDataFrame([], METRICS), {"mean": "big"})

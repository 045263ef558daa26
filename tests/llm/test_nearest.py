import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import nearest as nn
from tallyfold.llm.nearest import Quantised, inner_products, nearest, tile

VECTORS = "vec_id long, embedding array<float>, rank int, score string"


def plain(rows, k, every=5):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v, *_ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in good:
        if q % every == 0:
            scores = {}
            for i, y in good:
                if i != q and len(x) == len(y):
                    s = 0.0
                    for a, b in zip(x, y, strict=True):
                        s += a * b
                    scores[i] = max(s, scores.get(i, -np.inf))
            out |= {(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(((-s, i) for i, s in scores.items()))[:k]) for s in [-s]}
    return out


def found(spark, rows, k):
    df = nearest(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, k)
    return {tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(nn, "QUERY_BLOCK", 20)
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", 50)


def test_equals_brute_force_with_ties(spark, small_blocks):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0, "s") for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0, "s") for i in range(150)]  # a vector that a third of all rows have
    assert found(spark, rows, 7) == plain(rows, 7)


def test_nulls_zeros_lengths_repeats_and_few(spark):
    rows = [(0, [1.0, 0.0], 0, "s"), (1, None, 0, "s"), (2, [], 0, "s"), (3, [0.0, 0.0], 0, "s"), (4, [1.0, None], 0, "s"), (6, [float("nan"), 1.0], 0, "s"), (7, [float("inf"), 1.0], 0, "s"), (8, [1.0, 1.0, 1.0], 0, "s"), (9, [2.0, 5.0], 0, "s"), (9, [2.0, 5.0], 0, "s"), (10, [3.0, 1.0], 0, "s")]
    assert found(spark, [*rows, (None, [1.0, 1.0], 0, "s")], 20) == plain(rows, 20) == {(0, 1, 10, 3.0), (0, 2, 9, 2.0), (10, 1, 9, 11.0), (10, 2, 0, 3.0)}
    assert found(spark, [], 20) == set()


@pytest.mark.parametrize("k", [2, 7])
def test_repeats_fill_no_places(spark, k):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0, "s") for i in range(90)]
    rows += rows[:30] + 20 * [(91, [3 * x for x in rows[0][1]], 0, "s")]  # whole rows again, and one near vector often
    rows += [(92 + j % 2, (np.array(rows[5][1]) * (2 + j / 10)).round(1).tolist(), 0, "s") for j in range(40)]  # identifiers of many vectors
    assert found(spark, rows, k) == plain(rows, k)


def test_repeats_fill_no_places_across_tiles(spark, small_blocks):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0, "s") for i in range(120)]
    assert found(spark, rows * 3, 7) == plain(rows, 7)


def test_bounds_lose_nothing_on_near_ties():
    rng = np.random.default_rng(5)
    base = rng.normal(size=64)
    x = base + rng.normal(size=(400, 64)) * 1e-4
    q = Quantised(x[:40])
    best = tile(q, Quantised(x), np.arange(40), np.arange(400), 10)
    for i, b in enumerate(best):
        scores = inner_products(np.tile(x[i], (400, 1)), x)
        want = sorted((-s, j) for j, s in enumerate(scores.tolist()) if j != i)[:10]
        assert b == want


def test_extreme_components_take_part(spark):
    rows = [(0, [1e200, 0.0]), (5, [1.0, 2.0]), (6, [1e200, 1e200]), (7, [-1e200, 1.0]), (8, [5e-324, 0.0]), (9, [3.0, 1e-200]), (10, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in nearest(df, F.col("vec_id") % 5 == 0, 6).select("query_id", "rank", "vec_id", "score").collect()}
    want = set()
    for q, (a, b) in rows:
        if q % 5 == 0:
            scores = sorted((-(-np.inf if np.isnan(s := a * c + b * d) else s), i) for i, (c, d) in rows if i != q)
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    assert got == want and (0, 1, 6, np.inf) in got


def test_long_vectors_make_smaller_blocks(spark, monkeypatch):
    monkeypatch.setattr(nn, "BLOCK_BYTES", 8 * 8 * 20)
    tiles = []
    monkeypatch.setattr(nn, "_blocks", lambda n, was=nn._blocks: tiles.append(n) or was(n))
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).round(1).tolist(), 0, "s") for i in range(100)]
    assert found(spark, rows, 7) == plain(rows, 7)
    assert tiles == [2, 6]

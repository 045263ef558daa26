import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import periodic_runs as pr
from tallyfold.llm import queries

DOCS = "doc_id long, text string, runs string, start int"


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute(words):
    """All runs by trying each period at each place."""
    n, found = len(words), set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and smallest_period(words[i : i + length]) == q:
                found.add((i, q, length))
            i = j + 1
    return [(s, m, q) for s, q, m in sorted(found)]


def plain(doc_id, text):
    """The row of the query, by its definition."""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(words):
    return [tuple(r) for r in zip(*(x.tolist() for x in pr.runs_of(np.array(words, np.int64))), strict=True)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(words):
    assert found(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 7)), max_size=8))
def test_runs_of_planted_powers(parts):
    words = [w for part, k in parts for w in part * k]
    assert found(words) == brute(words)


def test_long_periods_and_the_path_for_many_words(monkeypatch):
    rng = np.random.default_rng(1)
    for period in (1, 2, 3, 63, 64, 65, 127, 128, 129, 300):
        words = np.concatenate([rng.integers(0, 9, 50), np.tile(rng.integers(0, 1000, period), 5)[: 4 * period + period // 2 + 4], rng.integers(2000, 3000, 40)])
        assert found(words.tolist()) == brute(words.tolist())
        # as if names and places didn't fit one number
        assert [x.tolist() for x in pr.runs_of(words)] == [x.tolist() for x in pr.runs_of(words << 45)]


def texts():
    rng = np.random.default_rng(7)
    out = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 + i % 4 * 30, rng.integers(0, 120)))) for i in range(200)]
    line = "in allen teilen der welt "
    return out + [(500, None), (501, ""), (502, " \n\t "), (503, "a " * 500), (504, line * 40 + "ende"), (504, line * 40 + "ende"), (None, "b " * 90), (None, None), (505, "é\x85x " * 9 + "\n" + "\x1cq\x0b" * 7)]


def test_query_equals_plain(spark, tmp_path):
    rows = texts()
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 10
    docs = spark.createDataFrame([(*r, "own", 3) for r in rows], DOCS)
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    key = lambda r: tuple((v is None, v or 0) for v in r[:2]) + tuple(r[6:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain(*r) for r in rows), key=key)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_small_steps_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "own", 3) for r in texts()], DOCS).repartition(2)
    wanted = sorted(map(str, pr.find_runs(docs).collect()))
    monkeypatch.setattr(pr, "STEP", 50)
    monkeypatch.setattr(pr, "OUT", 200)
    step = sorted(map(str, pr.find_runs(docs).collect()))
    assert step == wanted and pr.find_runs(docs).columns == ["doc_id", "n_words", "runs", "collapsed"]


def test_one_very_long_text(spark):
    text = "start " + "eins zwei drei " * 400_000
    row = pr.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 1_200_000, 3)] and row.collapsed == "start eins zwei drei"


def test_empty_table(spark):
    assert pr.find_runs(spark.createDataFrame([], DOCS)).count() == 0

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import collocations as cl

DOCS = "doc_id long, text string, lang string, n long, w1 string"


def brute(rows, min_count, top, contained):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= min_count and len(p) > 2}
    gone = set()
    for (lang, *words), a in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, *words[i : i + k])
                if 100 * a >= contained * candidates[part]:
                    gone.add(part)
    found = {}
    for p, a in candidates.items():
        if p in gone:
            continue
        lang, words = p[0], p[1:]
        cuts = [(2_000_000 * a // (f[lang, *words[:k]] + f[lang, *words[k:]]), k, f[lang, *words[:k]], f[lang, *words[k:]]) for k in range(1, len(words))]
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, best in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "ça", "日本"]
    line = "in allen Teilen der alten Welt"
    rows = []
    for i in range(n):
        lang = rng.choice(["en", "en", "de", None, "und"])
        text = " ".join(rng.choice(words[: rng.choice([5, 20, 43])]) + rng.choice(["", "", "", ".", ",\t", "!\n"]) for _ in range(rng.randint(0, 90)))
        if i % 3 == 0:
            text = f"{line} {text} a B\u0085c, {rng.choice(['x1', 'x2', 'x3'])} pq rs. a b"
        rows.append((i, text, lang, 0, "own"))
    return rows + [(1, None, "en", 0, "own"), (1, "", None, 0, "own"), (None, "w1 w2 w3   w4 " * 50, "xx", 0, "own"), rows[0], rows[0]]


@pytest.mark.parametrize(("min_count", "top", "contained"), [(2, 10_000, 80), (3, 7, 80), (5, 3, 50), (4, 40, 100), (30, 5, 80)])
def test_equals_brute(spark, min_count, top, contained):
    rows = corpus(min_count)
    found = cl.collocations(spark.createDataFrame(rows, DOCS).repartition(3), min_count=min_count, top=top, contained=contained)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == brute(rows, min_count, top, contained)


def test_several_rounds_where_the_best_pairs_are_dropped(spark, monkeypatch):
    # pairs of long fixed lines score highest and are all dropped, so the first rounds settle nothing
    rng = random.Random(1)
    lines = [" ".join(f"l{k}_{i}" for i in range(4)) for k in range(60)]
    rows = [(i, " . ".join(rng.sample(lines, 20)) + " . " + " ".join(f"w{rng.randrange(9)}" for _ in range(60)), "en", 0, "") for i in range(60)]
    levels = []
    counted = cl._Search.levels
    monkeypatch.setattr(cl._Search, "levels", lambda self, k, open_: levels.append(found := counted(self, k, open_)) or found)
    found = cl.collocations(spark.createDataFrame(rows, DOCS), min_count=5, top=80)
    assert sorted(map(tuple, found.collect())) == brute(rows, 5, 80, 80)
    assert len(levels) > 2


def test_bitmaps_that_let_nearly_all_through_change_nothing(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(cl, "BITS", 5)
    monkeypatch.setattr(cl, "SEGMENT", 2)
    monkeypatch.setattr(cl, "BLOCK_WORDS", 500)
    docs = spark.createDataFrame(rows, DOCS).repartition(2)
    original = cl.Bitmap.__init__

    def small_map(self, phrases):
        original(self, phrases)
        assert self.bits == 16 or self.bits == 5

    monkeypatch.setattr(cl.Bitmap, "__init__", small_map)
    assert sorted(map(tuple, cl.collocations(docs, min_count=3, top=25).collect())) == brute(rows, 3, 25, 80)


def test_words_that_share_a_hash_start_again(spark, monkeypatch):
    rows = corpus(4, 40)
    salts = []
    made = cl._numbered

    def numbered(salt):
        salts.append(salt)
        return made(salt)

    monkeypatch.setattr(cl, "_numbered", numbered)
    shared = cl._words
    monkeypatch.setattr(cl, "_words", lambda blocks: shared(blocks).withColumn("h", F.lit(1).cast("long")) if len(salts) == 1 else shared(blocks))
    found = cl.collocations(spark.createDataFrame(rows, DOCS), min_count=3, top=25)
    assert sorted(map(tuple, found.collect())) == brute(rows, 3, 25, 80) and salts == [0, 1]


def test_scores_are_exact(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(500):
        a = rng.randrange(1, 10 ** rng.randrange(2, 16))
        rows.append((a, a + rng.randrange(3 * a), a + rng.randrange(10 ** rng.randrange(1, 16))))
    rows += [(7, 7, 7), (10**15, 10**15, 4 * 10**15)]
    df = spark.createDataFrame(rows, "n long, x long, y long").withColumn("s", cl.score("n", "x", "y"))
    assert all(r.s == 2_000_000 * r.n // (r.x + r.y) for r in df.collect())


def test_empty_tables(spark):
    assert cl.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert cl.collocations(spark.createDataFrame([(1, None, None, 0, ""), (2, " . ", "en", 0, "")], DOCS)).count() == 0

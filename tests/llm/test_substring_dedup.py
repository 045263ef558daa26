import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import substring_dedup as sd
from tallyfold.llm.substring_dedup import among, remove_repeats, word_digests

DOCS = "doc_id long, text string, block string, kept string"


def plain(rows, width):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    order = lambda i: (i is None, i)
    for i, w in sorted(words, key=lambda r: (r[0] is None, r[0] or 0)):
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, w in words:
        keep = [True] * len(w)
        for k in range(len(w) - width + 1):
            if order(first[tuple(w[k : k + width])]) < order(i):
                keep[k : k + width] = [False] * width
        out.append((i, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return sorted(out, key=str)


def found(spark, rows, width):
    df = remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3), width)
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(sd, "SKETCH_BYTES", 7000)
    monkeypatch.setattr(sd, "SLICE_BYTES", 9000)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    passage = " ".join(f"p{k}" for k in range(30))
    out = []
    for i in range(n):
        words = [f"w{k}" for k in rng.integers(0, 6, rng.integers(0, 60))]
        if i % 3 == 0:
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passage.split()[int(rng.integers(0, 10)) :]
        out.append((int(i), " ".join(words), "x", "y"))
    return out + [(n + k, out[k][1], "x", "y") for k in range(0, n, 4)]


def test_equals_plain_over_many_blocks(spark, small_blocks):
    for width in (3, 13):
        rows = corpus(width, 150)
        assert found(spark, rows, width) == plain(rows, width)


def test_equals_plain_when_the_sketch_is_far_too_narrow(spark, small_blocks, monkeypatch):
    monkeypatch.setattr(sd, "CELLS_PER_BYTE", 0)
    rows = corpus(1, 200)
    assert found(spark, rows, 5) == plain(rows, 5)


def test_nulls_short_long_spaces_repeats_and_empty(spark):
    long = "é x \x00 a\x00 " + "q" * 5000 + " "
    rows = [(5, None, "b", "k"), (6, "", "b", "k"), (7, " \t\n\x0b\x0c\r ", "b", "k"), (8, "a b", "b", "k"), (9, "a b c d", "b", "k"), (10, " a\tb\nc  d e", "b", "k"), (1, long * 300, "b", "k"), (2, long * 2, "b", "k"), (2, long * 2, "b", "k"), (None, "a b c z", "b", "k")]
    assert found(spark, rows, 3) == plain(rows, 3)
    assert found(spark, [], 3) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab\x00\x01 \t\né ", max_size=30), max_size=8))
def test_words_have_their_own_digests(texts):
    data = [t.encode() for t in texts]
    words = [w for t in data for w in t.split()]
    digests, counts = word_digests(data)
    assert counts.tolist() == [len(t.split()) for t in data]
    keys = list(map(bytes, digests))
    assert len(keys) == len(words) and len(set(zip(keys, words, strict=True))) == len(set(keys)) == len(set(words))


def test_digests_do_not_depend_on_place():
    short, counts = word_digests([b"word " * 3, b"x word"])
    far, _ = word_digests([b"y " * sd.CHUNK, b"z " + b"word"])
    assert (short[0] == far[-1]).all() and (short[0] == short[4]).all() and counts.tolist() == [3, 2]


def test_among():
    values = np.array([1, 5, 9], np.uint64)
    assert among(values, np.array([5, 7], np.uint64)).tolist() == [False, True, False]
    assert not among(values, np.zeros(0, np.uint64)).any()


def test_bitmaps_count_blocks():
    rng = np.random.default_rng(5)
    lists = [np.unique(rng.integers(1000, 3000, 300)).astype(np.uint64) for _ in range(5)]
    maps = sd.Bitmaps(1000, 2000)
    for cells in [*lists, np.zeros(0, np.uint64)]:
        maps.add(cells)
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    assert (maps.met_twice(values) == (counts > 1)).all()


def test_rows_to_the_sketch_are_those_of_bundles(spark, small_blocks, monkeypatch):
    assert [sd.bundled(n, 8) for n in (1, 8, 16, 31, 1000)] == [1, 1, 2, 3, sd.BUNDLE]
    rows = corpus(7, 300)
    for bundle in (1, 3):
        monkeypatch.setattr(sd, "bundled", lambda *_, b=bundle: b)
        assert found(spark, rows, 5) == plain(rows, 5)
    # two rows of the sketch, two slices each: a bundle sends four rows at most, however many blocks it has
    table = pa.table({"block": [k % 6 for k in range(len(rows))], "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    sent = sd._sketched(5, 16, 2)((pa.scalar(3),), table)
    assert sent.num_rows == 4 and all(len(c) == 6 for c in sent["cells"].to_pylist())


def test_the_largest_identifier_and_none_at_all(spark, small_blocks):
    rows = [(sd.LAST, "a b c d", "x", "y"), (None, "a b c d", "x", "y"), (None, "a b c e", "x", "y")]
    assert found(spark, rows, 3) == [(sd.LAST, 4, 0, "a b c d"), (None, 4, 0, "a b c d"), (None, 4, 0, "a b c e")]

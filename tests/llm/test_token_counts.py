import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfold.llm import token_counts as tc
from tallyfold.llm.token_counts import ChunkCounter, count_tokens, prove_whole

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string, n_bytes string"
TEXTS = [None, "", " \n\t", "Hello World, it's", "x<|endoftext|>y <|startoftext|>", "<|endof text|>", "ΑΣ ΟΔΟΣ ß İ", "日本語🙂🙂 é", "a" * 3000, "1234567", " a b\x1cc\x85d", "the " * 30_000, "\U00032808 \U0003f808", "Hello World, it's"]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


@pytest.fixture(scope="module")
def counter(vocabulary):
    return ChunkCounter(vocabulary, prove_whole(vocabulary))


def wanted(counter, text):
    return len(counter.library.encode(text or "", add_special_tokens=False).ids)


def test_equals_the_library(spark, counter):
    docs = spark.createDataFrame([(i % 9, t, "own", "own") for i, t in enumerate(TEXTS)], DOCS)
    found = sorted(map(tuple, count_tokens(docs, PATH).select("doc_id", "n_bytes", "n_tokens").collect()))
    assert found == sorted((i % 9, len((t or "").encode()), wanted(counter, t)) for i, t in enumerate(TEXTS))
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_whole_strings_are_one_token(counter):
    some = sorted(counter.whole)[::97]
    assert len(counter.whole) > 30_000 and all(wanted(counter, t) == 1 for t in some)


def test_forgetting_changes_nothing(vocabulary, counter, monkeypatch):
    monkeypatch.setattr(tc, "MEMORY", 2)
    own = ChunkCounter(vocabulary, counter.whole)
    texts = [t or "" for t in TEXTS]
    assert [own.count([t])[0] for t in texts] == own.count(texts) == [wanted(counter, t) for t in texts]


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=40))
def test_any_text(counter, text):
    assert counter.count([text]) == [wanted(counter, text)]


def test_every_character(counter):
    texts = [f"a{chr(c)}a 1{chr(c)}1 {chr(c)}{chr(c)}! A{chr(c)}É" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 17 == 0)]
    assert counter.count(texts) == [len(e.ids) for e in counter.library.encode_batch(texts, add_special_tokens=False)]


def test_ascii_is_normalised_as_the_vocabulary_says(vocabulary):
    import json

    own = json.loads(vocabulary)
    assert tc.ascii_normaliser(vocabulary) is str.lower
    for normaliser, wanted in ((None, str), ({"type": "NFC"}, str), ({"type": "Strip", "strip_left": True, "strip_right": True}, None)):
        own["normalizer"] = normaliser
        assert tc.ascii_normaliser(json.dumps(own)) is wanted
    own["normalizer"] = None
    cased = json.dumps(own)
    counter = ChunkCounter(cased, prove_whole(cased))
    texts = ["Hello WORLD", "the THE The", "ÉCOLE école"]
    assert counter.count(texts) == [len(counter.library.encode(t, add_special_tokens=False).ids) for t in texts]

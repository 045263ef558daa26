import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken

from tallyfold.llm import bpe
from tallyfold.llm.bpe import decode, encode, pack_words, ranks_of, read_ranks, unpack_words
from tallyfold.llm.common import pack, pack_sorted, unpack, unpack_sorted

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, ids string, block int"
TEXTS = [None, "", "Hello  world", "it's I'LL\n\n\tx ", "日本語 ñé 🙂🙂", "<|endoftext|>", "a" * 5000 + " " * 3000, "1234 5 ٣", " x\u0085y\x1cz﻿", "the " * 2000, "Hello  world", "é \u0000\u0001"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(read_ranks(RANKS)), special_tokens={})


def ids_of(r):
    return np.frombuffer(r.ids, "<u4").tolist()


@pytest.mark.parametrize("block", [bpe.BLOCK_BYTES, 3000])
def test_equals_the_library_and_comes_back(spark, library, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 4000)
    docs = spark.createDataFrame([(i % 9, t, "own", 1) for i, t in enumerate(TEXTS)], DOCS).repartition(2)
    encoded = encode(docs, RANKS, public_tokenizers.PATTERN)
    wanted = sorted((i % 9, library.encode_ordinary(t or ""), t or "") for i, t in enumerate(TEXTS))
    assert sorted((r.doc_id, ids_of(r)) for r in encoded.collect()) == [w[:2] for w in wanted]
    assert sorted((r.doc_id, ids_of(r), bytes(r.decoded).decode()) for r in decode(encoded, RANKS).collect()) == wanted
    both = encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert sorted((r.doc_id, ids_of(r), bytes(r.decoded).decode()) for r in both.collect()) == wanted


def test_a_block_sends_a_row_to_each_slice_at_most():
    words = [f"w{i}" for i in range(5000)]
    for n_slices in (1, 7, 64):
        block = bpe._Block()
        block.add(1, words, 0)
        block.add(2, words[:3], 0)
        kinds = {"block": pa.int64(), "slice": pa.int32(), "doc_ids": pa.list_(pa.int64()), "often": pa.int32()} | dict.fromkeys(("codes", "lengths", "words"), pa.binary())
        rows = block.rows(0, n_slices, pa.schema(list(kinds.items()))).to_pylist()
        assert len(rows) == 1 + n_slices and [r["slice"] for r in rows] == [None, *range(n_slices)]
        assert sorted(w for r in rows[1:] for w in unpack_words(r["lengths"], r["words"])) == sorted(w.encode() for w in words)


def test_slices_are_no_more_than_partitions(spark, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 10)
    monkeypatch.setattr(bpe, "MEMORY", 0)
    docs = spark.createDataFrame([(i, f"word{i} word{i + 1}", "own", 1) for i in range(300)], DOCS).repartition(3)
    seen = []
    monkeypatch.setattr(bpe, "settle", lambda df: seen.append(df) or df)
    assert encode(docs, RANKS, public_tokenizers.PATTERN).count() == 300
    assert seen[0].select("slice").where("slice IS NOT NULL").distinct().count() <= 4


def test_only_empty_texts_and_no_rows(spark):
    docs = spark.createDataFrame([(1, None, "o", 1), (None, "", "o", 1)], DOCS)
    assert sorted((r.doc_id is None, bytes(r.ids)) for r in encode(docs, RANKS, public_tokenizers.PATTERN).collect()) == [(False, b""), (True, b"")]
    assert encode(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_identifiers_of_other_types(spark, library):
    docs = spark.createDataFrame([("k", "some words")], "key string, body string")
    r = encode(docs, RANKS, public_tokenizers.PATTERN, "key", "body").first()
    assert r.doc_id == "k" and ids_of(r) == library.encode_ordinary("some words")


def test_null_ids_decode_to_null(spark):
    assert decode(spark.createDataFrame([(1, None)], "n int, ids binary"), RANKS).first().decoded is None


def test_pre_tokens_are_those_of_the_library(library):
    find = regex.compile(public_tokenizers.PATTERN).findall
    for c in [*range(0x3000), *range(0x10000, 0x10400), 0x1F600, 0xE0001]:
        text = f"a{chr(c)}a 1{chr(c)}1 {chr(c)}{chr(c)}! {chr(c)}\n{chr(c)} "
        assert library.encode_ordinary(text) == [i for p in find(text) for i in library._encode_single_piece(p.encode())], hex(c)


def test_packing_comes_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        values = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert (unpack(pack(values), np.uint64) == values).all()
        assert (unpack_sorted(pack_sorted(np.sort(values))) == np.sort(values)).all()
    words = [b"a", b"", b"\n b", "é".encode()]
    assert unpack_words(*pack_words(words)) == words and unpack_words(*pack_words([])) == []

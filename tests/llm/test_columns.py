"""Functions that return the caller's columns, over documents that have columns of each name that the library uses within."""

import numpy as np
import public_tokenizers
import pytest

from tallyfold.llm import bpe, exact_dedup, language, mixing, near_dedup, sharding

OWN = ("doc_id", "text", "lang", "source")
NAMES = """row node token own shared n mark mark_id mark_sha gone judged decoded shard slot of none name lot curve lead together level level0 dim0 dim1 key0 nth at at0 kept
keep_id group_size text_sha256 component_id n_shingles size turn rate col ids _hash _parts _part _group _rank _n _lot _token _own _node _rows _shared _copy _rate _judged _key0 _row _order""".split()


def table(spark, repeat):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    texts += [texts[0], texts[1], texts[2] + " more", texts[3] + " again"]
    ids = [*range(16), *([None, 4] if repeat else [])]
    texts += [texts[5] + " end", texts[4]] if repeat else []
    rows = [(i, t, "en", f"s{k % 3}", *(f"{name}-{k}" for name in NAMES)) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {', '.join(f'{n} string' for n in NAMES)}").repartition(3)


def unchanged(found, docs, without=()):
    own = [c for c in docs.columns if c not in without]
    rows = {tuple(r) for r in docs.select(*own).collect()}
    got = [tuple(r) for r in found.select(*own).collect()]
    assert got and set(got) <= rows
    return got


@pytest.mark.parametrize("repeat", [False, True])
def test_deduplication(spark, repeat):
    docs = table(spark, repeat)
    assert len(unchanged(exact_dedup.drop_exact_duplicates(docs), docs)) == 14 + repeat
    assert len(unchanged(near_dedup.drop_near_duplicates(docs), docs)) == 12
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("few", [True, False])
def test_mix(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "is_small", lambda df: few)
    docs = table(spark, True)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and len(unchanged(mixed, docs)) > 18


def test_language(spark):
    docs = table(spark, True)
    network = language.ByteNetwork(["en", "fr"])
    assert unchanged(language.keep_known(docs, network, min_score=0.0), docs) and language.keep_known(docs, network).columns == docs.columns
    assert unchanged(language.predict(docs, network), docs, ["text"])


def test_decode(spark):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = table(spark, False)
    ids = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    encoded = docs.drop("ids").join(ids, "doc_id")
    found = bpe.decode(encoded, ranks)
    assert sorted(found.columns) == sorted(encoded.columns)
    assert all(bytes(r.decoded).decode() == r.text for r in found.collect())
    unchanged(found, encoded, ["decoded", "ids"])
    other = bpe.decode(encoded, ranks, decoded_col="bytes")
    assert sorted(other.columns) == sorted([*encoded.columns, "bytes"]) and unchanged(other, encoded, ["ids"])


def test_shards(spark, tmp_path):
    docs = table(spark, True)
    placed = sharding.hilbert_shards(docs, ["lang", "source"], 3, ["doc_id", "text"], together="text")
    assert sorted(placed.columns) == sorted(docs.columns)
    unchanged(placed, docs, ["curve", "shard", "slot"])
    assert sorted(r.shard for r in placed.collect()) == [0] * 6 + [1] * 6 + [2] * 6
    unchanged(sharding.with_curve(docs, ["lang", "source"]), docs, ["curve"])
    meta = sharding.document_metadata(docs, ["lang", "source"])
    placed = sharding.hilbert_shards(meta, ["lang", "source", "size"], 4, ["doc_id", "size"])
    names = sharding.write_shards(docs, placed, f"{tmp_path}/out")
    assert names == ("shard_1", "slot_1")
    written = spark.read.parquet(f"{tmp_path}/out")
    assert len(unchanged(written, docs)) == 18 and sorted(r.shard_1 for r in written.collect()) == sorted(r.shard for r in placed.collect())

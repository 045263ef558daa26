"""The stages of the pipeline against plain versions, on documents made to have what each stage looks for."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyfold.llm import language
from tallyfold.llm import pipeline as cp
from tallyfold.llm.bpe import ranks_of, read_ranks
from tallyfold.llm.near_dedup import shingles, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()
    extra = [(1000, None, "en", "src0", 0), (1001, "", "en", None, 0), (1002, "12 34 %%", "en", "src1", 8), (1003, real[0].text, "en", "src1", 9), (1004, real[1].text + " more", "en", "src2", 9), (None, "words of no identifier at all", None, None, 5)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([*map(tuple, real), *extra], DOCS).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in cp.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted((r.doc_id for r in rows), key=str)


def test_language_drops_what_the_network_cannot_tell(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = "pmod(crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)), 4) = 2"
    network = language.train(docs, ~F.expr(held_out))
    told = [r.doc_id for r in language.predict(docs.select("doc_id", "text"), network).collect() if r.lang_pred != "und" and r.score >= language.least_score(len(network.labels))]
    assert ids(stages["language"]) == sorted(told, key=str)
    gone = {r.doc_id for r in stages["documents"]} - {r.doc_id for r in stages["language"]}
    assert {1000, 1001, 1002} <= gone and len(gone) < 10


def test_exact_dedup_keeps_the_smallest_of_each_text(stages):
    first = {}
    for r in stages["language"]:
        if r.text not in first or r.doc_id is not None and r.doc_id < first[r.text]:
            first[r.text] = r.doc_id
    assert ids(stages["exact_dedup"]) == sorted(first.values(), key=str)


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    rows = sorted((r for r in stages["exact_dedup"] if r.doc_id is not None), key=lambda r: r.doc_id)
    sets = [shingles(words_of(r.text), 5) for r in rows]
    top = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top[i], top[j]
                top = [min(a, b) if t in (a, b) else t for t in top]
    assert ids(stages["near_dedup"]) == sorted([*(r.doc_id for k, r in enumerate(rows) if top[k] == k), None], key=str)
    assert len(stages["near_dedup"]) < len(stages["exact_dedup"])


def test_mixing_repeats_documents_to_one_and_a_half_times_the_words(stages):
    before, after = (sum(len(words_of(r.text)) for r in stages[s]) for s in ("near_dedup", "mixing"))
    assert abs(after / before - 1.5) < 0.05
    assert set(map(tuple, stages["mixing"])) <= set(map(tuple, stages["near_dedup"]))


def test_tokens_are_those_of_the_library_and_come_back(stages):
    import hashlib

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(read_ranks(public_tokenizers.path(cp.RANKS))), special_tokens={})
    wanted = sorted((str(r.doc_id), library.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages["mixing"])
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), r.decoded_sha256) for r in stages["bpe"]) == wanted
    assert all(r.n_tokens == len(r.ids) // 4 for r in stages["bpe"])


def test_run_is_all_stages(spark, folder, stages, tmp_path):
    found = cp.run(spark, folder, f"{tmp_path}/stages")
    assert sorted(map(str, found.collect())) == sorted(map(str, stages["bpe"]))
    assert sorted(p.name for p in (tmp_path / "stages").iterdir()) == sorted(name for name, _ in cp.STAGES[:-1])


def test_stages_keep_the_columns(stages):
    for name, rows in stages.items():
        assert name == "bpe" or rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0

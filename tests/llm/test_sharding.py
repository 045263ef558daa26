import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyfold.llm import sharding
from tallyfold.llm.sharding import document_metadata, hilbert_index, hilbert_shards, levels_of, write_shards

DOCS = "doc_id long, text string, lang string, source string, shard string"


def test_curve_visits_each_cell_once_by_single_steps():
    side = np.arange(8)
    for dims in (2, 3):
        cells = np.stack(np.meshgrid(*[side] * dims), -1).reshape(-1, dims)
        index = hilbert_index(cells, 3)
        path = cells[np.argsort(index)]
        assert sorted(index.tolist()) == list(range(8**dims))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_levels():
    assert levels_of(np.array([[np.nan, 1.0], [5.0, 2.0], [6.0, 3.0]]), [[5.0], [1.0, 2.0]]).tolist() == [[0, 1], [1, 2], [2, 3]]


def placed(spark, docs, n):
    return hilbert_shards(document_metadata(docs, ["lang", "source"]), ["lang", "source", "size"], n, ["doc_id", "lang", "source", "size"], together="text_sha256")


def test_shards_are_even_and_slots_gapless(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "repeat('é', CAST(id % 50 AS INT)) AS text", "CASE WHEN id % 3 = 0 THEN 'en' ELSE 'fr' END AS lang", "CASE WHEN id % 3 < 2 THEN 'hot' ELSE CAST(id AS STRING) END AS source")
    found = placed(spark, docs, 40).collect()
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(found) == 1003 and set(by) == set(range(40))
    assert {len(v) for v in by.values()} == {25, 26} and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(r.size == 16 + 2 * (r.doc_id % 50) and r.text_crc32 == zlib.crc32(("é" * (r.doc_id % 50)).encode()) for r in found)
    texts = [r.text_crc32 for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    # equal texts follow each other
    assert 1 + sum(a != b for a, b in zip(texts, texts[1:], strict=False)) == len(set(texts))


def test_rows_follow_the_curve(spark):
    docs = spark.range(1003).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "CAST(id % 3 AS STRING) AS lang", "CAST(id % 29 AS STRING) AS source")
    order = [r.curve for r in sorted(placed(spark, docs, 40).collect(), key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_texts_are_told_apart_by_their_whole_values(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'same length ' AS text", "'en' AS lang", "concat('https://site', lpad(CAST(id % 200 AS STRING), 3, '0'), '.com') AS source")
    found = sharding.with_curve(document_metadata(docs, ["lang", "source"]), ["source"])
    levels = found.select("source", "curve").distinct().collect()
    assert len(levels) == 200 and len({r.curve for r in levels}) == 31
    assert [r.curve for r in sorted(levels)] == sorted(r.curve for r in levels)


def test_shards_prune_several_dimensions(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', CAST(id % 64 AS INT)) AS text", "CAST(id % 7 AS STRING) AS lang", "CAST(id % 31 AS STRING) AS source")
    size = (F.max("size") - F.min("size")).alias("spread")
    spread = placed(spark, docs, 40).groupBy("shard").agg(size).agg(F.avg("spread")).first()[0]
    assert spread < 40  # of 64 when rows are dealt at random


def test_nulls_repeats_few_rows_and_empty(spark):
    rows = [(None, None, None, None, "c"), (1, "", None, "s", "c"), (1, "", None, "s", "c"), (2, "x" * 100_000, "en", None, "c")]
    found = placed(spark, spark.createDataFrame(rows, DOCS), 40).collect()
    assert len(found) == 4 and len({r.shard for r in found}) == 4 and all(r.slot == 0 for r in found)
    assert placed(spark, spark.createDataFrame([], DOCS), 40).count() == 0


def test_written_shards_hold_whole_rows(spark, tmp_path):
    docs = spark.range(100).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "'en' AS lang", "'s' AS source")
    write_shards(docs, placed(spark, docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.where("text = CAST(doc_id AS STRING)").count() == 100 and back.select("shard").distinct().count() == 4


def test_written_shards_hold_null_and_repeated_identifiers(spark, tmp_path):
    rows = [(i, f"t{i}", "en", "s") for i in range(20)] + [(None, "a", "en", "s"), (None, "a", "en", "s"), (None, "a", "fr", None), (None, None, None, "s"), (None, "bb", "en", "s"), (3, "t3", "en", "s"), (3, "other", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    where = placed(spark, docs, 4)
    write_shards(docs, where, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(*docs.columns).collect()), key=str) == sorted(rows, key=str)
    places = ("doc_id", "lang", "source", "shard", "slot")
    assert sorted(map(tuple, back.select(*places).collect()), key=str) == sorted(map(tuple, where.select(*places).collect()), key=str)

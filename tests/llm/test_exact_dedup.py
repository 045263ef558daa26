import hashlib
import re

import pytest

from tallyfold.llm import common, exact_dedup
from tallyfold.llm.exact_dedup import drop_exact_duplicates, find_exact_duplicates

DOCS = "doc_id long, text string, keep_id string, run int"
ROWS = [(1, "a", "x", 0), (2, "a", "y", 0), (5, "a ", None, 1), (3, None, "z", 1), (4, "", "z", 1), (7, "é" * 40_000, "q", 2), (6, "é" * 40_000, "q", 2), (2, "a", "y", 0), (2, "b", "y", 0), (None, "a", "n", 0), (None, "n", "n", 0)]


def plain(rows, best):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for r in rows:
        ids = groups[r[1] or ""]
        keep = best((i for i in ids if i is not None), default=None)
        out.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    return out


def key(r):
    return tuple((v is None, v or 0) for v in r)


def test_equals_plain_grouping(spark):
    docs = spark.createDataFrame(ROWS, DOCS).repartition(5)
    for keep, best in (("min", min), ("max", max)):
        for fan_in in (2, 8):
            found = find_exact_duplicates(docs, keep=keep, fan_in=fan_in).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
            assert sorted(map(tuple, found.collect()), key=key) == sorted(plain(ROWS, best), key=key)


def test_large_group(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' ELSE CAST(id AS STRING) END AS text")
    found = find_exact_duplicates(docs)
    assert found.where("text_sha256 = sha2('same', 256)").select("keep_id", "group_size").distinct().collect() == [(0, 1000)]
    assert found.where("kept").count() == 2001


def test_drop_keeps_columns_and_one_text(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = sorted((r.text or "", r.doc_id or 0) for r in kept.collect())
    assert texts == sorted([("a", 1), ("a ", 5), ("", 3), ("é" * 40_000, 6), ("b", 2), ("n", 0)])


def test_drop_keeps_one_row_where_whole_rows_repeat(spark):
    rows = [*ROWS, *ROWS, *ROWS, (1, "a", "b", 7), (3, "", "z", 1)]
    kept = sorted(map(tuple, drop_exact_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()), key=str)
    assert kept == sorted([(1, "a", "b", 7), (5, "a ", None, 1), (3, "", "z", 1), (6, "é" * 40_000, "q", 2), (2, "b", "y", 0), (None, "n", "n", 0)], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert find_exact_duplicates(docs).count() == 0 and drop_exact_duplicates(docs).count() == 0


def test_no_python_in_the_plan(spark):
    plan = find_exact_duplicates(spark.createDataFrame(ROWS, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize(("partitions", "fan_in", "rounds"), [(8, 8, 2), (64, 8, 2), (4, 2, 2), (8, 2, 3), (100, 8, 3)])
def test_each_round_is_dealt_by_run_alone_and_merges_sorted_runs(spark, partitions, fan_in, rounds):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = exact_dedup._keyed(spark.range(500).selectExpr("id AS doc_id", "CAST(id % 300 AS STRING) AS text"), "doc_id", "text")
        plan = exact_dedup.merge_runs(rows, fan_in=fan_in)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(re.findall(r"Exchange hashpartitioning\(run#\d+L?, \d+\)", plan)) == rounds == plan.count("Exchange")
    assert plan.count("Sort [run") == rounds and plan.count("SortAggregate") == 2 * rounds and "HashAggregate" not in plan


def test_all_that_is_equal_ends_in_the_run_that_owns_it(spark):
    rows = exact_dedup._keyed(spark.range(2000).selectExpr("id AS doc_id", "CAST(id % 700 AS STRING) AS text").repartition(7), "doc_id", "text")
    for fan_in in (2, 3, 8):
        found = exact_dedup.merge_runs(rows, fan_in).collect()
        assert len(found) == 700 and sorted(r.keep_id for r in found) == list(range(700)) and sum(r.group_size for r in found) == 2000


def test_rows_of_one_identifier_in_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    docs = spark.range(900).selectExpr("CASE WHEN id % 2 = 0 THEN 5L ELSE id END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id % 9 AS STRING) END AS text")
    found = find_exact_duplicates(docs)
    assert found.where("text_sha256 = sha2('hot', 256)").select("keep_id", "group_size", "kept").distinct().collect() == [(5, 450, True)]
    assert found.count() == 900 and found.where("kept").count() == 450 + 9

"""Joins on a key that many rows have, with broadcasts off."""

import pytest
from pyspark.sql import functions as F

from tallyfold.llm import common, mixing, url_filter


@pytest.fixture
def few_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("8", "-1", "false"), strict=True):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def loads(df):
    """Rows of each partition."""
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_spread_keeps_partitions_near_the_mean(spark, few_broadcasts):
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS k", "id")
    others = spark.range(20_000).selectExpr("CAST(id AS STRING) AS k", "id AS v").union(spark.createDataFrame([("hot", -1), ("hot", -2), ("absent", 0)], "k string, v long"))
    counts = rows.groupBy("k").count().withColumnRenamed("count", "n")
    found = common.spread(rows, others, ["k"], counts, "n", 20_000, lot=F.col("id"))
    assert found.columns == ["k", "id", "v"]
    assert found.where("k = 'hot'").groupBy("v").count().collect() == [(-1, 10_000), (-2, 10_000)] or found.where("k = 'hot'").groupBy("v").count().orderBy("v").collect() == [(-2, 10_000), (-1, 10_000)]
    assert found.where("k <> 'hot' AND CAST(v AS STRING) = k").count() == 10_000 == found.where("k <> 'hot'").count()
    most = loads(found)
    assert max(most) < 2 * sum(most) / 8
    plain = rows.join(others, "k")
    assert max(loads(plain)) > 4 * sum(most) / 8


def test_rejoin_keeps_rows_without_a_group(spark, few_broadcasts):
    rows = spark.range(999).selectExpr("id", "id % 3 AS k").checkpoint()
    groups = spark.createDataFrame([(0, 333, "a"), (5, 1, "b")], "k long, n long, name string").checkpoint()
    found = common.rejoin(rows, groups, ["k"], "n")
    assert found.where("_group IS NULL").count() == 666 and found.where("_group.name = 'a'").count() == 333


def test_a_source_with_most_rows(spark, few_broadcasts):
    docs = spark.range(6000).selectExpr("id AS doc_id", "repeat('w ', CAST(1 + id % 5 AS INT)) AS text", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 5 = 1 THEN NULL ELSE concat('s', id % 900) END AS source").checkpoint()
    plan = mixing.plan(mixing._sized(docs, "doc_id", "text", "source"), mixing.WEIGHTS, 1.5, 2.0, mixing.TURNS)
    assert plan.count() == 362 - 1 or plan.count() > 300
    joined = mixing._by_source(docs, plan, F.xxhash64("doc_id"))
    most = loads(joined)
    assert joined.count() == 6000 and max(most) < 2 * sum(most) / 8
    whole = sorted(map(tuple, mixing.mixture(docs).select("doc_id", "taken", "target").collect()))
    mixed = {r.doc_id: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert all(taken == (1 + d % 5) * mixed.get(d, 0) for d, taken, _ in whole)


def test_urls_of_a_frequent_token(spark, few_broadcasts):
    pages = spark.range(8000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('http://www.x', id % 4000, '.com/a', id) END AS url")
    rules = url_filter.rule_table(spark, [("c", "*.com/*", "block"), ("x7", "||www.x7.com/", "allow"), ("all", "*1", "block")])
    targets = url_filter.judge_urls(pages, rules, url_filter.rule_table(spark, []))
    # token `com` and the empty one belong to all URLs
    found = targets.groupBy("rule", "verdict").count().collect()
    sevens = sum(1 for i in range(8000) if i % 3 and i % 4000 == 7)
    ones = sum(1 for i in range(8000) if i % 3 and str(i).endswith("1") and i % 4000 != 7)
    assert {tuple(r) for r in found} >= {(None, "allow", 2667)} and sum(r[2] for r in found) == 8000
    assert {r.rule: r["count"] for r in found if r.rule}.get("x7") == sevens
    assert sum(r["count"] for r in found if r.rule in ("c", "all")) == 8000 - 2667 - sevens and ones <= sum(r["count"] for r in found if r.rule == "all")

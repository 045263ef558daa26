import math

from tallyfold.operators import insights

DOCS = "doc_id long, text string, lang string, company_id string, n_chars long"


def test_company_terms(spark, rows):
    docs = spark.createDataFrame([(1, "Été été, common; rare", "fr", "A", 10), (2, "common. other other other", "en", "B", 10), (3, "", "en", "B", 0), (4, None, "en", "C", 0), (5, "x", "en", None, 1)], DOCS)
    found = rows(insights.company_terms(docs, 2), 6)
    two = round(math.log(2), 6)
    assert found == [("A", "rare", 1, 1, two, 2), ("A", "été", 2, 1, round(2 * math.log(2), 6), 1), ("B", "common", 1, 2, 0.0, 2), ("B", "other", 3, 1, round(3 * math.log(2), 6), 1)]


def test_document_summary(spark, rows):
    docs = spark.createDataFrame([(1, "a", "en", "A", 1), (2, "a", "en", "A", 3), (3, "b", "fr", "A", 5)], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert rows(insights.document_summary(docs, labels)) == [("A", "en", 2, 1, 2.0, 0.5, 1.0, 0.0), ("A", "fr", 1, 1, 5.0, 0.0, None, None)]


def test_texts_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "A", 1), (2, "b", "en", "B", 1)], DOCS)
    plan = insights.company_terms(docs, 1)._jdf.queryExecution().executedPlan().toString()
    # all that is left reads the settled counts
    assert "Generate" not in plan and "split" not in plan and "text#" not in plan


def test_no_text_is_shuffled_for_the_summary(spark, tmp_path):
    spark.createDataFrame([(1, "a", "en", "A", 1)], DOCS).write.parquet(f"{tmp_path}/d")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    plan = insights.document_summary(spark.read.parquet(f"{tmp_path}/d"), labels.hint("merge"))._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.split("\n") if "Exchange" in line or "Join" in line or "Aggregate" in line]
    assert above and not any("text#" in line for line in above)


def test_company_profile_keeps_companies_without_data(spark, rows):
    companies = spark.createDataFrame([(1, "a"), (2, "b")], "instrument_id long, name string")
    risk = spark.createDataFrame([(1, 0.5)], "instrument_id long, mean double")
    beta = spark.createDataFrame([(1, 9, 1.5)], "instrument_id long, observations long, beta double")
    momentum = spark.createDataFrame([(2, 0.1)], "instrument_id long, momentum double")
    fall = spark.createDataFrame([(1, -0.5)], "instrument_id long, max_drawdown double")
    assert rows(insights.company_profile(companies, risk, beta, momentum, fall)) == [(1, "a", 0.5, 1.5, None, -0.5), (2, "b", None, None, 0.1, None)]

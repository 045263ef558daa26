import pytest

from tallyfold.plans import workloads as w
from tallyfold.sources import stored
from tallyfold.sources.tables import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def prefix(spark, tmp_path):
    tables = Tables(spark, SMALL)
    stored.store(tables, str(tmp_path), "fills_test", 5)
    yield "fills_test"
    stored.drop(spark, "fills_test")


def test_the_join_has_no_exchange_and_the_same_rows(spark, prefix):
    found, wanted = stored.stored_fills(spark, prefix), w.fills(Tables(spark, SMALL))
    assert stored.shuffles(found) == 0 and stored.shuffles(wanted.hint("merge")) >= 0
    assert found.columns == wanted.columns and found.count() == wanted.count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))


def test_a_bucket_is_one_sorted_file(spark, prefix, tmp_path):
    sizes = stored.bucket_sizes(spark, prefix).where("rows > 0").collect()
    assert {r.table for r in sizes} == {"orders", "lineitem"} and sum(r.rows for r in sizes if r.table == "orders") == 1500
    for name in stored.KEYS:
        assert len(list((tmp_path / name).glob("*.parquet"))) == 5


def test_tables_that_shuffle_are_refused(spark, prefix):
    spark.conf.set("spark.sql.sources.bucketing.enabled", "false")
    try:
        with pytest.raises(ValueError, match="without a shuffle"):
            stored.stored_fills(spark, prefix)
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.enabled")

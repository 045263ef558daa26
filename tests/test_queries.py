"""Registered queries against their SQL in DuckDB, and the tables they read."""

import math
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tallyfold.plans import oracle, registry
from tallyfold.sources.tables import SCHEMAS, Tables

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cells(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return (1, "")
        if isinstance(v, datetime):
            v = v.date()
        return (0, str(v)) if isinstance(v, (str, date, bool)) else (0, round(float(v), 6))

    return sorted([cell(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    found = registry.QUERIES[name](spark, SMALL)
    wanted = duck.execute(oracle.SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    assert cells(found.columns, found.collect()) == cells(names, wanted.fetchall())


def test_every_query_has_sql():
    assert registry.QUERIES.keys() == oracle.SQL.keys()


def test_entry_has_rows(spark):
    assert driver.entry(spark).limit(1).count() == 1


def test_missing_column_fails(spark, tmp_path):
    spark.createDataFrame([(1,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    with pytest.raises(ValueError, match="o_custkey, o_orderdate"):
        Tables(spark, str(tmp_path)).table("orders")


def test_empty_tables(spark, tmp_path):
    for name, columns in SCHEMAS.items():
        spark.createDataFrame([], ", ".join(f"{c} {k}" for c, k in columns.items())).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in registry.QUERIES.items():
        found = query(spark, str(tmp_path)).count()
        assert found == (1 if name == "o35_distinct_counts" else 0) or found <= (name == "o07_allocation"), name


def test_scan_reads_only_what_is_needed(spark):
    plan = registry.QUERIES["o06_concentration"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "l_discount" not in plan and "o_totalprice" not in plan

"""Registered queries against their SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from tallyfold.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = queries.QUERIES[name](spark, SMALL)
    wanted = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    cell = lambda v: (v is None, "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v))
    order = lambda ns, rows: sorted([cell(r[ns.index(n)]) for n in sorted(ns)] for r in rows)
    assert order(list(found.columns), found.collect()) == order(names, wanted.fetchall())


def test_all_operators_and_the_pipeline():
    numbers = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op"))
    assert numbers == list(range(1, len(numbers) + 1)) and "pipeline" in queries.QUERIES

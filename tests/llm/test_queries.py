"""Queries with SQL against DuckDB; the pipeline against a plain composition."""

import os

import pytest

from tidemark.llm import queries

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cur.fetchall()))


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{k}" for k in range(1, 11)} | {"pipeline"}

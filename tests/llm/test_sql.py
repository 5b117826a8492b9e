"""Queries with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from loomspan.llm.queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    df = QUERIES[name](spark, FOLDER)
    want = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = ", ".join(sorted(df.columns))
    rows = [tuple(r) for r in df.selectExpr(*columns.split(", ")).collect()]
    key = lambda r: [(v is not None, v if v is not None else 0) for v in r]
    a, b = sorted(rows, key=key), sorted(con.sql(f"select {columns} from ({ORACLE[name]})").fetchall(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=1e-8) if not any(isinstance(v, str) or v is None for v in x) else x == y

"""Every query with SQL against DuckDB on the smallest tables, and every other one for rows."""

import os

import duckdb
import pandas as pd
import pytest

from loomspan.plans.catalogue import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{FOLDER}/{f}')")
    return con


def table(pdf: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        if hasattr(v, "item"):
            v = v.item()
        return v

    pdf = pdf.astype(object)[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in row) for row in pdf.itertuples(index=False)), key=lambda r: [(v is not None, str(type(v)) if isinstance(v, str) else "", round(v, 3) if isinstance(v, float) else v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name].run(spark, FOLDER).toPandas()
    assert len(got)
    if QUERIES[name].sql:
        want = db.sql(QUERIES[name].sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = table(got), table(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert x == pytest.approx(y, rel=1e-9, abs=1e-9) if any(isinstance(v, float) for v in x) and not any(isinstance(v, str) or v is None for v in x) else all((p == q) or (isinstance(p, (int, float)) and isinstance(q, (int, float)) and abs(p - q) < 1e-6) for p, q in zip(x, y)), (x, y)

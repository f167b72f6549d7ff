"""Every training-data query with SQL against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gleanframe.llm import queries

TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{TINY}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, con, name):
    df = queries.queries()[name](spark, TINY)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = con.sql(queries.oracle_sql()[name])
    at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in at] == cols
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())

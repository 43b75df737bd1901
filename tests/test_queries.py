"""Every query with an SQL counterpart gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries_core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries_core.ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    result = duck.execute(queries_core.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(repr(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns))) for r in result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries_core.QUERIES) - set(queries_core.ORACLES)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5

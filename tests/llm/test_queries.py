"""Every query of the training-data operators with an SQL counterpart gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

from lodestone.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    result = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in result.fetchall())

"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else repr(round(v, 8))
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0

"""Every query with oracle SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from prismframe import catalog_more as catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    value = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return columns, sorted(map(repr, ([value(v) for v in r] for r in frame[columns].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_duckdb(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())

"""Every query with SQL against DuckDB on the smallest tables, and the shape of the driver's contract."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarry.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def cell(v):
    if v is None or not isinstance(v, (list, np.ndarray, dict)) and pd.isna(v):
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return f"{float(v):.5f}" if isinstance(v, (int, float, np.number)) else str(v)


def rows(df):
    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    ours, theirs = entry.queries()[name](spark, FOLDER).toPandas(), db.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() > 0

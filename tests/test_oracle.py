"""Every query that has SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f).split('.')[0]} as select * from '{f}'")
    return con


def value(v):
    if pd.isna(v):
        return None
    number = isinstance(v, float | int | np.number) and not isinstance(v, bool)
    return round(float(v), 5) + 0.0 if number else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, sf, duck, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 499

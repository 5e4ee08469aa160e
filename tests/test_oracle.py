"""Every registered query with SQL against DuckDB on the same tables: equal columns and equal rows in any order."""

import datetime
import decimal
import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, decimal.Decimal, np.number)):
        return round(float(v), 9)
    if isinstance(v, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(v).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    theirs = duck.sql(SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(theirs.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted((tuple(plain(r[i]) for i in at) for r in theirs.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

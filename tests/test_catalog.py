"""Every registered query with SQL equals DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows_of(pdf, cols):
    def clean(v):
        if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) else v

    return Counter(tuple(clean(v) for v in row) for row in pdf[cols].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.execute(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows_of(got, cols) == rows_of(want, cols)


def test_sql_only_for_registered():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "second", "model", "score"]
    assert df.count() > 0

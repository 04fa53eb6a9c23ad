"""Each registered query against its SQL in DuckDB over the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _value(v):
    if isinstance(v, (list, np.ndarray, dict)):
        return str(v)
    if v is None or pd.isna(v):
        return None
    return round(float(v), 6) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)


def _rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_value, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_matches_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and not n.startswith("op") and n != "pipeline"])
def test_runs(spark, sf, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows) or name == "near_dup_titles"  # the smallest table may have no near titles
    assert all(rows[c].notna().any() for c in rows.columns) or rows.empty, name


def test_every_sql_has_a_query(spark):
    assert set(ORACLE) <= set(QUERIES)
    assert entry.entry(spark).count() > 0

"""Every registered query against its DuckDB SQL on the smallest test data."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E

from conftest import SF_SMALL
from salesflow.plans import oracle

# The engine's own keys; the corpus operators' are tested with them.
SQL = oracle.oracle_sql(E.SNAPSHOT_MONTH)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _canon(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    got = _canon(E.queries()[key](spark, SF_SMALL).toPandas())
    want = _canon(duck.execute(SQL[key]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_every_query_has_oracle():
    corpus = {k for k in E.queries() if k == "pipeline" or k.startswith("op")}
    assert set(E.queries()) - corpus == set(SQL) - corpus
    assert set(SQL) <= set(E.oracle_sql())


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["order_month", "order_lines", "sales", "avg_amount"]
    assert df.count() > 0

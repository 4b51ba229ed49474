"""Spark queries vs the independent DuckDB oracle on the driver's sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from dunlin import api

SF = "/root/testdata/sf0.001"
TABLES = ["customer", "orders", "lineitem", "events"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def _key(rows):
    return sorted((tuple(_norm(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(k for k in E.oracle_sql() if k in api.registered_queries()))
def test_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[key])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    idx = [ocols.index(c) for c in df.columns]
    orows = [tuple(r[i] for i in idx) for r in res.fetchall()]
    assert _key(rows) == _key(orows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 1
    assert df.columns[:2] == ["WkstartDate", "WkendDate"]


def test_every_query_has_oracle_or_is_ml():
    # the library's own queries; optional packages test theirs beside them
    missing = set(api.registered_queries()) - set(E.oracle_sql())
    assert all(k.startswith("ml_") for k in missing), missing

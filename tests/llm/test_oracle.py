"""The queries that SQL can express, against DuckDB on the driver's small tables."""

import duckdb
import pytest

from dunlin.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[key](spark, SF)
    res = con.execute(Q.oracle_sql()[key])
    cols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(res.fetchall())


def test_queries_have_their_names():
    assert [int(k[2:].split("_")[0]) for k in Q.queries()] == list(range(1, 14))

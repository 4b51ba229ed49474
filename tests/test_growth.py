"""What a task or a pass costs follows the rows, not the number of partitions or of passes."""

import pytest

from dunlin import api
from dunlin.operators import recovery
from dunlin.plans import scorecard
from dunlin.sources import tables
from dunlin.sources.derived import from_testdata

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return from_testdata(spark, SF)


def text(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_partitions_by_loan_follow_the_loans(t, monkeypatch):
    want = recovery.recovery_wide(t, api.WEEKS).collect()
    monkeypatch.setattr(tables, "ROWS_PER_PART", 100)
    n = -(-t.loan_master.count() * len(api.WEEKS) // 100)
    fresh = t.with_()
    assert fresh.by_loan("bucket_flow", t.bucket_flow, api.WEEKS).rdd.getNumPartitions() == n > 8
    assert recovery.recovery_wide(fresh, api.WEEKS).collect() == want


def test_each_version_computes_its_own_periods(t):
    old, new = api._older_and_newer(t, api.WEEKS)
    # the bounds of the calls that are read; no row is computed and dropped
    assert "(call_at" in text(old) and "< 2024-01-15 00:00:00" in text(old) and "2024-01-29 00:00:00" not in text(old)
    assert ">= 2024-01-15 00:00:00" in text(new) and "< 2024-01-29 00:00:00" in text(new)


def test_a_fit_does_not_join_the_tables_again(t, monkeypatch):
    seen = []
    monkeypatch.setattr(scorecard, "hash_split", lambda df, *a, split=scorecard.hash_split: seen.append(df) or split(df, *a))
    pop = scorecard.ml_population(scorecard.population_from_tables(t, "2024-01-01", "2024-01-31"), api.ML_FEATURES)
    rows = scorecard.ml_classification_report(pop, api.ML_FEATURES, num_trees=3, median_cols=["overdueAmount"], mean_cols=["loanRequestAmount"]).collect()
    assert rows and "Join" in text(pop) and "Join" not in text(seen[0])
    assert sorted(map(str, seen[0].collect())) == sorted(map(str, pop.collect()))

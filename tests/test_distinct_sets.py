"""Stored sets count what the tables count, grow by days and places that never move, and are read alone."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dunlin.operators import staffing
from dunlin.plans import distinct_sets as DS
from dunlin.plans import report, sinks, ytd
from dunlin.sources.derived import from_testdata
from dunlin.sources.periods import KEY, Periods
from dunlin.sources.tables import scratch_path
from tests.fixtures import TS, call, loan, make_tables, snap

SF = "/root/testdata/sf0.001"
D = dt.date
WEEKS = Periods.of(*[(f"2024-01-{d:02d}", f"2024-01-{d + 6:02d}") for d in (1, 8, 15, 22)])


def rescan(t, periods):
    df = staffing.fte(t, periods).join(staffing.total_accounts(t, periods), KEY).join(staffing.active_works(t, periods), KEY)
    return {(r.WkstartDate, r.WkendDate): (r.FTE, r.total_accounts, r.active_works) for r in df.collect()}


def from_sets(s, periods):
    return {(r.WkstartDate, r.WkendDate): (r.FTE, r.total_accounts, r.active_works) for r in DS.staffing_counts(s, periods).collect()}


@pytest.fixture(scope="module")
def t(spark):
    return from_testdata(spark, SF)


@pytest.fixture(scope="module")
def sets(spark, t):
    return DS.build(t, WEEKS, scratch_path(spark, "sets"))


@pytest.mark.parametrize("periods", [WEEKS, Periods.of(("2024-01-03", "2024-01-20"), ("2024-01-20", "2024-01-19")), Periods.of(("2024-01-09", "2024-01-09"))])
def test_counts_equal_the_rescan(t, sets, periods):
    assert from_sets(sets, periods) == rescan(t, periods)


def test_only_the_sets_are_read(sets):
    plan = DS.staffing_counts(sets, WEEKS)._jdf.queryExecution().optimizedPlan().toString()
    assert "call_at" not in plan and "max_dpd" not in plan and "disbursed" not in plan
    executed = DS.staffing_counts(sets, WEEKS)._jdf.queryExecution().executedPlan().toString()
    assert executed.count("PartitionFilters: [isnotnull(kind") == 3


def test_yearly_roll_up_equals_the_rescan(spark, t, sets, scratch):
    rows = report.kpi_report(t, WEEKS)
    sinks.upsert_periods(rows, f"{scratch}/kpi")
    rows = ytd.v4_compat(sinks.read_table(spark, f"{scratch}/kpi"))
    assert DS.yearly_from_sets(rows, sets).collect() == ytd.yearly_from_monthly(rows, t).collect()
    some = rows.filter("WkstartDate in (date'2024-01-08', date'2024-01-22')")
    assert DS.yearly_from_sets(some, sets).collect() == ytd.yearly_from_monthly(some, t).collect()


def test_days_are_added_and_replaced(spark, t, scratch):
    first, later = Periods.of(("2024-01-01", "2024-01-10")), Periods.of(("2024-01-08", "2024-01-28"))
    DS.build(t, first, scratch)
    before = {(r["dict"], r.value): (r.lane, r.lanes, r.pos) for r in spark.read.parquet(f"{scratch}/ids").collect()}
    s = DS.build(t, later, scratch)
    s = DS.build(t, later, scratch)  # a second run changes nothing
    after = {(r["dict"], r.value): (r.lane, r.lanes, r.pos) for r in spark.read.parquet(f"{scratch}/ids").collect()}
    assert all(after[k] == v for k, v in before.items())
    assert len(set((k[0], *v) for k, v in after.items())) == len(after)
    assert from_sets(s, WEEKS) == rescan(t, WEEKS)


def test_small_blocks_and_later_values(spark, scratch):
    mk = lambda xs: spark.createDataFrame([("loan", x) for x in xs], "dict string, value string")
    DS.extend_dictionary(mk([f"a{k}" for k in range(50)] * 2), f"{scratch}/ids", block=8)
    ids = DS.extend_dictionary(mk([f"a{k}" for k in range(20, 90)]), f"{scratch}/ids", block=8).collect()
    assert len(ids) == 90 and {r.lanes for r in ids} == {7}
    by_lane = {}
    for r in ids:
        by_lane.setdefault(r.lane, []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in by_lane.values())


def test_accounts_of_a_day_fill_few_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(DS, "FILL", 64)
    loans = [loan(f"{k}", 1, "6", disb=TS(2023, 1 + k // 250, 1 + k % 250 // 10)) for k in range(1000)]  # ten a day on a hundred days
    t = make_tables(spark, loans=loans, snapshot=[snap(f"{k}", D(2024, 1, 1 + k % 7), 5) for k in range(1100)])
    s = DS.build(t, WEEKS, scratch)
    n = s.sets.filter("kind = 'total_accounts'").count()
    assert 100 <= n <= 100 + 18  # a day has one block, or two where a block ends
    assert from_sets(s, WEEKS) == rescan(t, WEEKS)


def test_traps(spark, scratch):
    t = make_tables(
        spark,
        loans=[loan("1", 1, "630000000001", disb=TS(2023, 5, 1)), loan("1", 1, "630000000001", disb=TS(2024, 1, 5)), loan("2", 1, "6", status=None),
               loan("3", 1, "6", status="Completed"), loan(None, 1, "6"), loan("4", 1, "6", flag=0), loan("5", 1, "6", disb=None)],
        calls=[call("C1", TS(2024, 1, 7, 23, 59), "6", agent="A"), call("C2", TS(2024, 1, 8), "6", agent="A"), call("C3", TS(2024, 1, 9), "6", agent=None),
               call("C4", TS(2024, 1, 9), "6", campaign="NONE", agent="B")],
        snapshot=[snap("1", D(2024, 1, 8), 5), snap("1", D(2024, 1, 8), 5), snap("2", D(2024, 1, 8), 180), snap("3", D(2024, 1, 8), 5, status="Settled")])
    periods = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-02-01", "2024-02-02"))
    got = from_sets(DS.build(t, periods, scratch), periods)
    assert got == rescan(t, periods)
    assert got[D(2024, 1, 8), D(2024, 1, 14)] == (1, 1, 1)


def test_empty_tables(spark, scratch):
    t = make_tables(spark)
    s = DS.build(t, WEEKS, scratch)
    assert set(from_sets(s, WEEKS).values()) == {(0, 0, 0)}

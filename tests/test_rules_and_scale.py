"""Rule switches, size checks, caches, shared folders, layout and the traps that the driver's tables lack."""

from decimal import Decimal

import pytest

from dunlin.operators import checks, contact as C, migration as M, ptp as P, recovery as R
from dunlin.operators.common import arrears, campaigns
from dunlin.plans import report, scorecard, sinks, ytd
from dunlin.rules import DEFAULT, PRESETS
from dunlin.sources import periods as PD
from dunlin.sources.history import read_kpi_history, read_monthend_csv
from dunlin.sources.periods import Periods
from tests.fixtures import D, TS, call, contact, loan, make_tables, snap

WEEK = Periods.of(("2024-01-08", "2024-01-14"))


def tables(spark, **kw):
    base = dict(
        loans=[loan("L1", 1, "630000000001", disb=TS(2024, 1, 9)), loan("L2", 2, "630000000002"), loan("L3", 3, "630000000003")],
        contacts=[contact(1, "630000000001"), contact(2, "630000000002"), contact(3, "630000000003")],
        snapshot=[snap("L1", D(2024, 1, 8), 10), snap("L1", D(2024, 1, 13), 3), snap("L1", D(2024, 1, 14), 20),
                  snap("L2", D(2024, 1, 9), 12), snap("L2", D(2024, 1, 14), 0, status="Normal"), snap("L3", D(2024, 1, 8), 40), snap("L3", D(2024, 1, 14), 55)],
        calls=[call("C1", TS(2024, 1, 2, 9), "630000000001"), call("C2", TS(2024, 1, 9, 9), "630000000002")],
        ptp=[("L1", 1, TS(2024, 1, 10), D(2024, 1, 13), 1, Decimal("5.00")), ("L3", 3, TS(2024, 1, 10), D(2024, 1, 13), 1, Decimal("7.00"))])
    return make_tables(spark, **(base | kw))


def test_versions_differ_where_their_rules_do(spark):
    t = tables(spark)
    v1, v2, v3 = (f(t, WEEK).collect()[0] for f in (report.kpi_report_v1, report.kpi_report_v2, report.kpi_report_v3))
    v5 = M.bucket_normalization(t, WEEK, 1).collect()[0]
    # start-day members: L1 (20 <= 30 at the end); any-day members: L1 and L2; v5 compares with the start DPD
    assert (v2.bucket1normalized_cnt, v2.bucket1normalized_denominator) == (1, 1)
    assert (v3.bucket1normalized_cnt, v3.bucket1normalized_denominator) == (2, 2)
    assert (v5.normalized_cnt, v5.Normalized_denominator) == (0, 1)
    # bucket 2 with a kept promise: v1 takes an end DPD up to 60, v2 only 0
    assert (v1.bucket2normalized, v2.bucket2normalized) == (1, 0)
    # v1 counts money of normalised loans, v2 of all
    assert v1.totalmoneycollectedptp == 7.0 and v2.totalmoneycollectedptp == 12.0
    # v2's welcome calls have no date filter but a loan of the period; v3's the other way round
    assert C.welcome_call_contact_rate(t, WEEK, PRESETS["v2"]).collect()[0].wccalled == 1
    assert C.welcome_call_contact_rate(t, WEEK).collect()[0].wccalled == 1
    assert report.yearly_direct(t, WEEK).collect()[0].bucket1normalized_cnt == 1


def test_rules_that_cannot_be_applied_raise(spark):
    t = tables(spark)
    for name in ("v1", "v2", "v3", "v4", "yearly"):
        with pytest.raises(ValueError):
            report.kpi_report(t, WEEK, PRESETS[name])
        with pytest.raises(ValueError):
            M.bucket_normalization(t, WEEK, 1, PRESETS[name])
    with pytest.raises(ValueError):
        C.welcome_call_contact_rate(t, WEEK, DEFAULT.with_(welcome_date_filter=False))


def test_last_leg_before_or_after_the_bucket_filter(spark):
    t = tables(spark, calls=[call("C1", TS(2024, 1, 9, 9), "630000000001", "CLICK"), call("C1", TS(2024, 1, 9, 10), "630000000009", "CLICK")])
    assert C.bucket_contact_rate(t, WEEK, 1).collect()[0].bucketcallcontacted == 1
    assert C.bucket_contact_rate(t, WEEK, 1, DEFAULT.with_(rank_before_bucket=True)).collect()[0].bucketcallcontacted == 0


def test_null_negative_and_later_due_rows_stay_out_of_buckets(spark):
    t = tables(spark, snapshot=[snap("L1", D(2024, 1, 8), None), snap("L2", D(2024, 1, 8), -5), snap("L3", D(2024, 1, 8), 20, first_due=D(2024, 1, 20)),
                                snap("L1", D(2024, 1, 9), 5), snap("L1", D(2024, 1, 9), 5)])
    assert [(r.loan_account, r.in_1, r.n_1) for r in arrears(t, WEEK).filter("in_1").collect()] == [("L1", True, 2)]
    assert P.normalized_via_ptp(t, WEEK).collect()[0].b1_normalized_cnt_denominator == 1
    wide = {r.bucket: r.cntloanoverdue for r in R.recovery_by_bucket(t, WEEK).collect()}
    assert wide == {0: 2, 1: 1}  # NULL and negative DPD are not delinquent


def test_missing_end_day_counts_as_normal(spark):
    t = tables(spark, snapshot=[snap("L1", D(2024, 1, 8), 10), snap("L3", D(2024, 1, 8), 40)])
    f = P.normalized_via_ptp(t, WEEK).collect()[0]
    assert (f.b1_normalized, f.b2_normalized) == (1, 1)
    got = M.bucket_transitions(t.with_(calls=tables(spark, calls=[call("C1", TS(2024, 1, 9), "630000000001")]).calls), WEEK).collect()
    assert [(r.loan_account, r.weekstartnumbucket, r.weekendnumbucket, r.Normalized) for r in got] == [("L1", 1, None, "L1")]


def test_promise_without_a_loan_keeps_its_row(spark):
    t = tables(spark, ptp=[(None, 1, TS(2024, 1, 10), D(2024, 1, 13), 1, Decimal("5.00")), ("L2", 2, TS(2024, 1, 9), D(2024, 1, 13), 1, Decimal("1.00"))])
    assert sorted((r.loan_account or "", r.dpd) for r in P.ptp_with_dpd(t, WEEK).collect()) == [("", None), ("L2", 12)]


def test_large_dimension_is_never_hinted(spark):
    import gc
    for n in (3, 120_000, 3, 120_000):  # values come and go: answers must not outlive their table
        dim = spark.range(n).selectExpr("concat('C', id) AS campaign", "'WC' AS reference", "cast(null AS string) AS subcategory")
        t = tables(spark).with_(campaign_master=dim)
        plan = campaigns(t, ["WC"])._jdf.queryExecution().logical().toString()
        assert ("broadcast" in plan) == (n == 3)
        assert t.sizes and not tables(spark).sizes
        del t, dim
        gc.collect()


def test_reuse_is_released(spark):
    spark.catalog.clearCache()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with tables(spark).reusing() as t:
        P.ptp_received_kept(t, WEEK).collect()
        assert spark.sparkContext._jsc.getPersistentRDDs().size() > before
    report.kpi_report_v1(tables(spark), WEEK).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_a_cluster_must_name_its_folder():
    from dunlin import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
    with pytest.raises(RuntimeError):
        session.checkpoint_root(Session())


def test_layout_has_few_files_a_day(spark, scratch):
    import glob
    t = tables(spark)
    t = t.with_(bucket_flow=t.bucket_flow.repartition(40)).materialize(scratch)
    assert t.bucket_flow.count() == 7
    days = glob.glob(f"{scratch}/bucket_flow/bucket_date=*")
    assert len(days) == 4 and all(len(glob.glob(f"{d}/*.parquet")) <= 8 for d in days)
    assert glob.glob(f"{scratch}/calls/day=*") and t.calls.columns == tables(spark).calls.columns


def test_rollups_over_a_stored_table(spark, scratch):
    t = tables(spark)
    two = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"))
    rows = report.kpi_report(t, two)
    sinks.upsert_periods(rows, f"{scratch}/kpi")
    sinks.upsert_periods(report.kpi_report(t, WEEK), f"{scratch}/kpi")
    back = sinks.read_table(spark, f"{scratch}/kpi")
    assert back.count() == 2 and [r.WkstartDate for r in read_kpi_history(spark, f"{scratch}/kpi").collect()] == [D(2024, 1, 8), D(2024, 1, 1)]
    out = ytd.yearly_from_monthly(ytd.v4_compat(back), t)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.collect()[0].FTE == 1 and plan.count("2024-01-01 00:00:00") >= 1
    assert ytd.ytd_from_monthend(ytd.monthend_rows(back)).collect()[0].FTE == 1
    assert {r.StartDate for r in ytd.monthend_table(ytd.monthend_rows(back)).collect()} == {"01-01-2024", "08-01-2024", "Total"}
    sinks.append(rows, f"{scratch}/kpi")
    assert sinks.read_table(spark, f"{scratch}/kpi").count() == 4
    sinks.backup(spark, f"{scratch}/kpi", f"{scratch}/copy")
    assert sinks.read_table(spark, f"{scratch}/copy").count() == 4
    sinks.write_csv(rows, f"{scratch}/csv")
    assert spark.read.option("header", "true").csv(f"{scratch}/csv").count() == 2


def test_catalog_tables(spark):
    import uuid
    name = f"kpi_{uuid.uuid4().hex[:8]}"
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    try:
        sinks.create_table(df, name)
        sinks.insert_into(df.select("s", "n"), name)
        assert [tuple(r) for r in spark.table(name).collect()] == [(1, "a"), (1, "a")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_history_with_gaps_and_published_headers(spark, scratch):
    path = f"{scratch}/h.csv"
    with open(path, "w") as f:
        f.write("WkstartDate,WkendDate,wccalled,bucket1normalized_greg,bucket1ptppmt\n01-01-2024,31-01-2024,4667.0,12.0,5.5\n01-02-2024,29-02-2024,,3,\n")
    r = read_monthend_csv(spark, path).orderBy("period_start").collect()
    assert [(x.wccalled, x.bucket1normalized_cnt, x.bucket1ptppmt) for x in r] == [(4667, 12, 5.5), (None, 3, None)]


def test_current_week():
    assert PD.current_week("2023-02-17").spans[0][:2] == (D(2023, 2, 13), D(2023, 2, 19))
    assert PD.current_week("2023-02-19").spans[0][:2] == (D(2023, 2, 13), D(2023, 2, 26))


def test_duplicates_and_top_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    assert [tuple(r) for r in checks.duplicates(df, "k").collect()] == [(1, 2)]
    assert [r.v for r in checks.top_rows(df, 2, df["v"].desc()).collect()] == ["e", "d"]


def test_scorecard_properties(spark):
    rows = [(float(k % 17), None if k % 5 == 0 else float(k), 2020 + k % 3, "xyz"[k % 3], None if k % 7 == 0 else "no", int(k % 17 > 8)) for k in range(300)]
    df = spark.createDataFrame(rows, "loanRequestAmount double, overdueAmount double, disbursementYear int, purposeDescription string, statusDescription string, defFPD30 int")
    feats = df.columns[:-1]
    imp = scorecard.ml_rf_importance(df, feats, median_cols=["overdueAmount"], mean_cols=["loanRequestAmount"]).collect()
    values = [r.importance for r in imp]
    assert abs(sum(values) - 1) < 1e-9 and values == sorted(values, reverse=True)
    train, test = scorecard.hash_split(df, 0.7)
    assert train.count() + test.count() == 300 and train.intersect(test).count() == 0 and 60 < test.count() < 130
    rep = scorecard.ml_classification_report(df, feats, num_trees=5, median_cols=["overdueAmount"], mean_cols=["loanRequestAmount"]).collect()
    assert sum(r.support for r in rep) == test.count() and all(0 <= r.recall <= 1 for r in rep)
    kept = scorecard.ml_select_features(spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0)], "feature string, importance double")).collect()
    assert [r.feature for r in kept] == ["a"]
    hist = scorecard.ml_importance_hist(spark.createDataFrame([("a", 0.7), ("b", 0.3), ("c", 0.0)], "feature string, importance double"), 7).collect()
    assert sum(r.n for r in hist) == 3


def test_bins_of_null_and_negative_dpd(spark):
    from dunlin.functions.keys import dpd_bucket, legacy_bucket, legacy_bucket_label
    df = spark.createDataFrame([(None,), (-5,), (0,), (1,), (90,), (91,), (400,)], "max_dpd int")
    got = [tuple(r) for r in df.select(dpd_bucket("max_dpd"), legacy_bucket("max_dpd"), legacy_bucket_label("max_dpd")).collect()]
    assert [g[0] for g in got] == [0, 0, 0, 1, 3, 4, 8]
    assert got[0][1] == 0 and got[1][1:] == (90, "Over 90 DPD") and got[3][1] == 1


def test_fused_report_equals_its_parts(spark):
    t = tables(spark, calls=[call("C1", TS(2024, 1, 9, 9), "630000000001", "CLICK"), call("C1", TS(2024, 1, 9, 10), "630000000002", "CLICK", apc=0),
                             call("C2", TS(2024, 1, 10), "630000000003", "CLICK"), call("C3", TS(2024, 1, 10), "630000000001", "SIGNUP"),
                             call("C4", TS(2024, 1, 11), None, "VIEW"), call("C5", TS(2024, 1, 11), "630000000003", "VIEW"),
                             call("C6", TS(2024, 1, 12), "630000000003", "ERROR")])
    two = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"))
    whole = {r.WkstartDate: r.asDict() for r in report.kpi_report(t, two).collect()}
    parts = [C.welcome_call_contact_rate(t, two), C.reminder_call_contact_rate(t, two), *(C.bucket_contact_rate(t, two, b) for b in (1, 2, 3)),
             *(M.bucket_normalization(t, two, b) for b in (1, 2, 3)), R.recovery_wide(t, two), R.recovery_total(t, two).select("WkstartDate", "recoveryrate", "paymentsfromoverdue")]
    seen = 0
    for p in parts:
        for r in p.collect():
            for k, v in r.asDict().items():
                if k in whole[r.WkstartDate]:
                    assert whole[r.WkstartDate][k] == v, k
                    seen += 1
    assert seen > 60


def test_report_scans_the_calls_twice_at_most(spark, scratch):
    t = tables(spark).materialize(scratch)
    plan = report.kpi_report(t, WEEK)._jdf.queryExecution().optimizedPlan().toString()
    # contact rates and agents; every family reads its slices once
    assert plan.count("is_rpc#") >= 1 and sum("Relation" in x and "call_id" in x for x in plan.splitlines()) <= 2
    assert sum("Relation" in x and "max_dpd" in x for x in plan.splitlines()) <= 9

"""Registry of the library's queries over the driver's test tables.

Each entry takes ``(spark, sf_dir)``, derives the seven input tables from the
parquet files in ``sf_dir`` and returns the KPI DataFrame for the fixture's
test periods.  Library users call the operators directly with their own
:class:`~dunlin.sources.tables.Tables` and :class:`~dunlin.sources.periods.Periods`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import checks, common, contact, migration, ptp, recovery, staffing
from .functions.keys import dpd_bucket, dpd_bucket_label, legacy_bucket, legacy_bucket_label, phone10
from .plans import declared, distinct_sets, published, report, scorecard, sinks, trends, ytd
from .sources import history, period_rules, stored
from .sources.derived import from_testdata
from .sources.tables import scratch_path
from .sources.periods import Periods

MAIN = Periods.of(("2024-01-08", "2024-01-14"))
WEEKS = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"),
                   ("2024-01-15", "2024-01-21"), ("2024-01-22", "2024-01-28"))
MONTH = Periods.of(("2024-01-01", "2024-01-28"))
MONTHS = Periods.of(("2023-12-18", "2023-12-24"), ("2023-12-25", "2023-12-31"), ("2024-01-01", "2024-01-07"), ("2024-01-22", "2024-01-28"))
YEAR = Periods.of(("2024-01-01", "2024-01-31"))  # the year to date: the snapshot ends on 2024-01-31

def _q(fn, periods):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(from_testdata(spark, sf_dir), periods)
    return run


def registered_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "welcome_call_contact_rate": _q(contact.welcome_call_contact_rate, MAIN),
        "reminder_call_contact_rate": _q(contact.reminder_call_contact_rate, MAIN),
        "welcome_call_contact_rate_weeks": _q(contact.welcome_call_contact_rate, WEEKS),
        "welcome_call_detail": _q(contact.welcome_call_detail, MAIN),
        "bucket_contact_rate_1": _q(lambda t, p: contact.bucket_contact_rate(t, p, 1), MAIN),
        "bucket_contact_rate_2": _q(lambda t, p: contact.bucket_contact_rate(t, p, 2), MAIN),
        "bucket_contact_rate_3": _q(lambda t, p: contact.bucket_contact_rate(t, p, 3), MAIN),
        "bucket_contact_rate_1_weeks": _q(lambda t, p: contact.bucket_contact_rate(t, p, 1), WEEKS),
        "bucket_normalization_1": _q(lambda t, p: migration.bucket_normalization(t, p, 1), MAIN),
        "bucket_normalization_2": _q(lambda t, p: migration.bucket_normalization(t, p, 2), MAIN),
        "bucket_normalization_3": _q(lambda t, p: migration.bucket_normalization(t, p, 3), MAIN),
        "bucket_normalization_1_weeks": _q(lambda t, p: migration.bucket_normalization(t, p, 1), WEEKS),
        "rollback": _q(migration.rollback, MAIN),
        "rollback_weeks": _q(migration.rollback, WEEKS),
        "recovery_by_bucket": _q(recovery.recovery_by_bucket, MAIN),
        "recovery_by_bucket_month": _q(recovery.recovery_by_bucket, MONTH),
        "recovery_wide": _q(recovery.recovery_wide, MAIN),
        "recovery_total": _q(recovery.recovery_total, MAIN),
        "ptp_received_kept": _q(ptp.ptp_received_kept, MAIN),
        "ptp_received_kept_weeks": _q(ptp.ptp_received_kept, WEEKS),
        "ptp_payments_by_bucket": _q(ptp.ptp_payments_by_bucket, MAIN),
        "normalized_via_ptp": _q(lambda t, p: ptp.normalized_via_ptp(t, p), MAIN),
        "fte": _q(staffing.fte, MAIN),
        "total_accounts": _q(staffing.total_accounts, MAIN),
        "total_accounts_weeks": _q(staffing.total_accounts, WEEKS),
        "active_works": _q(staffing.active_works, MAIN),
        "weekly_kpi_report": _q(report.weekly_kpi_report, MAIN),
        "weekly_kpi_report_weeks": _q(report.weekly_kpi_report, WEEKS),
        "monthly_kpi_report": _q(report.monthly_kpi_report, MONTH),
    }
    q.update({
        "kpi_report_v5": _q(report.kpi_report_v5, MAIN),
        "kpi_report_v4": _q(report.kpi_report_v4, MAIN),
        "kpi_report_v1": _q(report.kpi_report_v1, WEEKS),
        "kpi_report_v2": _q(report.kpi_report_v2, WEEKS),
        "kpi_report_v3": _q(report.kpi_report_v3, WEEKS),
        "yearly_direct": _q(report.yearly_direct, YEAR),
        "kpi_v4_compat": _q(report.kpi_v4_compat, MAIN),
        "monthend_csv_rows": _q(lambda t, p: _monthend_files(t, p)[0], WEEKS),
        "monthend_csv_rejects": _q(lambda t, p: _monthend_files(t, p)[1].select("line", "reason"), WEEKS),
        "kpi_generations": _q(_generations, WEEKS),
        "kpi_generation_difference": _q(_generation_difference, WEEKS),
        "kpi_column_use": _q(lambda t, p: declared.column_use(_generations(t, p)), WEEKS),
        "kpi_published": _q(_published, WEEKS),
        "kpi_restored": _q(lambda t, p: _published(t, p, restore=True), WEEKS),
        "monthend_margins": _q(lambda t, p: ytd.margins_by_month(ytd.monthend_rows(_stored(report.kpi_report(t, p)))), MONTHS),
        "period_rules": lambda spark, sf_dir: period_rules.period_relation(from_testdata(spark, sf_dir).calls, "call_at"),
        "fte_self_dated": _fte_self_dated,
        "staffing_from_sets_weeks": _q(lambda t, p: distinct_sets.staffing_counts(_sets(t, p), p), WEEKS),
        "yearly_from_sets": _q(lambda t, p: distinct_sets.yearly_from_sets(ytd.v4_compat(_stored(report.kpi_report(t, p))), _sets(t, p)), WEEKS),
        "bucket_normalization_1_stored": _stored_loans(lambda t: migration.bucket_normalization(t, MAIN, 1), "bucket_flow"),
        "recovery_wide_stored": _stored_loans(lambda t: recovery.recovery_wide(t, MAIN), "bucket_flow", "installments"),
        "bucket_transitions_stored": _stored_loans(lambda t: migration.bucket_transitions(t, MAIN, 1), "bucket_flow"),
        "bucket_transitions": _q(lambda t, p: migration.bucket_transitions(t, p, 1), MAIN),
        "bucket_transitions_2": _q(lambda t, p: migration.bucket_transitions(t, p, 2), MAIN),
        "bucket_transitions_multi": _q(lambda t, p: migration.bucket_transitions(t, p, 1), WEEKS),
        "active_loans_of_called": _q(migration.called_customers_loans, MAIN),
        "ptp_with_dpd": _q(ptp.ptp_with_dpd, MAIN),
        "kpi_trends": _q(lambda t, p: trends.kpi_trends(_stored(report.kpi_report(t, p))), WEEKS),
        "ytd_from_monthend": _q(_ytd_weeks, WEEKS),
        "yearly_from_monthly": _q(lambda t, p: ytd.yearly_from_monthly(ytd.v4_compat(_stored(report.kpi_report(t, p))), t), WEEKS),
        "yearly_from_monthly_v2": _q(lambda t, p: ytd.yearly_from_monthly_v2(ytd.v4_compat(_stored(report.kpi_report(t, p))), t), WEEKS),
        "monthend_table": _q(lambda t, p: ytd.monthend_table(ytd.monthend_rows(_stored(report.kpi_report(t, p)))), WEEKS),
        "shared_loan_phones": lambda spark, sf_dir: checks.shared_loan_phones(from_testdata(spark, sf_dir)),
        "loans_called_on_several_numbers": _q(checks.loans_called_on_several_numbers, MAIN),
        "largest_overdue": lambda spark, sf_dir: checks.largest_overdue(from_testdata(spark, sf_dir), MAIN.lo),
        "ml_population": _ml(lambda df: df),
        "ml_onehot": _ml(lambda df: scorecard.ml_onehot(df, ML_FEATURES)),
        "ml_impute": _ml(lambda df: scorecard.ml_impute(df, ["overdueAmount"], ["loanRequestAmount"])),
        "dpd_bins": _dpd_bins,
        "ml_profile": _ml(lambda df: scorecard.ml_profile(df)),
        "ml_rf_importance": _ml(lambda df: scorecard.ml_rf_importance(df, ML_FEATURES, median_cols=["overdueAmount"],
                                                                      mean_cols=["loanRequestAmount"])),
        "ml_select_features": _ml(lambda df: scorecard.ml_select_features(
            scorecard.ml_rf_importance(df, ML_FEATURES, num_trees=100, median_cols=["overdueAmount"],
                                       mean_cols=["loanRequestAmount"]))),
        "ml_classification_report": _ml(lambda df: scorecard.ml_classification_report(
            df, ML_FEATURES, median_cols=["overdueAmount"], mean_cols=["loanRequestAmount"])),
        "ml_importance_hist": _ml(lambda df: scorecard.ml_importance_hist(
            scorecard.ml_rf_importance(df, ML_FEATURES, median_cols=["overdueAmount"], mean_cols=["loanRequestAmount"]))),
    })
    return q


ML_FEATURES = ["loanRequestAmount", "overdueAmount", "disbursementYear", "purposeDescription", "statusDescription"]


def _ml(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = from_testdata(spark, sf_dir)
        pop = scorecard.ml_population(scorecard.population_from_tables(t, "2024-01-01", "2024-01-31"), ML_FEATURES)
        return fn(pop)
    return run


def _stored(rows: DataFrame) -> DataFrame:
    """Report rows written to a KPI table (per-period upsert) and read back: what roll-ups work on."""
    path = scratch_path(rows.sparkSession, "kpi")
    sinks.upsert_periods(rows, path)
    return sinks.read_table(rows.sparkSession, path)


def _ytd_weeks(t, p):
    """Weeks 1-3 as the month-end history, week 4 as the newest period."""
    rows = ytd.monthend_rows(_stored(report.kpi_report(t, p)))
    last = p.spans[-1][0]
    hist = rows.filter(rows["period_start"] < last)
    new = rows.filter(rows["period_start"] >= last)
    return ytd.ytd_from_monthend(hist, new)


def _monthend_files(t, p):
    """The report's month-end rows written as CSV files of the three layouts, some lines of them broken, in one scan."""
    spark = t.calls.sparkSession
    rows = ytd.monthend_rows(_stored(report.kpi_report(t, p)))
    cols = history.MONTHEND_COLUMNS
    short = [c for c in cols if c not in ("apc_rc_connected", "rccalled")]
    root = scratch_path(spark, "csv")
    line = lambda names, *first: F.concat_ws(",", *first, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    layouts = [(",".join(cols), line(cols)), ("," + ",".join(cols), line(cols, F.lit("0"))), ("," + ",".join(short), line(short, F.lit("0")))]
    for k, (header, text) in enumerate(layouts):
        starts = [s for s, _, _ in p.spans][k::3]
        lines = rows.filter(F.col("period_start").isin(starts)).select(F.col("period_start").alias("o"), text.alias("value"))
        broken = lines.select("o", F.concat("value", F.lit(",1")).alias("value")) if k < 2 else lines.select("o", F.regexp_replace("value", r",[^,]*$", ",x").alias("value"))
        head = spark.range(1).select(F.lit(None).cast("date").alias("o"), F.lit(header).alias("value"))
        head.unionByName(lines).unionByName(broken).coalesce(1).sortWithinPartitions(F.asc_nulls_first("o")).select("value").write.text(f"{root}/{k}")
    return history.scan_monthend_csv(spark, f"{root}/*")


def _older_and_newer(t, p):
    """Rows of the first two periods in the v4 layout, of the others in the newest; a row depends on its period alone."""
    return report.kpi_report_v4(t, Periods(p.spans[:2])), report.kpi_report(t, Periods(p.spans[2:]))


def _generations(t, p):
    """v4 rows, then rows of the newest version, appended to one declared table and read back."""
    old, new = _older_and_newer(t, p)
    spark = t.calls.sparkSession
    table = declared.DeclaredTable.create(spark, scratch_path(spark, "declared"), old.schema)
    table.append(old)
    table.append(new, evolve=True)
    return table.read()


def _generation_difference(t, p):
    """What the newest version's rows have more and less than a stored v4 table's."""
    old, new = _older_and_newer(t, p)
    spark = t.calls.sparkSession
    table = declared.DeclaredTable.create(spark, scratch_path(spark, "declared"), old.schema)
    return table.difference(new)


def _published(t, p, restore: bool = False):
    """The report's rows published in two steps that share a period, with an attempt between them that the audit
    refuses; ``restore`` goes back to the first step."""
    spark = t.calls.sparkSession
    rows = _stored(report.kpi_report(t, p))
    table = published.PublishedTable(spark, scratch_path(spark, "published"), rows.schema, ["WkstartDate", "WkendDate"])
    third = p.spans[2][0]
    first = table.replace(rows.filter(F.col("WkstartDate") <= F.lit(third)))
    try:
        table.replace(rows.filter(F.col("WkstartDate") >= F.lit(third)).unionByName(rows.limit(1)).unionByName(rows.limit(1)))
        raise AssertionError("two rows of a period were published")
    except published.AuditFailed:
        pass
    table.replace(rows.filter(F.col("WkstartDate") >= F.lit(third)))
    if restore:
        table.restore(first)
    return table.read()


def _fte_self_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents in every rule's period of every day on which there were calls."""
    t = from_testdata(spark, sf_dir)
    cm = common.campaigns(t, ["REM", "COLL", "WC"])
    legs = t.calls.join(cm, F.upper(t.calls["campaign"]) == cm["campaign_u"]).select(F.to_date("call_at").alias("day"), "agent")
    return period_rules.distinct_in_periods(legs, "day", "agent", period_rules.period_relation(t.calls, "call_at"), "FTE")


def _sets(t, p):
    return distinct_sets.build(t, p, scratch_path(t.calls.sparkSession, "sets"))


def _stored_loans(fn, *names):
    """A query over the loan-keyed tables it needs, stored in buckets by loan first."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = scratch_path(spark, "loans")
        t = stored.write_buckets(from_testdata(spark, sf_dir), root, root.rsplit("/", 1)[1].replace("-", "_"), names=names)
        return fn(t)
    return run


def _dpd_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DPD bin primitives (9-way label/number, legacy label/number) and the
    phone key, counted over the whole snapshot."""
    t = from_testdata(spark, sf_dir)
    b = t.bucket_flow
    return (b.groupBy(dpd_bucket_label("max_dpd").alias("bucketbin"), dpd_bucket("max_dpd").alias("bucket"),
                      legacy_bucket_label("max_dpd").alias("legacybucket"), legacy_bucket("max_dpd").alias("numbucket"))
             .agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("loan_account").alias("n_loans")))

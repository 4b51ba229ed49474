"""Report assembly: all KPIs on one typed row per period (weekly / monthly).

The reference builds the row by ``pd.concat(axis=1)`` of one-row frames;
here every KPI frame is keyed by the period and left-joined onto the period
list.  Each KPI frame has at most one row per period (it is grouped by the
period key) and the period list is a driver-side list, so the joins
broadcast a side of proven size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import safe_div
from ..operators import contact, migration, ptp, recovery, staffing
from ..rules import DEFAULT, PRESETS, Rules
from ..sources.periods import AS_OF, KEY, Periods
from ..sources.tables import Tables

# Declared column order of the v6/v7 report row (reference
# schema; person-named *_Greg columns renamed *_cnt), followed by the
# per-bucket overdue and payment columns the reference frame also carries.
REPORT_COLUMNS = [
    "WkstartDate", "WkendDate",
    "apc_wc_connected", "wccalled", "WelcomeCall_ContactRate",
    "apc_rc_connected", "rccalled", "remindercallcontactrate",
    "bucket1contacted", "bucketcallcontacted", "bucket1contactrate",
    "normalized_cnt", "Normalized_denominator", "Bucket1_Normalized",
    "bucket2contacted", "bucket2callcontacted", "bucket2contactrate",
    "normalized_buck2_cnt", "Normalized_buck2_denominator", "bucket2Normalizationrate",
    "bucket3contacted", "bucket3callcontacted", "bucket3contactrate",
    "normalized_buck3_cnt", "Normalized_buck3_denominator", "bucket3Normalizationrate",
    "ptp_received", "kept_ptp", "kept_ptp_rate",
    "inArearstoTotal_Overdue_Amount", "paymentsfromoverdue",
    "Bucket1_recoveryrate", "Bucket2_recoveryrate", "Bucket3_recoveryrate", "Bucket4_recoveryrate",
    "Bucket5_recoveryrate", "Bucket6_recoveryrate", "Bucket7_recoveryrate", "Bucket8_recoveryrate",
    "recoveryrate",
    "wentdelinquent", "rollbacked", "defaulteddelinquentamount", "rollbacked_amount",
    "rollback_rate", "rollback_rate_v",
    "bucket1ptppmt", "bucket2ptppmt", "FTE", "total_accounts", "active_works",
] + [f"Bucket{n}_{c}" for n in range(1, 9)
     for c in ("inArearstoTotal_Overdue_Amount", "paymentsfromoverdue")]

LONG_COLS = {"apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled", "bucket1contacted",
             "bucketcallcontacted", "normalized_cnt", "Normalized_denominator", "bucket2contacted",
             "bucket2callcontacted", "normalized_buck2_cnt", "Normalized_buck2_denominator",
             "bucket3contacted", "bucket3callcontacted", "normalized_buck3_cnt",
             "Normalized_buck3_denominator", "ptp_received", "kept_ptp", "wentdelinquent", "rollbacked",
             "FTE", "total_accounts", "active_works"}

# The 37-column v5 row (no bucket 3, no per-bucket recovery), in
# its published order.
V5_COLUMNS = [
    "WkstartDate", "WkendDate", "apc_wc_connected", "wccalled", "WelcomeCall_ContactRate",
    "apc_rc_connected", "rccalled", "remindercallcontactrate", "bucket1contacted",
    "bucketcallcontacted", "bucket1contactrate", "normalized_cnt", "Normalized_denominator",
    "Bucket1_Normalized", "bucket2contacted", "bucket2callcontacted", "bucket2contactrate",
    "normalized_buck2_cnt", "Normalized_buck2_denominator", "bucket2Normalizationrate",
    "inArearstoTotal_Overdue_Amount", "paymentsfromoverdue", "recoveryrate", "wentdelinquent",
    "rollbacked", "defaulteddelinquentamount", "rollbacked_amount", "rollback_rate", "rollback_rate_v",
    "ptp_received", "kept_ptp", "kept_ptp_rate", "bucket1ptppmt", "bucket2ptppmt", "FTE",
    "total_accounts", "active_works",
]


def kpi_frames(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> list[DataFrame]:
    """The report's frames, each KPI family in one pass over its tables."""
    if (rules.disbursed_within_period, rules.welcome_date_filter, rules.rank_before_bucket, rules.bucket_membership) == (False, True, False, "any"):
        contacts = [contact.contact_rates(t, periods)]
    else:
        contacts = [contact.welcome_call_contact_rate(t, periods, rules), contact.reminder_call_contact_rate(t, periods, rules),
                    *(contact.bucket_contact_rate(t, periods, b, rules) for b in (1, 2, 3))]
    rb = migration.rollback(t, periods).select(
        *KEY, "wentdelinquent", "rollbacked", "defaulteddelinquentamount", "rollbacked_amount",
        "rollback_rate", "rollback_rate_v")
    return [
        *contacts,
        migration.bucket_normalizations(t, periods),
        recovery.recovery_report(t, periods),
        rb,
        ptp.ptp_received_kept(t, periods, rules),
        ptp.ptp_payments_by_bucket(t, periods, rules),
        staffing.fte(t, periods),
        staffing.total_accounts(t, periods),
        staffing.active_works(t, periods),
    ]


def kpi_report(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """One row per period with every KPI of the latest report version, typed
    (counts BIGINT, rates and amounts DOUBLE, dates DATE).

    Old versions have layouts and numerators of their own (:func:`kpi_report_v1`
    to :func:`kpi_report_v4`, :func:`yearly_direct`); their rules raise here.
    Several KPIs share intermediates: ``with t.reusing() as shared`` keeps them
    while the rows are written, and releases them."""
    rules.require(normalized_rule="le_start", promise_amounts="loan", bucket2_normalized_cap=0, end_snapshot_day_before=False)
    spark = t.calls.sparkSession
    out = periods.frame(spark).drop(AS_OF)
    for f in kpi_frames(t, periods, rules):
        out = out.join(F.broadcast(f), KEY, "left")
    return out.select([F.col(c).cast("long" if c in LONG_COLS else "double").alias(c)
                       if c not in KEY else F.col(c) for c in REPORT_COLUMNS])


def weekly_kpi_report(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    return kpi_report(t, periods, rules)


def monthly_kpi_report(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    return kpi_report(t, periods, rules)


def kpi_report_v5(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """The 37-column v5 row (no bucket 3, no per-bucket recovery rates)."""
    return kpi_report(t, periods, rules).select(*V5_COLUMNS)


def _side_by_side(periods: Periods, spark, frames: list[DataFrame]) -> DataFrame:
    """Frames of at most one row per period next to each other, a row for every period."""
    out = periods.frame(spark).drop(AS_OF)
    for f in frames:
        out = out.join(F.broadcast(f), KEY, "left")
    return out


def _counts(t: Tables, periods: Periods, rules: Rules) -> DataFrame:
    """What the phone-based versions (v1 to v4, yearly) are made of, one row per period."""
    return _side_by_side(periods, t.calls.sparkSession, [
        contact.welcome_call_contact_rate(t, periods, rules),
        contact.bucket_contact_rate(t, periods, 1, rules),
        ptp.normalized_via_ptp(t, periods, rules),
        ptp.ptp_payments_by_bucket(t, periods, rules),
        staffing.fte(t, periods), staffing.total_accounts(t, periods), staffing.active_works(t, periods),
    ]).withColumn("kept", F.col("b1_kept_ptp") + F.col("b2_kept_ptp")).withColumn(
        "received", F.col("b1_ptp_received") + F.col("b2_ptp_received")).withColumn(
        "money", F.col("bucket1ptppmt") + F.col("bucket2ptppmt"))


def kpi_report_v1(t: Tables, periods: Periods, rules: Rules | None = None) -> DataFrame:
    """The v1 row: two contact rates, phones normalised with and without a kept
    promise, kept promises, their money and staffing (13 columns)."""
    c = _counts(t, periods, rules or PRESETS["v1"])
    return c.select(
        *KEY, F.col("WelcomeCall_ContactRate").alias("welcomecallcontactrate"), F.col("bucket1contactrate").alias("Bucket1callcontactrate"),
        F.col("b1_normalized").alias("bucket1normalized"), F.col("b1_normalizedwithoutptp").alias("bucket1normalizedwithoutptp"),
        F.col("b2_normalized").alias("bucket2normalized"), F.col("b2_normalizedwithoutptp").alias("bucket2normalizedwithoutptp"),
        F.col("kept").alias("kept_ptp"), F.col("money").alias("totalmoneycollectedptp"), "FTE", "total_accounts", "active_works")


def kpi_report_v2(t: Tables, periods: Periods, rules: Rules | None = None) -> DataFrame:
    """The v2 row: v1's columns and the phones whose end DPD is within the bucket's cap (19 columns)."""
    c = _counts(t, periods, rules or PRESETS["v2"])
    return c.select(
        *KEY, F.col("WelcomeCall_ContactRate").alias("welcomecallcontactrate"), F.col("bucket1contactrate").alias("Bucket1callcontactrate"),
        F.col("b1_normalized").alias("bucket1normalized"), F.col("b1_normalized_cnt").alias("bucket1normalized_cnt"),
        F.col("b1_normalized_cnt_denominator").alias("bucket1normalized_denominator"),
        safe_div("b1_normalized_cnt", "b1_normalized_cnt_denominator").alias("bucket1normalized_cnt_percentage"),
        F.col("b1_normalizedwithoutptp").alias("bucket1normalizedwithoutptp"), F.col("b2_normalized").alias("bucket2normalized"),
        F.col("b2_normalized_cnt_denominator").alias("Normalized_cnt_denominator"), F.col("b2_normalized_cnt").alias("bucket2normalized_cnt"),
        safe_div("b2_normalized_cnt", "b2_normalized_cnt_denominator").alias("bucket2normalized_cnt_percentage"),
        F.col("b2_normalizedwithoutptp").alias("bucket2normalizedwithoutptp"),
        F.col("kept").alias("kept_ptp"), F.col("money").alias("totalmoneycollectedptp"), "FTE", "total_accounts", "active_works")


def yearly_direct(t: Tables, periods: Periods, rules: Rules | None = None) -> DataFrame:
    """The yearly report straight from the tables: v2's columns, calls of any day to the
    period's loans, end snapshot of the day before the period end."""
    return kpi_report_v2(t, periods, rules or PRESETS["yearly"])


def kpi_report_v4(t: Tables, periods: Periods, rules: Rules | None = None) -> DataFrame:
    """The single-pass 17-column v4 report: welcome and bucket-1 contact,
    bucket 1/2 normalisation on phones (end DPD within the bucket cap
    and a payment in the period), PTP received/kept/amounts and staffing."""
    from .ytd import V4_COLUMNS
    c = _counts(t, periods, rules or PRESETS["v4"])
    return c.withColumns({
        "bucket1normalized_cnt": F.col("b1_normalized_cnt"), "bucket1normalized_denominator": F.col("b1_normalized_cnt_denominator"),
        "bucket2normalized_cnt": F.col("b2_normalized_cnt"), "bucket2normalized_denominator": F.col("b2_normalized_cnt_denominator"),
        "ptp_received": F.col("received"), "kept_ptp": F.col("kept")}).select(*V4_COLUMNS)


def kpi_report_v3(t: Tables, periods: Periods, rules: Rules | None = None) -> DataFrame:
    """The v3 row: v4's columns; the numerators need no payment in the period."""
    return kpi_report_v4(t, periods, rules or PRESETS["v3"])


def kpi_v4_compat(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """Latest report projected to the v4 table layout (K5)."""
    from .ytd import v4_compat
    return v4_compat(kpi_report(t, periods, rules))

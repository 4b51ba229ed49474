"""Year-to-date roll-ups of periodic KPI rows.

* :func:`monthend_rows` — report rows projected to the month-end history
  layout (the v5 -> v4 compatibility projection, dates as ``dd-MM-yyyy``).
* :func:`ytd_from_monthend` — history rows (+ newest month) -> one total row:
  sums, six percentages, PTP money, last-period staffing and ratios.
* :func:`yearly_from_monthly` — ratio of sums over the rows, with FTE,
  accounts and active works recomputed from the input tables over the rows'
  date ranges.

Sums of monthly *distinct* counts are not distinct across the year; that is
the reference's definition and is kept.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dd_mm_yyyy, dpd0, safe_div
from ..operators.common import campaigns
from ..operators.staffing import CLOSED
from ..sources.history import MONTHEND_COLUMNS
from ..sources.periods import Periods
from ..sources.tables import Tables

# v5 report column -> v4 / month-end column.
V4_RENAMES = {
    "normalized_cnt": "bucket1normalized_cnt",
    "Normalized_denominator": "bucket1normalized_denominator",
    "Normalized_buck2_denominator": "bucket2normalized_denominator",
    "normalized_buck2_cnt": "bucket2normalized_cnt",
}
# The v4 row, the counts and amounts that roll up, the year-to-date row.
V4_COLUMNS = ["WkstartDate", "WkendDate", "apc_wc_connected", "wccalled", "bucket1contacted",
              "bucketcallcontacted", "bucket1normalized_cnt", "bucket1normalized_denominator",
              "bucket2normalized_denominator", "bucket2normalized_cnt", "ptp_received", "kept_ptp",
              "bucket1ptppmt", "bucket2ptppmt", "FTE", "total_accounts", "active_works"]

_SUMS = ["apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled", "bucket1contacted",
         "bucketcallcontacted", "bucket1normalized_cnt", "bucket1normalized_denominator",
         "bucket2normalized_cnt", "bucket2normalized_denominator", "kept_ptp", "ptp_received",
         "bucket1ptppmt", "bucket2ptppmt"]

_AMOUNTS = {"bucket1ptppmt", "bucket2ptppmt"}

YTD_COLUMNS = ["StartDate", "EndDate", "apc_wc_connected", "wccalled", "Welcomecallcallrate",
               "apc_rc_connected", "rccalled", "remindercallcontactrate", "bucket1contacted",
               "bucketcallcontacted", "bucket1callcontactrate", "bucket1normalized_cnt",
               "bucket1normalized_denominator", "bucket1normalized", "bucket2normalized_cnt",
               "bucket2normalized_denominator", "bucket2normalized", "kept_ptp", "ptp_received",
               "kept_ptp_percentage", "bucket1ptppmt", "bucket2ptppmt", "totalptpmoneycollected",
               "FTE", "Total_Accounts", "active_works", "Account_FTE", "accountsonactiveworksperfte"]


def v4_compat(report_rows: DataFrame) -> DataFrame:
    """v5+ report rows -> the 17-column v4 row (renames, DATE dates)."""
    df = report_rows
    for a, b in V4_RENAMES.items():
        df = df.withColumnRenamed(a, b)
    return df.select(*V4_COLUMNS)


def monthend_rows(report_rows: DataFrame) -> DataFrame:
    """Report rows in the month-end history layout (19 columns, text dates)
    plus parsed ``period_start`` / ``period_end``."""
    df = report_rows
    for a, b in V4_RENAMES.items():
        df = df.withColumnRenamed(a, b)
    return df.select(
        dd_mm_yyyy("WkstartDate").alias("WkstartDate"), dd_mm_yyyy("WkendDate").alias("WkendDate"),
        *[F.col(c) for c in MONTHEND_COLUMNS[2:]],
        F.col("WkstartDate").alias("period_start"), F.col("WkendDate").alias("period_end"))


def ytd_from_monthend(history: DataFrame, newest: DataFrame | None = None,
                      start_label: str | None = None, end_label: str | None = None) -> DataFrame:
    """Append the newest month to the history (by name; missing columns NULL),
    total every count and amount (the pivot's 'Total' margin), then derive the
    percentages (x100), total PTP money and the staffing of the latest period."""
    rows = history if newest is None else history.unionByName(newest, allowMissingColumns=True)
    last = lambda c: F.max_by(F.col(c), F.col("period_start"))
    def total(c):
        # amounts are summed as exact cents so the total does not depend on row order
        v = F.sum(F.col(c).cast("decimal(20,2)")).cast("double") if c in _AMOUNTS else F.sum(c)
        return F.coalesce(v, F.lit(0)).alias(c)
    agg = rows.agg(
        *[total(c) for c in _SUMS],
        last("FTE").alias("FTE"), last("total_accounts").alias("Total_Accounts"),
        last("active_works").alias("active_works"),
        F.min("period_start").alias("_s"), F.max("period_end").alias("_e"),
    )
    pct = lambda a, b: (safe_div(a, b) * F.lit(100.0))
    out = agg.select(
        (F.lit(start_label) if start_label else dd_mm_yyyy("_s")).alias("StartDate"),
        (F.lit(end_label) if end_label else dd_mm_yyyy("_e")).alias("EndDate"),
        "*",
    ).select(
        "StartDate", "EndDate", *_SUMS, "FTE", "Total_Accounts", "active_works",
        pct("apc_wc_connected", "wccalled").alias("Welcomecallcallrate"),
        pct("apc_rc_connected", "rccalled").alias("remindercallcontactrate"),
        pct("bucket1contacted", "bucketcallcontacted").alias("bucket1callcontactrate"),
        pct("bucket1normalized_cnt", "bucket1normalized_denominator").alias("bucket1normalized"),
        pct("bucket2normalized_cnt", "bucket2normalized_denominator").alias("bucket2normalized"),
        pct("kept_ptp", "ptp_received").alias("kept_ptp_percentage"),
        (F.col("bucket1ptppmt") + F.col("bucket2ptppmt")).alias("totalptpmoneycollected"),
        safe_div("Total_Accounts", "FTE").alias("Account_FTE"),
        safe_div("active_works", "FTE").alias("accountsonactiveworksperfte"),
    )
    return out.select(*YTD_COLUMNS)


def monthend_table(history: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """The pivot with margins: counts and amounts of every period (missing values 0),
    then the row ``Total``.  Periods come as dd-MM-yyyy text."""
    rows = history if newest is None else history.unionByName(newest, allowMissingColumns=True)
    sets = _with_margins(rows, {"StartDate": dd_mm_yyyy("period_start"), "EndDate": dd_mm_yyyy("period_end")}, [2, 0])
    total = F.col("_left_out") > 0
    return sets.select(F.when(total, "Total").otherwise(F.col("StartDate")).alias("StartDate"),
                       F.when(total, "").otherwise(F.col("EndDate")).alias("EndDate"), *_SUMS)


def margins_by_month(history: DataFrame, newest: DataFrame | None = None) -> DataFrame:
    """The pivot by year and month of the periods' starts, with a margin for each year and one for
    everything: ``year`` and ``month`` are text, ``Total`` where they are summed over; n_periods counts the rows."""
    rows = history if newest is None else history.unionByName(newest, allowMissingColumns=True)
    sets = _with_margins(rows, {"year": F.year("period_start").cast("string"), "month": F.month("period_start").cast("string")}, [2, 1, 0])
    # bit k of grouping_id is set where the k-th column from the right is summed over
    label = lambda c, bit: F.when(F.col("_left_out").bitwiseAND(bit) > 0, "Total").otherwise(F.col(c)).alias(c)
    return sets.select(label("year", 2), label("month", 1), "n_periods", *_SUMS)


def _with_margins(rows: DataFrame, by: dict, levels: list[int]) -> DataFrame:
    """Sums of :data:`_SUMS` (missing values 0) over the first ``n`` columns of ``by`` for each n of ``levels``, in one
    aggregation over grouping sets; ``_left_out`` is the grouping_id.  No rows, no margins."""
    def total(c):
        # amounts are summed as exact cents so the total does not depend on row order
        v = F.sum(F.col(c).cast("decimal(20,2)")).cast("double") if c in _AMOUNTS else F.sum(c)
        return F.coalesce(v, F.lit(0)).alias(c)
    rows = rows.select(*(v.alias(c) for c, v in by.items()), *_SUMS)
    cols = [F.col(c) for c in by]
    return rows.groupingSets([cols[:n] for n in levels], *cols).agg(
        F.grouping_id().alias("_left_out"), F.count(F.lit(1)).alias("n_periods"), *[total(c) for c in _SUMS])


def _bounds(rows: DataFrame):
    """First start and last end day of the rows: one row to the driver.  ``rows`` should be
    stored (read back from the KPI table), as they are read twice."""
    return rows.agg(F.min("WkstartDate").alias("s"), F.max("WkendDate").alias("e"), F.max("WkstartDate").alias("last")).first()


def _calls_between(t: Tables, lo, hi) -> DataFrame:
    cm = campaigns(t, ["REM", "COLL", "WC"])
    calls = t.during("calls", "call_at", Periods.of((lo, hi)))
    return calls.join(cm, F.upper(calls["campaign"]) == cm["campaign_u"]).withColumn("day", F.to_date("call_at"))


def _working(t: Tables) -> DataFrame:
    return t.bucket_flow.filter(dpd0("max_dpd").between(1, 179) & ~F.col("loan_status").isin(list(CLOSED)))


def _accounts_before(t: Tables, day) -> DataFrame:
    lm = t.loan_master.filter((F.col("flag_disbursement") == 1) & ~F.col("loan_paid_status").isin(list(CLOSED)))
    return lm.filter(F.to_date("disbursed_at") < F.lit(day)).agg(F.countDistinct("loan_account").alias("total_accounts"))


def _ratios() -> list:
    s = F.sum
    return [F.min("WkstartDate").alias("WkstartDate"), F.max("WkendDate").alias("WkendDate"),
            safe_div(s("apc_wc_connected"), s("wccalled")).alias("welcomecallcontactrate"),
            safe_div(s("bucket1contacted"), s("bucketcallcontacted")).alias("Bucket1callcontactrate"),
            safe_div(s("bucket1normalized_cnt"), s("bucket1normalized_denominator")).alias("bucket1normalized_cnt_percentage"),
            safe_div(s("bucket2normalized_cnt"), s("bucket2normalized_denominator")).alias("bucket2normalized_cnt_percentage"),
            (F.sum(F.col("bucket1ptppmt").cast("decimal(20,2)")).cast("double")
             + F.sum(F.col("bucket2ptppmt").cast("decimal(20,2)")).cast("double")).alias("totalmoneycollectedptp")]


_YEARLY_COLUMNS = ["WkstartDate", "WkendDate", "welcomecallcontactrate", "Bucket1callcontactrate",
                   "bucket1normalized_cnt_percentage", "bucket2normalized_cnt_percentage",
                   "FTE", "total_accounts", "active_works", "kept_ptp", "totalmoneycollectedptp"]


def _one_row(*frames: DataFrame) -> DataFrame:
    """Single-row aggregates side by side (1 x 1 joins)."""
    out = frames[0].withColumn("_k", F.lit(1))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(1)), "_k")
    for c in ("FTE", "total_accounts", "active_works"):
        out = out.withColumn(c, F.col(c).cast("long"))
    return out.select(*_YEARLY_COLUMNS)


def yearly_from_monthly(rows: DataFrame, t: Tables, window=None) -> DataFrame:
    """Yearly KPIs from stored monthly v4 rows (``WkstartDate``/``WkendDate`` DATE).

    Ratios of sums over the rows (optionally only rows starting within
    ``window=(lo, hi)``); FTE = distinct agents on REM/COLL/WC calls on any
    day covered by a row; total_accounts = distinct open disbursed loans
    disbursed before any row's start; active_works = distinct loans with DPD
    1-179 on any row's start day.  The rows' first and last day bound the scans of
    calls and snapshot as literals; the covered days then refine them."""
    b = _bounds(rows)
    lo, hi, last = (b.s, b.e, b.last) if b.s is not None else (_dt.date(1970, 1, 1),) * 3
    yb = rows.select("WkstartDate", "WkendDate").distinct()
    days = (yb.filter(F.col("WkstartDate") <= F.col("WkendDate"))
              .select(F.explode(F.sequence("WkstartDate", "WkendDate")).alias("day")).distinct())
    fte = _calls_between(t, lo, hi).join(days, "day", "left_semi").agg(F.countDistinct("agent").alias("FTE"))
    starts = yb.select(F.col("WkstartDate").alias("bucket_date")).distinct()
    aw = (_working(t).filter(F.col("bucket_date").between(F.lit(lo), F.lit(last))).join(starts, "bucket_date", "left_semi")
          .agg(F.countDistinct("loan_account").alias("active_works")))
    sel = rows if window is None else rows.filter(F.col("WkstartDate").between(F.lit(window[0]), F.lit(window[1])))
    main = sel.agg(*_ratios(), safe_div(F.sum("kept_ptp"), F.sum("ptp_received")).alias("kept_ptp"))
    return _one_row(main, fte, _accounts_before(t, last), aw)


def yearly_from_monthly_v2(rows: DataFrame, t: Tables) -> DataFrame:
    """The older roll-up of stored monthly rows: kept promises as a sum; FTE on the days from the
    first start to the last end, accounts disbursed before the first start, active works of that day."""
    b = _bounds(rows)
    lo, hi = (b.s, b.e) if b.s is not None else (_dt.date(1970, 1, 1),) * 2
    fte = _calls_between(t, lo, hi).agg(F.countDistinct("agent").alias("FTE"))
    aw = _working(t).filter(F.col("bucket_date") == F.lit(lo)).agg(F.countDistinct("loan_account").alias("active_works"))
    main = rows.agg(*_ratios(), F.sum("kept_ptp").alias("kept_ptp"))
    return _one_row(main, fte, _accounts_before(t, lo), aw)

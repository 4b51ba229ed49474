"""Staffing and portfolio-size KPIs: agents (FTE), accounts, active works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dpd0
from ..sources.periods import KEY, PS, Periods
from ..sources.tables import Tables
from .common import calls_in_periods, on_periods, snapshot_in_periods

CLOSED = ("Written Off", "Completed", "Settled")


def fte(t: Tables, periods: Periods) -> DataFrame:
    """Distinct agents on calls in the period whose campaign reference is
    REM, COLL or WC (calls of unmapped campaigns drop out)."""
    spark = t.calls.sparkSession
    legs = calls_in_periods(t, periods, ["REM", "COLL", "WC"])
    agg = legs.groupBy(*KEY).agg(F.countDistinct("agent").alias("FTE"))
    return on_periods(periods, spark, F.broadcast(agg), zero_cols=("FTE",))


def total_accounts(t: Tables, periods: Periods) -> DataFrame:
    """Distinct disbursed loans (flag 1) disbursed before the period start and
    not closed (NULL status dropped: bare NOT IN).

    Each loan is reduced to its first qualifying disbursement day (one shuffle
    on the loan key), then to a count per day; periods then sum the days
    before their start.  No loan row is replicated per period."""
    spark = t.calls.sparkSession
    lm = t.loan_master.filter((F.col("flag_disbursement") == 1)
                              & ~F.col("loan_paid_status").isin(list(CLOSED)))
    first = (lm.groupBy("loan_account").agg(F.min(F.to_date("disbursed_at")).alias("d"))
               .filter(F.col("loan_account").isNotNull() & F.col("d").isNotNull()))
    per_day = first.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    fr = periods.frame(spark).drop("as_of")
    agg = (per_day.join(fr, per_day["d"] < fr[PS])
                  .groupBy(*KEY).agg(F.sum("n").cast("long").alias("total_accounts")))
    return on_periods(periods, spark, F.broadcast(agg), zero_cols=("total_accounts",))


def active_works(t: Tables, periods: Periods) -> DataFrame:
    """Distinct loans with DPD 1-179 on the start day, status not closed."""
    spark = t.calls.sparkSession
    snap = (snapshot_in_periods(t, periods, "start")
            .filter(dpd0("max_dpd").between(1, 179) & ~F.col("loan_status").isin(list(CLOSED))))
    agg = snap.groupBy(*KEY).agg(F.countDistinct("loan_account").alias("active_works"))
    return on_periods(periods, spark, F.broadcast(agg), zero_cols=("active_works",))

"""Recovery: payments received on overdue balances, by 9-way DPD bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dpd_bucket, dpd_bucket_label, safe_div
from ..sources.periods import KEY, Periods
from ..sources.tables import Tables
from .common import snapshot_in_periods

_AMOUNT_COLS = ["totaloutstandingamount", "inArearstotaloutstandingamount", "Normaltotaloutstandingamount",
                "inArearstoTotal_Overdue_Amount", "NormalTotal_Overdue_Amount", "Normalized",
                "paymentreceivedbutstilldelinquent", "payment"]


def overdue_base(t: Tables, periods: Periods, by_bucket: bool = True) -> DataFrame:
    """Start-day balances per (period, loan[, bucket]): status Normal / In
    Arrears, outstanding > 0; outstanding and overdue split by status."""
    snap = (snapshot_in_periods(t, periods, "start")
            .filter(F.col("loan_status").isin("Normal", "In Arrears")
                    & F.col("outstanding").isNotNull() & (F.col("outstanding") > 0))
            .select(*KEY, "bucket_date", "loan_account", "max_dpd", "loan_status", "outstanding", "overdue"))
    snap = t.by_loan("bucket_flow", snap, periods)
    keys = [*KEY, "bucket_date", "loan_account"]
    if by_bucket:
        snap = snap.withColumn("bucket", dpd_bucket("max_dpd")).withColumn("bucketbin", dpd_bucket_label("max_dpd"))
        keys += ["bucket", "bucketbin"]
    arrears = F.col("loan_status") == "In Arrears"
    normal = F.col("loan_status") == "Normal"
    z = F.lit(0)
    return snap.groupBy(*keys).agg(
        F.sum("outstanding").alias("totaloutstandingamount"),
        F.sum(F.when(arrears, F.col("outstanding")).otherwise(z)).alias("inArearstotaloutstandingamount"),
        F.sum(F.when(normal, F.col("outstanding")).otherwise(z)).alias("Normaltotaloutstandingamount"),
        F.sum(F.when(arrears, F.col("overdue")).otherwise(z)).alias("inArearstoTotal_Overdue_Amount"),
        F.sum(F.when(normal, F.col("overdue")).otherwise(z)).alias("NormalTotal_Overdue_Amount"),
    )


def payment_base(t: Tables, periods: Periods) -> DataFrame:
    return t.shared(("payment_base", periods), lambda: _payment_base(t, periods))


def _payment_base(t: Tables, periods: Periods) -> DataFrame:
    """Per (period, loan): payments on ever-delinquent instalments whose last
    payment date falls in the period, split into normalised (no longer
    delinquent) and still delinquent.  The ``_cnt`` columns count
    (loan, payment date, flags) groups, as the reference does."""
    spark = t.calls.sparkSession
    pay = (t.during("installments", "last_payment_date", periods)
           .filter((F.col("is_delinq") == 1) & (F.coalesce("paid", F.lit(0)) > 0))
           .select("loan_account", "last_payment_date", "is_delinq", "is_cur_delinq", "paid"))
    pay = t.by_loan("installments", pay, periods).join(periods.calendar(spark).withColumnRenamed("day", "last_payment_date"), "last_payment_date")
    grp = pay.groupBy(*KEY, "loan_account", "last_payment_date", "is_delinq", "is_cur_delinq").agg(
        F.sum("paid").alias("payment"))
    norm = (F.col("is_delinq") == 1) & (F.col("is_cur_delinq") == 0)
    still = (F.col("is_delinq") == 1) & (F.col("is_cur_delinq") == 1)
    z = F.lit(0)
    return grp.groupBy(*KEY, "loan_account").agg(
        F.countDistinct("last_payment_date").alias("noofdayspaymentreceived"),
        F.sum(F.when(norm, 1).otherwise(0)).cast("long").alias("Normalized_cnt"),
        F.sum(F.when(still, 1).otherwise(0)).cast("long").alias("paymentreceivedbutstilldelinquent_cnt"),
        F.sum(F.when(norm, F.col("payment")).otherwise(z)).alias("Normalized"),
        F.sum(F.when(still, F.col("payment")).otherwise(z)).alias("paymentreceivedbutstilldelinquent"),
        F.sum("payment").alias("payment"),
    )


def _recovery(t: Tables, periods: Periods, by_bucket: bool) -> DataFrame:
    # Both sides hold one row per loan of a group, so counts are distinct counts.  They are dealt by loan, and
    # a loan's payments of all periods are one row, so they meet by loan where they are.
    ob = overdue_base(t, periods, by_bucket)
    pb = payment_base(t, periods)
    measures = [c for c in pb.columns if c not in (*KEY, "loan_account")]
    pb = pb.groupBy("loan_account").agg(F.collect_list(F.struct(*KEY, *measures)).alias("_paid"))
    j = ob.join(pb, "loan_account", "left")
    own = F.get(F.filter("_paid", lambda x: (x[KEY[0]] == F.col(KEY[0])) & (x[KEY[1]] == F.col(KEY[1]))), 0)
    j = j.withColumn("_own", own).select(*ob.columns, F.when(F.col("_own").isNotNull(), F.col("loan_account")).alias("pay_loan"),
                                         *(F.col("_own")[c].alias(c) for c in measures))
    keys = [*KEY, "bucket_date"] + (["bucket"] if by_bucket else [])
    agg = j.groupBy(*keys).agg(
        F.count("loan_account").alias("cntloanoverdue"),
        F.sum("totaloutstandingamount").alias("totaloutstandingamount"),
        F.sum("inArearstotaloutstandingamount").alias("inArearstotaloutstandingamount"),
        F.sum("Normaltotaloutstandingamount").alias("Normaltotaloutstandingamount"),
        F.sum("inArearstoTotal_Overdue_Amount").alias("inArearstoTotal_Overdue_Amount"),
        F.sum("NormalTotal_Overdue_Amount").alias("NormalTotal_Overdue_Amount"),
        F.count("pay_loan").alias("cnt_loanpaymentsreceived"),
        F.max("noofdayspaymentreceived").alias("noofdayspaymentreceived"),
        F.sum("Normalized_cnt").alias("Normalized_cnt"),
        F.sum("Normalized").alias("Normalized"),
        F.sum("paymentreceivedbutstilldelinquent_cnt").alias("paymentreceivedbutstilldelinquent_cnt"),
        F.sum("paymentreceivedbutstilldelinquent").alias("paymentreceivedbutstilldelinquent"),
        F.sum("payment").alias("payment"),
    )
    return agg


def _measures(agg: DataFrame) -> DataFrame:
    for c in _AMOUNT_COLS:
        agg = agg.withColumn(c, F.col(c).cast("double"))
    pfo = F.col("Normalized") + F.col("paymentreceivedbutstilldelinquent")
    return (agg.withColumnRenamed("bucket_date", "bucketDate")
               .withColumn("paymentsfromoverdue", pfo)
               .withColumn("recoveryrate", safe_div(pfo, "inArearstoTotal_Overdue_Amount"))
               .withColumn("paymentreceived", pfo))


def recovery_by_bucket(t: Tables, periods: Periods) -> DataFrame:
    """One row per (period, DPD bucket 0-8) present on the start day."""
    return _measures(_recovery(t, periods, True))


def recovery_total(t: Tables, periods: Periods) -> DataFrame:
    """Same measures without the bucket dimension (one row per period)."""
    return _measures(_recovery(t, periods, False)).drop("paymentreceived")


def recovery_wide(t: Tables, periods: Periods, buckets=range(1, 9)) -> DataFrame:
    """Buckets 1..8 spread into ``Bucket{n}_*`` columns, one row per period; a
    bucket absent from a period gives NULL columns.  Conditional aggregation
    over at most 9 rows per period (no pivot-value discovery pass)."""
    rb = recovery_by_bucket(t, periods)
    cols = []
    for n in buckets:
        for src, dst in (("inArearstoTotal_Overdue_Amount", f"Bucket{n}_inArearstoTotal_Overdue_Amount"),
                         ("paymentsfromoverdue", f"Bucket{n}_paymentsfromoverdue"),
                         ("recoveryrate", f"Bucket{n}_recoveryrate")):
            cols.append(F.max(F.when(F.col("bucket") == n, F.col(src))).alias(dst))
    return rb.groupBy(*KEY).agg(*cols)


def recovery_report(t: Tables, periods: Periods, buckets=range(1, 9)) -> DataFrame:
    """:func:`recovery_wide` and the three totals of the report in one pass: a loan has one
    bucket on the start day, so the total is the sum over buckets (in exact decimals)."""
    by = _recovery(t, periods, True)
    cols = ["inArearstoTotal_Overdue_Amount", "Normalized", "paymentreceivedbutstilldelinquent"]
    out = by.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in cols),
                               *(F.max(F.when(F.col("bucket") == n, F.col(c))).alias(f"_{n}_{c}") for n in buckets for c in cols))

    def rates(prefix, source):
        due, norm, still = (F.col(f"{source}{c}").cast("double") for c in cols)
        return {f"{prefix}inArearstoTotal_Overdue_Amount": due, f"{prefix}paymentsfromoverdue": norm + still,
                f"{prefix}recoveryrate": safe_div(norm + still, due)}
    values = rates("", "")
    for n in buckets:
        values |= rates(f"Bucket{n}_", f"_{n}_")
    return out.select(*KEY, *(v.alias(c) for c, v in values.items()))

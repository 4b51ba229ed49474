"""Delinquency migration: bucket normalisation, loan-level transitions, roll-back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dpd0, legacy_bucket, legacy_bucket_label, safe_div
from ..rules import DEFAULT, Rules
from ..sources.periods import KEY, PE, PS, Periods
from ..sources.tables import Tables
from .common import first_and_last_days, phone_join

# Bucket -> (DPD range, output names of numerator, denominator, rate).
NORMALIZATION = {
    1: ((1, 30), ("normalized_cnt", "Normalized_denominator", "Bucket1_Normalized")),
    2: ((31, 60), ("normalized_buck2_cnt", "Normalized_buck2_denominator", "bucket2Normalizationrate")),
    3: ((61, 90), ("normalized_buck3_cnt", "Normalized_buck3_denominator", "bucket3Normalizationrate")),
}


def _start_and_end(t: Tables, periods: Periods, buckets) -> DataFrame:
    """Per (period, loan): ``s_b``, the start-day DPD within each bucket's range, and ``e``, the end-day DPD
    (NULL without an end-day row); loans of none of the buckets drop out.

    The two days are one scan and one aggregation by loan, combined before the shuffle; on a snapshot stored by
    loan nothing is shuffled.  Of several rows of a day the largest start and the smallest end
    decide, as a loan counts if any pair of its rows does."""
    d, first = dpd0("max_dpd"), F.col("first")
    ranges = {b: NORMALIZATION[b][0] for b in buckets}
    wanted = d.between(min(lo for lo, _ in ranges.values()), max(hi for _, hi in ranges.values()))
    per = first_and_last_days(t, periods).filter(~first | wanted).groupBy(*KEY, "loan_account").agg(
        *(F.max(F.when(first & d.between(lo, hi), d)).alias(f"s_{b}") for b, (lo, hi) in ranges.items()), F.min(F.when(~first, d)).alias("e"))
    return per.filter(F.coalesce(*(F.col(f"s_{b}") for b in ranges)).isNotNull())


def bucket_normalizations(t: Tables, periods: Periods, buckets=(1, 2, 3)) -> DataFrame:
    """The buckets of :func:`bucket_normalization` side by side; NULL where a period has no loan of a bucket.
    Periods without a loan of any of them have no row."""
    per = _start_and_end(t, periods, buckets)
    counts, rates = [], {}
    for b in buckets:
        num, den, rate = NORMALIZATION[b][1]
        s = F.col(f"s_{b}")
        n = F.count(s)
        counts += [F.when(n > 0, F.count(F.when(F.coalesce("e", F.lit(0)) <= s, 1))).alias(num), F.when(n > 0, n).alias(den)]
        rates[rate] = safe_div(num, den)
    return per.groupBy(*KEY).agg(*counts).withColumns(rates).select(*KEY, *(c for b in buckets for c in NORMALIZATION[b][1]))


def bucket_normalization(t: Tables, periods: Periods, bucket: int, rules: Rules = DEFAULT) -> DataFrame:
    """Share of bucket-``n`` loans (on the start day) whose end-day DPD is no
    worse than their start DPD; a loan missing from the end snapshot counts as
    normalised (DPD 0).  Periods without any bucket loan yield no row (GROUP BY
    semantics of the reference).  Rules whose numerator is on phones raise:
    :func:`dunlin.operators.ptp.normalized_via_ptp` has it."""
    rules.require(normalized_rule="le_start")
    return bucket_normalizations(t, periods, (bucket,))


def called_customers_loans(t: Tables, periods: Periods, active_statuses_like=("%Nor%", "%In%")) -> DataFrame:
    """Open loans of customers called in the period (``activeloans``).

    Called phone (any campaign, 10-digit key) -> every customer whose *any*
    active number has that key (no earliest-number filter, so a shared
    number fans out to all its customers) -> their loans whose status is LIKE
    '%Nor%' / '%In%' or NULL.  Columns: period key, MOBILENUMBER,
    customer_id, loan_account, disbursed_at, flag_disbursement, loan_type."""
    spark = t.calls.sparkSession
    cal = periods.calendar(spark)
    mobi = (t.during("calls", "call_at", periods)
            .withColumn("day", F.to_date("call_at")).join(cal, "day")
            .select(*KEY, F.right(F.col("mobile").cast("string"), F.lit(10)).alias("MOBILENUMBER"))
            .distinct())
    cd = (t.contact_details.filter(F.col("active") == "Y")
          .select("customer_id", F.right(F.col("mobile"), F.lit(10)).alias("MOBILENUMBER"))
          .filter(F.col("customer_id").isNotNull()))
    st = F.col("loan_paid_status")
    open_cond = F.lit(False)
    for pat in active_statuses_like:
        open_cond = open_cond | st.like(pat)
    open_cond = open_cond | F.coalesce(st, F.lit("NA")).like("NA")
    # the loan master holds one row per loan: a filter, not a semi join with itself
    loans = t.loan_master.filter(open_cond).select("loan_account", "customer_id", "disbursed_at", "flag_disbursement", "loan_type")
    return (phone_join(t, cd, mobi, "MOBILENUMBER").join(loans, "customer_id")
                .select(*KEY, "MOBILENUMBER", "customer_id", "loan_account", "disbursed_at",
                        "flag_disbursement", "loan_type"))


def bucket_transitions(t: Tables, periods: Periods, bucket: int = 1) -> DataFrame:
    """Loan-level start/end legacy bucket per period for the open loans of
    called customers (:func:`called_customers_loans`): start-day snapshot
    (inner) and end-day snapshot (left).  ``Normalized`` = loan when the start
    bucket is ``bucket`` and the end bucket 0 (a missing end counts as 0).
    Rows fan out exactly as the reference's joins do (one per called number
    and customer)."""
    # called numbers per loan once, of all periods; a loan belongs to one customer, so they are few.  The
    # snapshot's two days meet by loan before, so on tables stored by loan only the called loans move.
    active = t.by_loan(None, called_customers_loans(t, periods), periods).groupBy("loan_account").agg(
        F.collect_set(F.struct(*KEY, "MOBILENUMBER", "customer_id")).alias("numbers"))
    first, dpd = F.col("first"), F.struct(F.col("max_dpd").alias("dpd"))
    days = t.by_loan("bucket_flow", first_and_last_days(t, periods).select(*KEY, "loan_account", "max_dpd", "first"), periods)
    days = days.groupBy(*KEY, "loan_account").agg(F.collect_set(F.when(first, dpd)).alias("s"), F.collect_set(F.when(~first, dpd)).alias("e"))
    days = days.select(*KEY, "loan_account", F.explode("s").alias("s"), F.size("e").alias("n_e"), F.col("e").alias("ends"))
    days = days.select(*KEY, "loan_account", F.col("s.dpd").alias("s_dpd"), (F.col("n_e") > 0).alias("ended"), F.explode_outer("ends").alias("e"))
    both = days.withColumn("e_dpd", F.col("e.dpd")).join(active, "loan_account")
    of_period = F.filter("numbers", lambda x: (x[PS] == F.col(PS)) & (x[PE] == F.col(PE)))
    both = both.withColumn("numbers", of_period).filter(F.size("numbers") > 0)
    # each number meets every number of the loan that has an end day: k x k rows only here
    both = both.withColumn("number", F.explode("numbers")).withColumn(
        "_times", F.explode(F.sequence(F.lit(1), F.when(F.col("ended"), F.size("numbers")).otherwise(1))))
    out = both.select(
        F.col(PS).alias("weekstartdate"), F.col(PE).alias("weekenddate"),
        F.col("number.MOBILENUMBER").alias("MOBILENUMBER"), "loan_account",
        legacy_bucket_label("s_dpd").alias("weekstartbucket"),
        F.when(F.col("ended"), legacy_bucket_label("e_dpd")).alias("weekendbucket"),
        legacy_bucket("s_dpd").alias("weekstartnumbucket"),
        F.when(F.col("ended"), legacy_bucket("e_dpd")).alias("weekendnumbucket"),
    )
    return out.withColumn(
        "Normalized",
        F.when((F.coalesce("weekstartnumbucket", F.lit(0)) == bucket)
               & (F.coalesce("weekendnumbucket", F.lit(0)) == 0), F.col("loan_account")))


def rollback(t: Tables, periods: Periods) -> DataFrame:
    """Roll-back of instalments due in the period: went delinquent (DPD > 0 and
    ever delinquent), still delinquent, rolled back (DPD 1-30, delinquent but
    not any more), their amounts and the two rates.  One row per period that
    has instalments due."""
    spark = t.calls.sparkSession
    base = (t.during("installments", "due_date", periods)
            .join(periods.calendar(spark).withColumnRenamed("day", "due_date"), "due_date"))
    d = dpd0("dpd")
    delq = F.col("is_delinq") == 1
    cur = F.col("is_cur_delinq")
    b130 = d.between(1, 30)
    z = F.lit(0)
    agg = base.groupBy(*KEY).agg(
        F.countDistinct("loan_account").alias("cntloans"),
        F.min("dpd").alias("mindpd"),
        F.max("dpd").alias("maxdpd"),
        F.sum(F.when(d > 0, F.col("is_delinq")).otherwise(z)).cast("long").alias("wentdelinquent"),
        F.sum(F.when((d > 0) & delq, cur).otherwise(z)).cast("long").alias("stilldelinquent"),
        (F.sum(F.when(b130, F.col("is_delinq")).otherwise(z))
         - F.sum(F.when(b130 & delq, cur).otherwise(z))).cast("long").alias("rollbacked"),
        F.sum(F.when((d > 0) & delq, F.col("amount")).otherwise(z)).cast("double").alias("defaulteddelinquentamount"),
        F.sum(F.when((d > 0) & delq & (cur == 1), F.col("amount")).otherwise(z)).cast("double").alias("stilldelinquentamount"),
        F.sum(F.when(b130 & delq & (cur == 0), F.col("paid")).otherwise(z)).cast("double").alias("rollbacked_amount"),
    )
    return (agg.withColumn("rollback_rate", safe_div("rollbacked", "wentdelinquent"))
               .withColumn("rollback_rate_v", safe_div("rollbacked_amount", "defaulteddelinquentamount")))

"""Promise-to-pay KPIs for bucket 1 and 2 phones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import dpd0, safe_div
from ..rules import DEFAULT, PRESETS, Rules
from ..sources.periods import AS_OF, KEY, PE, Periods
from ..sources.tables import Tables
from .common import arrears, loan_phone, on_periods, scalar_lookup, snapshot_in_periods

# Bucket -> end-DPD cap.
PTP_BUCKETS = {1: 30, 2: 60}
FLAGS = ["ptp_received", "Kept_ptp", "Normalized", "Normalizedwithoutptp", "Normalized_cnt",
         "Normalized_cnt_denominator", "Normalizedwithoutptp_cnt"]


def _bucket_loans(t: Tables, periods: Periods, rules: Rules) -> DataFrame:
    """One row per (period, bucket, loan): n snapshot rows, the customer's earliest active number."""
    in_buckets = F.array_compact(F.array(*(F.when(F.col(f"in_{b}"), F.struct(F.lit(b).alias("b"), F.col(f"n_{b}").alias("n"))) for b in PTP_BUCKETS)))
    rows = arrears(t, periods, rules.bucket_membership).select(*KEY, "loan_account", F.explode(in_buckets).alias("x"))
    return rows.select(*KEY, "loan_account", F.col("x.b").alias("bucket"), F.col("x.n").alias("n")).join(
        loan_phone(t).select("loan_account", "phone10"), "loan_account")


def _end_dpd(t: Tables, periods: Periods, rules: Rules) -> DataFrame:
    """End-day DPD of loans that have an active contact (``buck1end``)."""
    early = rules.end_snapshot_day_before
    end = (snapshot_in_periods(t, periods, "end", before=int(early))
           .filter(F.col("first_due") <= F.col(PE if early else AS_OF))
           .select(*KEY, "loan_account", F.col("max_dpd").alias("end_dpd")).distinct())
    return end.join(loan_phone(t).select("loan_account"), "loan_account")


def kept_loans(t: Tables, periods: Periods) -> DataFrame:
    """(period, loan) with a kept promise (status 1) contacted in the period.
    May contain a NULL loan (that matters for NOT IN)."""
    spark = t.calls.sparkSession
    return (t.during("ptp", "contact_date", periods).filter(F.coalesce("status", F.lit(0)) == 1)
            .withColumn("day", F.to_date("contact_date")).join(periods.calendar(spark), "day")
            .select(*KEY, "loan_account").distinct())


def received_loans(t: Tables) -> DataFrame:
    """Loans with any promise that has a due date (any time: no period filter)."""
    return t.ptp.filter(F.col("due_date").isNotNull()).select("loan_account").distinct()


def paid_loans(t: Tables, periods: Periods) -> DataFrame:
    spark = t.calls.sparkSession
    return (t.during("installments", "last_payment_date", periods)
            .join(periods.calendar(spark).withColumnRenamed("day", "last_payment_date"), "last_payment_date")
            .select(*KEY, "loan_account").distinct())


def ptp_flags(t: Tables, periods: Periods, bucket: int, rules: Rules = DEFAULT) -> DataFrame:
    """Per bucket loan: its phone, end DPD and the phone-valued flags of :data:`FLAGS`."""
    f = _flags(t, periods, rules).filter(F.col("bucket") == bucket)
    return f.select(*KEY, "loan_account", "phone10", "end_dpd", *(F.when(F.col(c), F.col("phone10")).alias(c) for c in FLAGS))


def _flags(t: Tables, periods: Periods, rules: Rules) -> DataFrame:
    """Per bucket loan of both buckets: its phone, ``n`` snapshot rows, end DPD and the flags
    of :data:`FLAGS` as booleans (NULL where ``NOT IN`` is unknown).

    ``IN (subquery)`` becomes a left join to distinct keys; ``NOT IN`` keeps
    its null-aware meaning: if the kept-PTP set of the period contains a NULL
    loan, every non-match is NULL rather than true."""
    return t.shared(("ptp_flags", periods, rules), lambda: _build_flags(t, periods, rules))


def _build_flags(t: Tables, periods: Periods, rules: Rules) -> DataFrame:
    j = _bucket_loans(t, periods, rules).join(_end_dpd(t, periods, rules), KEY + ["loan_account"], "left")
    kept = kept_loans(t, periods)
    kept_nonnull = kept.filter(F.col("loan_account").isNotNull()).withColumn("_kept", F.lit(True))
    kept_has_null = (kept.groupBy(*KEY)
                     .agg(F.max(F.col("loan_account").isNull().cast("int")).alias("_kn")))
    rec = received_loans(t).filter(F.col("loan_account").isNotNull()).withColumn("_rec", F.lit(True))
    j = (j.join(kept_nonnull, KEY + ["loan_account"], "left")
          .join(F.broadcast(kept_has_null), KEY, "left")
          .join(rec, "loan_account", "left"))
    if rules.normalized_rule in ("le_cap", "kept", "le_start"):
        counts = F.lit(rules.normalized_rule == "le_cap")
    else:
        paid = paid_loans(t, periods).withColumn("_paid", F.lit(True))
        j = j.join(paid, KEY + ["loan_account"], "left")
        counts = F.coalesce("_paid", F.lit(False))
    is_kept = F.coalesce("_kept", F.lit(False))
    # NOT IN: true if no match and the set has no NULL; NULL if no match and a NULL exists.
    not_kept = F.when(is_kept, F.lit(False)).when(F.coalesce("_kn", F.lit(0)) == 1, F.lit(None)).otherwise(F.lit(True))
    e = dpd0("end_dpd")
    cap = F.when(F.col("bucket") == 1, F.lit(PTP_BUCKETS[1])).otherwise(F.lit(PTP_BUCKETS[2]))
    well = e <= F.when(F.col("bucket") == 2, F.lit(rules.bucket2_normalized_cap)).otherwise(F.lit(0))
    values = [F.coalesce("_rec", F.lit(False)), is_kept, well & is_kept, well & not_kept,
              (e <= cap) & counts, F.lit(True), (e <= cap) & not_kept]
    return j.select(*KEY, "bucket", "loan_account", "phone10", "n", "end_dpd", *(v.alias(c) for c, v in zip(FLAGS, values)))


def _phones_by_flag(flags: DataFrame, names: list[str]) -> DataFrame:
    """Distinct phones per period, bucket and flag (``b{bucket}_{flag}``): flags combine per
    phone, then add up, so several distinct counts need no expanded rows."""
    per_phone = flags.filter(F.col("phone10").isNotNull()).groupBy(*KEY, "bucket", "phone10").agg(*(F.max(c).alias(c) for c in names))
    return per_phone.groupBy(*KEY).agg(*(F.count(F.when((F.col("bucket") == b) & F.col(c), 1)).alias(f"b{b}_{c.lower()}")
                                         for b in PTP_BUCKETS for c in names))


def normalized_via_ptp(t: Tables, periods: Periods, rules: Rules = PRESETS["v4"]) -> DataFrame:
    """Distinct-phone counts of every flag, for buckets 1 and 2 (one row per period).
    The numerator on phones is that of v1 to v4 and yearly; the rule of v5 is on loans and raises."""
    rules.require(normalized_rule=("le_cap", "le_cap_paid", "kept"))
    out = _phones_by_flag(_flags(t, periods, rules), FLAGS)
    cols = [c for c in out.columns if c not in KEY]
    return on_periods(periods, t.calls.sparkSession, F.broadcast(out), zero_cols=cols)


def ptp_received_kept(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """``ptp_received`` / ``kept_ptp``: distinct bucket-1 phones plus distinct
    bucket-2 phones (a phone in both counts twice), and the kept rate."""
    agg = _phones_by_flag(_flags(t, periods, rules), ["ptp_received", "Kept_ptp"])
    out = on_periods(periods, t.calls.sparkSession, F.broadcast(agg), zero_cols=[c for c in agg.columns if c not in KEY])
    received, kept = F.col("b1_ptp_received") + F.col("b2_ptp_received"), F.col("b1_kept_ptp") + F.col("b2_kept_ptp")
    return out.select(*KEY, received.alias("ptp_received"), kept.alias("kept_ptp"), safe_div(kept, received).alias("kept_ptp_rate"))


def ptp_payments(t: Tables, periods: Periods) -> DataFrame:
    """(period, loan) -> sum of promise payments (status > 0) contacted in the
    period.  Pre-aggregated by (period, loan), then left-joined: the
    correlated scalar SUM of the reference, decorrelated."""
    spark = t.calls.sparkSession
    p = (t.during("ptp", "contact_date", periods)
         .withColumn("day", F.to_date("contact_date")).join(periods.calendar(spark), "day"))
    amt = F.when(F.coalesce("status", F.lit(0)) > 0, F.col("amount")).otherwise(F.lit(0))
    return p.groupBy(*KEY, "loan_account").agg(F.sum(amt).alias("ptpamount"))


def ptp_payments_by_bucket(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """``bucket1ptppmt`` / ``bucket2ptppmt``: over the distinct loans of each
    bucket, the sum of their in-period promise payments (NULL if none).
    Deduplicated on (period, loan) (deviation D-6); under ``promise_amounts``
    'row' a loan counts once per snapshot row, under 'normalized' also only if it
    normalised with a kept promise (else 0)."""
    pay = ptp_payments(t, periods)
    f = _flags(t, periods, rules)
    if rules.promise_amounts == "loan":
        loans, amount = f.select(*KEY, "bucket", "loan_account").distinct(), F.col("ptpamount")
    else:
        loans, amount = f.select(*KEY, "bucket", "loan_account", "n", "Normalized", "phone10"), F.col("ptpamount") * F.col("n")
    if rules.promise_amounts == "normalized":
        amount = F.when(F.col("Normalized") & F.col("phone10").isNotNull(), amount).otherwise(F.lit(0))
    agg = loans.join(pay, KEY + ["loan_account"], "left").groupBy(*KEY).agg(
        *(F.sum(F.when(F.col("bucket") == b, amount)).cast("double").alias(f"bucket{b}ptppmt") for b in PTP_BUCKETS))
    return on_periods(periods, t.calls.sparkSession, F.broadcast(agg))


def ptp_with_dpd(t: Tables, periods: Periods) -> DataFrame:
    """Promises contacted in the period that have a due date, each with the
    loan's DPD on the contact day (NULL if no snapshot that day).  The
    reference's correlated scalar lookup becomes a left join on (loan, day) that fails, as the
    scalar subquery does, where the snapshot holds two rows of a promise's loan and day."""
    spark = t.calls.sparkSession
    p = (t.during("ptp", "contact_date", periods).filter(F.col("due_date").isNotNull())
         .withColumn("day", F.to_date("contact_date")).join(periods.calendar(spark).drop("as_of"), "day"))
    # the contact days lie in the periods, so the snapshot scan is bounded too
    snap = t.bucket_flow.filter(periods.date_bounds("bucket_date")).select("loan_account", F.col("bucket_date").alias("day"), "max_dpd")
    out = scalar_lookup(p, snap, ["loan_account", "day"], "max_dpd", "dpd", "snapshot row")
    return out.select(*KEY, "loan_account", "phone", "contact_date", "due_date", "status", "amount", "dpd")

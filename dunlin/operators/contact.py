"""Contact-rate KPIs: welcome / reminder calls and bucket 1-3 collection calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import safe_div
from ..rules import DEFAULT, Rules
from ..sources.periods import KEY, PE, Periods
from ..sources.tables import Tables
from .common import (arrears, bucket_phones, calls_in_periods, last_leg, loan_phone, on_periods,
                     open_loan_phones, open_loan_phones_between, phone_join)


def _eligible_calls(t: Tables, periods: Periods, reference: str, rules: Rules) -> DataFrame:
    """Legs of ``reference`` calls to phones of open loans (the ``disb`` CTE)."""
    if rules.disbursed_within_period:
        ph = open_loan_phones_between(t, periods)
        legs = calls_in_periods(t, periods, [reference], date_filter=rules.welcome_date_filter, phones=ph)
        return phone_join(t, legs, ph, KEY + ["phone10"], "left_semi") if rules.welcome_date_filter else legs
    rules.require(welcome_date_filter=True)
    legs = calls_in_periods(t, periods, [reference])
    ph = open_loan_phones(t)
    return (phone_join(t, legs, ph, "phone10")
                .filter(F.col("first_disb") <= F.col(PE))
                .drop("first_disb"))


def call_contact_rate(t: Tables, periods: Periods, reference: str, names: tuple[str, str, str],
                      rules: Rules = DEFAULT) -> DataFrame:
    """Distinct phones reached (last leg APC = 1) / distinct phones called, per
    period, for one campaign reference ('WC', 'REM')."""
    spark = t.calls.sparkSession
    top = last_leg(_eligible_calls(t, periods, reference, rules))
    connected, called, rate = names
    agg = top.groupBy(*KEY).agg(
        F.countDistinct(F.when(F.col("apc") == 1, F.col("phone10"))).alias(connected),
        F.countDistinct("phone10").alias(called),
    )
    out = on_periods(periods, spark, agg, zero_cols=(connected, called))
    return out.withColumn(rate, safe_div(connected, called))


def welcome_call_contact_rate(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    return call_contact_rate(t, periods, "WC",
                             ("apc_wc_connected", "wccalled", "WelcomeCall_ContactRate"), rules)


def reminder_call_contact_rate(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    return call_contact_rate(t, periods, "REM",
                             ("apc_rc_connected", "rccalled", "remindercallcontactrate"), rules)


def welcome_call_detail(t: Tables, periods: Periods, rules: Rules = DEFAULT) -> DataFrame:
    """Call-level rows behind the welcome-call rate (the reconciliation
    extract): the winning leg of every eligible call with its flags, campaign, agent and outcome."""
    top = last_leg(_eligible_calls(t, periods, "WC", rules))
    return top.select(
        *KEY, "call_id", "call_at", F.col("phone10").alias("mobileNumber"),
        F.col("apc").alias("APC"), F.col("rpc").alias("RPC"), F.col("ptp").alias("PTP"),
        F.when(F.col("apc") == 1, F.col("phone10")).alias("apc_m"),
        F.when(F.col("rpc") == 1, F.col("phone10")).alias("rpc_m"),
        F.when(F.col("ptp") == 1, F.col("phone10")).alias("ptp_m"),
        "campaign", "agent_group", "agent", "employee_id", "connected", "not_connected", "call_result",
    )


# Bucket number -> (call subcategory, output names).
BUCKETS = {
    1: ("SOFT", ("bucket1contacted", "bucketcallcontacted", "bucket1contactrate")),
    2: (None, ("bucket2contacted", "bucket2callcontacted", "bucket2contactrate")),
    3: ("HARD", ("bucket3contacted", "bucket3callcontacted", "bucket3contactrate")),
}


def bucket_contact_rate(t: Tables, periods: Periods, bucket: int, rules: Rules = DEFAULT) -> DataFrame:
    """Bucket ``n`` collection-call contact rate.

    Phones: customers' earliest active numbers of loans In Arrears with DPD in
    the bucket range on any day of the period.  Calls: 'COLL' (with the
    bucket's subcategory) in the period to those phones; last leg per call
    (under ``rank_before_bucket`` the last leg of all its legs, if to such a phone).
    ``contacted`` counts distinct *raw* numbers with IS_APC = 1, ``called``
    distinct 10-digit keys (as the reference does)."""
    spark = t.calls.sparkSession
    sub, (contacted, called, rate) = BUCKETS[bucket]
    phones = bucket_phones(t, periods, bucket, membership=rules.bucket_membership)
    legs = calls_in_periods(t, periods, ["COLL"], sub)
    if rules.rank_before_bucket:
        top = phone_join(t, last_leg(legs), phones, KEY + ["phone10"], "left_semi")
    else:
        top = last_leg(phone_join(t, legs, phones, KEY + ["phone10"], "left_semi"))
    agg = top.groupBy(*KEY).agg(
        F.countDistinct(F.when(F.col("is_apc") == 1, F.col("mobile"))).alias(contacted),
        F.countDistinct("phone10").alias(called),
    )
    out = on_periods(periods, spark, agg, zero_cols=(contacted, called))
    return out.withColumn(rate, safe_div(contacted, called))


# What a leg counts for -> output names of reached, called, rate.
RATES = {
    "wc": ("apc_wc_connected", "wccalled", "WelcomeCall_ContactRate"),
    "rem": ("apc_rc_connected", "rccalled", "remindercallcontactrate"),
    **{f"b{n}": names for n, (_, names) in BUCKETS.items()},
}


def contact_rates(t: Tables, periods: Periods) -> DataFrame:
    """All five contact rates (latest rules), one row per period, from one scan of the calls.

    A leg carries the KPIs that its campaign and phone count for; it is ranked once per
    (KPI, call).  Phones bring their first open disbursement and their buckets along."""
    spark = t.calls.sparkSession
    flags = arrears(t, periods).join(loan_phone(t), "loan_account").filter(F.col("phone10").isNotNull())
    flags = flags.groupBy(*KEY, "phone10").agg(*(F.max(f"in_{b}").alias(f"in_{b}") for b in BUCKETS))
    legs = phone_join(t, calls_in_periods(t, periods, ["WC", "REM", "COLL"]), open_loan_phones(t), "phone10", "left")
    legs = phone_join(t, legs, flags, KEY + ["phone10"], "left")
    is_open, coll = F.col("first_disb") <= F.col(PE), F.col("reference") == "COLL"
    counts = {"wc": (F.col("reference") == "WC") & is_open, "rem": (F.col("reference") == "REM") & is_open}
    for b, (sub, _) in BUCKETS.items():
        counts[f"b{b}"] = coll & F.col(f"in_{b}") & (F.lit(True) if sub is None else F.col("subcategory") == sub)
    legs = legs.withColumn("kpi", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in counts.items())))))
    top = last_leg(legs, "kpi")
    reached = F.when(F.col("kpi").isin("wc", "rem"), F.when(F.col("apc") == 1, F.col("phone10"))).otherwise(
        F.when(F.col("is_apc") == 1, F.col("mobile")))
    per_kpi = top.groupBy(*KEY, "kpi").agg(F.countDistinct(reached).alias("reached"), F.countDistinct("phone10").alias("called"))
    agg = per_kpi.groupBy(*KEY).agg(*(F.max(F.when(F.col("kpi") == k, F.col(src))).alias(name)
                                      for k, names in RATES.items() for src, name in zip(("reached", "called"), names)))
    out = on_periods(periods, spark, agg, zero_cols=[n for names in RATES.values() for n in names[:2]])
    return out.withColumns({rate: safe_div(a, b) for a, b, rate in RATES.values()})

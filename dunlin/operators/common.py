"""Building blocks shared by the KPI operators.

Scale notes (apply to every operator built on these):

* Periods enter plans as a broadcast frame or a broadcast day calendar whose
  row count is known on the driver (:mod:`dunlin.sources.periods`); date
  ranges are also pushed to the scan as literal bounds.
* Dimension tables are broadcast only behind :func:`bounded_broadcast`, which
  counts at most ``limit + 1`` rows first; beyond the bound the planner (AQE)
  chooses a shuffled join.
* Top-1 per call, earliest contact per customer and first disbursement per
  phone are aggregations with map-side partial aggregation, so a hot key (one
  call id, customer or phone holding a large share of rows) is reduced on
  every mapper before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import flag, phone10
from ..sources.periods import AS_OF, KEY, PE, PS, Periods
from ..sources.tables import Tables
from .skew import split_join

DIM_BROADCAST_ROWS = 100_000


def bounded_broadcast(t: Tables, name: str, df: DataFrame, limit: int = DIM_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df``, rows of table ``name``, only if that table has at most
    ``limit`` rows (checked once per :class:`Tables` value); otherwise leave
    the join to the planner (AQE still broadcasts if runtime stats are small)."""
    return F.broadcast(df) if t.at_most(name, limit) else df


def campaigns(t: Tables, references, subcategory: str | None = None) -> DataFrame:
    """Upper-cased campaign names whose reference is in ``references``
    (and subcategory matches, if given).  ``cm.reference = 'X'`` after a LEFT
    JOIN makes the join inner; a NULL reference never matches."""
    cm = t.campaign_master.filter(F.col("reference").isin(list(references)))
    if subcategory is not None:
        cm = cm.filter(F.col("subcategory") == subcategory)
    # no DISTINCT: like the reference's LEFT JOIN, a duplicated campaign row
    # duplicates legs, which no distinct count or top-1 result can see
    cm = cm.select(F.upper("campaign").alias("campaign_u"), "reference", "subcategory")
    return bounded_broadcast(t, "campaign_master", cm)


def calls_in_periods(t: Tables, periods: Periods, references, subcategory=None,
                     date_filter: bool = True, phones: DataFrame | None = None) -> DataFrame:
    """Call legs of the given campaign references, attached to every period
    whose day range contains ``date(call_at)``.

    Columns: period key, as_of, call_id, call_at, mobile (raw), phone10, apc,
    rpc, ptp (null-defaulted), is_apc (raw), agent, reference.
    ``date_filter=False`` (yearly welcome calls, v1-v2 welcome) attaches a call
    of any day to every period whose ``phones`` (distinct period key, phone10) hold its number.
    """
    spark = t.calls.sparkSession
    cm = campaigns(t, references, subcategory)
    c = t.during("calls", "call_at", periods) if date_filter else t.calls
    legs = c.join(cm, F.upper(c["campaign"]) == cm["campaign_u"], "inner")
    if date_filter:
        legs = legs.withColumn("day", F.to_date("call_at")).join(periods.calendar(spark), "day")
    else:
        # Legacy rule: the call date is not filtered.  A leg joins the periods
        # of its phone only, so it does not fan out to every period.
        if phones is None:
            raise ValueError("calls without a date filter need the (period, phone) set they are read for")
        of = phones.join(periods.frame(spark), KEY).select(*KEY, AS_OF, F.col("phone10").alias("_ph"))
        legs = legs.join(of, phone10("mobile") == F.col("_ph")).drop("_ph")
    return legs.select(
        *KEY, AS_OF, "call_id", "call_at", "mobile",
        phone10("mobile").alias("phone10"),
        flag("is_apc").alias("apc"), flag("is_rpc").alias("rpc"), flag("is_ptp").alias("ptp"),
        "is_apc", "agent", "reference", "subcategory", "campaign", "agent_group", "employee_id", "connected", "not_connected", "call_result",
    )


def last_leg(legs: DataFrame, *by: str) -> DataFrame:
    """Top-1 leg per (period, call, ``by``): latest ``call_at``; ties prefer APC, RPC,
    PTP = 0, then the smaller phone key (our deterministic tiebreak).

    ``row_number() = 1`` is planned with a partial WindowGroupLimit before the
    shuffle, so each mapper forwards at most one row per call."""
    w = Window.partitionBy(*KEY, *by, "call_id").orderBy(
        F.col("call_at").desc(), "apc", "rpc", "ptp", "phone10", "mobile")
    return legs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def open_loan_phones(t: Tables, statuses=("Settled", "Completed")) -> DataFrame:
    """Phones of loans not closed (NULL status kept), with the first
    disbursement day per phone: a phone is eligible for a period iff
    ``first_disb <= period end`` (the ``disb``/``rnk = 1`` CTE).  One row per
    phone, so joining calls to it never fans out."""
    lm = t.loan_master.filter(~F.coalesce(F.col("loan_paid_status"), F.lit("NA")).isin(list(statuses)))
    return (lm.select(phone10("mobile_no").alias("phone10"), F.to_date("disbursed_at").alias("d"))
              .filter(F.col("phone10").isNotNull())
              .groupBy("phone10").agg(F.min("d").alias("first_disb")))


def open_loan_phones_between(t: Tables, periods: Periods, statuses=("Settled", "Completed")) -> DataFrame:
    """Variant (v1, v2, v4a, yearly): loans disbursed *within* the period.
    Distinct (phone, day) joined to the day calendar -> distinct (period, phone)."""
    spark = t.calls.sparkSession
    lm = t.loan_master.filter(~F.coalesce(F.col("loan_paid_status"), F.lit("NA")).isin(list(statuses)))
    pd_ = (lm.filter(periods.ts_bounds("disbursed_at"))
             .select(phone10("mobile_no").alias("phone10"), F.to_date("disbursed_at").alias("day"))
             .filter(F.col("phone10").isNotNull()).distinct())
    return pd_.join(periods.calendar(spark), "day").select(*KEY, "phone10").distinct()


def phone_join(t: Tables, many: DataFrame, few: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join on phone numbers, of which one may stand on a large share of ``many``: adaptive skew joins
    split it, or :func:`dunlin.operators.skew.split_join` where ``t`` says so."""
    on = [on] if isinstance(on, str) else list(on)
    return split_join(many, few, on, how) if t.split_hot else many.join(few, on, how)


def scalar_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], value: str, name: str, what: str) -> DataFrame:
    """``rows`` with ``name`` = the ``value`` of the one row of ``lookup`` that matches on ``on``; null where none does.

    A scalar subquery: a row that matches more than one row of ``lookup`` (equal or not) is an error when it is computed.  The
    count comes from the aggregation by the keys of the join, so the join shuffles nothing that
    it would not have shuffled.  Rows with a null key match nothing and do not travel."""
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    one = lookup.filter(known).groupBy(*on).agg(F.max(value).alias("_value"), F.count(F.lit(1)).alias("_matches"))
    kind = lookup.schema[value].dataType
    many = F.raise_error(F.concat(F.lit(f"more than one {what} for "), F.to_json(F.struct(*on))))
    found = rows.filter(known).join(one, on, "left")
    found = found.withColumn(name, F.when(F.col("_matches") > 1, many.cast(kind)).otherwise(F.col("_value"))).drop("_value", "_matches")
    none = rows.filter(~known).withColumn(name, F.lit(None).cast(kind))
    return found.select(*none.columns).unionByName(none)


def active_contact(t: Tables) -> DataFrame:
    """Earliest active number per customer (``ROW_NUMBER() OVER (PARTITION BY
    customer_id ORDER BY change_date) = 1`` with ``ACTIVE = 'Y'``), as a
    10-digit key.  min(struct) keeps it a partial aggregation."""
    cd = t.contact_details.filter(F.col("active") == "Y")
    first = cd.groupBy("customer_id").agg(F.min(F.struct("change_date", "mobile")).alias("m"))
    return first.select("customer_id", phone10(F.col("m.mobile")).alias("phone10"))


def loan_phone(t: Tables) -> DataFrame:
    """loan_account -> customer's earliest active phone key (inner: loans
    without an active contact drop out, as ``cd.rnk = 1`` in WHERE does)."""
    def build():
        lm = t.loan_master.select("loan_account", "customer_id")
        return lm.join(active_contact(t), "customer_id").select("loan_account", "customer_id", "phone10")
    return t.shared(("loan_phone",), build)


def snapshot_in_periods(t: Tables, periods: Periods, day: str = "any", before: int = 0) -> DataFrame:
    """Daily snapshot rows attached to periods.

    ``day='any'``: every day of the period (calendar equi-join);
    ``'start'`` / ``'end'``: only ``bucket_date = period start / end``, the
    latter ``before`` days earlier."""
    spark = t.calls.sparkSession
    bf = t.bucket_flow
    if day == "any":
        return bf.filter(periods.date_bounds("bucket_date")).join(
            periods.calendar(spark).withColumnRenamed("day", "bucket_date"), "bucket_date")
    col = PS if day == "start" else PE
    fr = periods.frame(spark)
    days = sorted({s if day == "start" else e - _dt.timedelta(days=before) for s, e, _ in periods.spans})
    return (bf.filter(F.col("bucket_date").isin(days))
              .join(fr, F.date_add(bf["bucket_date"], before if day == "end" else 0) == fr[col]))


def first_and_last_days(t: Tables, periods: Periods) -> DataFrame:
    """Snapshot rows of each period's first and last day, in one scan; ``first`` tells which (a period
    of one day has its rows twice).  Rows without a loan are left out."""
    ends = F.array(F.struct(F.col(PS).alias("day"), F.lit(True).alias("first")), F.struct(F.col(PE).alias("day"), F.lit(False).alias("first")))
    frame = periods.frame(t.calls.sparkSession).select(*KEY, F.explode(ends).alias("x")).select(*KEY, "x.*")
    days = sorted({d for s, e, _ in periods.spans for d in (s, e)})
    rows = t.bucket_flow.filter(F.col("bucket_date").isin(days) & F.col("loan_account").isNotNull())
    return rows.join(F.broadcast(frame), rows["bucket_date"] == frame["day"]).drop("day")  # two rows for each period


# Bucket -> DPD range.
BUCKET_RANGES = {1: (1, 30), 2: (31, 60), 3: (61, 90)}


def arrears(t: Tables, periods: Periods, membership: str = "any") -> DataFrame:
    """(period, loan, in_1, in_2, in_3, n_1, n_2): loans In Arrears with the DPD of
    a bucket on any day of the period (or the start day), first due <= as_of;
    n_b counts their snapshot rows in the bucket.

    One filtered, column-pruned scan of the snapshot, combined per loan before
    the shuffle, serves every bucket of the contact and promise KPIs."""
    def build():
        snap = snapshot_in_periods(t, periods, membership).filter(
            (F.col("loan_status") == "In Arrears") & F.col("max_dpd").between(1, 90) & (F.col("first_due") <= F.col(AS_OF)))
        return snap.groupBy(*KEY, "loan_account").agg(
            *(F.max(F.col("max_dpd").between(lo, hi)).alias(f"in_{b}") for b, (lo, hi) in BUCKET_RANGES.items()),
            *(F.count(F.when(F.col("max_dpd").between(*BUCKET_RANGES[b]), 1)).alias(f"n_{b}") for b in (1, 2)))
    return t.shared(("arrears", periods, membership), build)


def bucket_phones(t: Tables, periods: Periods, bucket: int, membership: str = "any") -> DataFrame:
    """Distinct (period, phone10) of a bucket's loans (:func:`arrears`), mapped to
    the customer's earliest active number.  The latest-snapshot ``rnk = 1`` filter
    of the reference does not change the phone set, so it is not applied."""
    loans = arrears(t, periods, membership).filter(f"in_{bucket}").select(*KEY, "loan_account")
    return (loans.join(loan_phone(t), "loan_account")
                 .filter(F.col("phone10").isNotNull())
                 .select(*KEY, "phone10").distinct())


def on_periods(periods: Periods, spark, agg: DataFrame, zero_cols=()) -> DataFrame:
    """Left-join per-period results onto the period list so every period has a
    row (scalar-subquery semantics: counts of an empty set are 0)."""
    out = periods.frame(spark).drop(AS_OF).join(agg, KEY, "left")
    for c in zero_cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return out

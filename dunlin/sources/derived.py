"""The seven collections tables, derived from the driver's TPC-H-ish tables.

The reference ships no inputs; these rules (fixed by FIXTURES.md §2) turn
``orders / customer / events / lineitem`` into loan master, call legs,
campaign dimension, contact history, daily delinquency snapshot, instalments
and promise-to-pay log.  Everything is a narrow projection of one source table
(the snapshot fans each order out to 31 days with a generator), so the
derivation scales with the inputs and never shuffles.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from .tables import Tables

SNAPSHOT_START = _dt.date(2024, 1, 1)
SNAPSHOT_DAYS = 31
INSTALLMENT_BASE = _dt.date(2023, 12, 15)

# Fixed values of the fixture: campaign dimension rows (name, reference, subcategory).
CAMPAIGNS = [
    ("signup", "WC", None),
    ("view", "REM", None),
    ("click", "COLL", "SOFT"),
    ("error", "COLL", "HARD"),
]


def _phone(prefix: str, num: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(num.cast("string"), 10, "0"))


def _div(a: Column, b: int) -> Column:
    """Integer division of a non-negative key (SQL ``a div b``)."""
    return F.floor(a / F.lit(b)).cast("long")


def loan_master(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    status = (F.when(k % 17 == 0, F.lit(None).cast("string"))
              .when(k % 19 == 0, "Written Off")
              .when(k % 23 == 0, "Settled")
              .when(F.col("o_orderstatus") == "F", "Completed")
              .when(F.col("o_orderstatus") == "P", "In Arrears")
              .otherwise("Normal"))
    return orders.select(
        k.cast("string").alias("loan_account"),
        F.col("o_custkey").alias("customer_id"),
        _phone("63", _div(F.col("o_custkey"), 10)).alias("mobile_no"),
        F.col("o_orderpriority").alias("loan_type"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 8400 DAYS")).alias("disbursed_at"),
        status.alias("loan_paid_status"),
        F.when(k % 11 == 0, 0).otherwise(1).cast("int").alias("flag_disbursement"),
    )


def calls(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    v = F.col("value")
    return events.select(
        F.concat(F.lit("C"), _div(e, 2).cast("string")).alias("call_id"),
        F.col("ts").cast("timestamp").alias("call_at"),
        _phone("63", F.col("user_id")).alias("mobile"),
        F.upper("event_type").alias("campaign"),
        F.concat(F.lit("Agent "), (e % 40).cast("string")).alias("agent"),
        F.when(e % 13 == 0, F.lit(None)).otherwise((v > 20).cast("int")).cast("int").alias("is_apc"),
        (v > 40).cast("int").alias("is_rpc"),
        (v > 60).cast("int").alias("is_ptp"),
        # columns of the detail extract, which the fixture's rules leave open
        F.concat(F.lit("Group "), (e % 4).cast("string")).alias("agent_group"),
        F.concat(F.lit("E"), F.lpad((e % 40).cast("string"), 4, "0")).alias("employee_id"),
        (v > 10).cast("int").alias("connected"),
        (v <= 10).cast("int").alias("not_connected"),
        F.when(v > 60, "PTP").when(v > 40, "RPC").when(v > 20, "Answered").when(v > 10, "Voicemail").otherwise("No answer").alias("call_result"),
    )


def campaign_master(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMPAIGNS, S.CAMPAIGN_MASTER)


def contact_details(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    first = customer.select(
        c.alias("customer_id"),
        _phone("63", _div(c, 10)).alias("mobile"),
        F.date_add(F.lit(_dt.date(2023, 1, 1)), (c % 300).cast("int")).alias("change_date"),
        F.lit("Y").alias("active"),
    )
    second = customer.select(
        c.alias("customer_id"),
        F.concat(F.lit("0"), F.lpad((_div(c, 10) + 1).cast("string"), 10, "0")).alias("mobile"),
        F.lit(_dt.date(2023, 12, 1)).alias("change_date"),
        F.when(c % 4 == 0, "N").otherwise("Y").alias("active"),
    )
    return first.unionByName(second)


def bucket_flow(orders: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    i = F.col("i")
    dpd = (F.when((k % 5 == 0) & (i >= k % 31), F.lit(0))
           .otherwise(F.greatest(F.lit(0), (k * 37) % 480 - 60 + i))).cast("int")
    base = orders.select("o_orderkey", "o_totalprice",
                         F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOT_DAYS - 1))).alias("i"))
    out = base.select(
        k.cast("string").alias("loan_account"),
        F.date_add(F.lit(SNAPSHOT_START), i).alias("bucket_date"),
        dpd.alias("max_dpd"),
        k.alias("_k"),
        F.col("o_totalprice").cast(S.AMOUNT).alias("outstanding"),
        i,
    )
    return out.select(
        "loan_account", "bucket_date", "max_dpd",
        F.when(F.col("_k") % 29 == 0, "Written Off")
         .when(F.col("max_dpd") > 0, "In Arrears").otherwise("Normal").alias("loan_status"),
        "outstanding",
        (F.col("outstanding") * F.least(F.col("max_dpd"), F.lit(100)).cast("decimal(3,0)")
         * F.lit(0.01).cast("decimal(3,2)")).cast(S.AMOUNT).alias("overdue"),
        F.date_add(F.lit(SNAPSHOT_START), (i - F.col("max_dpd")).cast("int")).alias("first_due"),
    )


def installments(lineitem: DataFrame) -> DataFrame:
    k = ((F.col("l_orderkey") + F.col("l_linenumber") * 5) % 60).cast("int")
    due = F.date_add(F.lit(INSTALLMENT_BASE), k)
    fin = F.col("l_linestatus") == "F"
    amount = F.col("l_extendedprice").cast(S.AMOUNT)
    return lineitem.select(
        F.col("l_orderkey").cast("string").alias("loan_account"),
        due.alias("due_date"),
        F.when(fin, F.date_add(due, F.col("l_quantity").cast("int") - 10)).alias("last_payment_date"),
        amount.alias("amount"),
        F.when(fin, amount * (F.lit(1) - F.col("l_discount")).cast("decimal(4,2)"))
         .otherwise(F.lit(0)).cast("decimal(18,4)").alias("paid"),
        F.col("l_returnflag").isin("A", "R").cast("int").alias("is_delinq"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_cur_delinq"),
        (F.col("l_quantity").cast("int") - 5).alias("dpd"),
    )


def ptp(events: DataFrame) -> DataFrame:
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    return events.filter(F.col("event_type") == "purchase").select(
        e.cast("string").alias("loan_account"),
        F.col("user_id").alias("phone"),
        ts.alias("contact_date"),
        F.when(e % 7 == 0, F.lit(None).cast("date")).otherwise(F.date_add(F.to_date(ts), 3)).alias("due_date"),
        F.when(e % 3 == 0, 1).when(e % 3 == 1, 0).cast("int").alias("status"),
        F.col("value").cast(S.AMOUNT).alias("amount"),
    )


def from_testdata(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy derivation over ``{sf_dir}/{name}.parquet``."""
    rd = lambda n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
    orders = rd("orders")
    events = rd("events")
    return Tables(
        loan_master=loan_master(orders),
        calls=calls(events),
        campaign_master=campaign_master(spark),
        contact_details=contact_details(rd("customer")),
        bucket_flow=bucket_flow(orders),
        installments=installments(rd("lineitem")),
        ptp=ptp(events),
    )

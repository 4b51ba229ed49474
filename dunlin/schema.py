"""Schemas of the seven input tables and of the report rows.

Names are ours (snake_case); the mapping of the original column names is in FIXTURES.md.  Amounts are DECIMAL(18,2); they are summed as decimals and only
emitted as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(18, 2)

LOAN_MASTER = T.StructType([
    T.StructField("loan_account", T.StringType()),
    T.StructField("customer_id", T.LongType()),
    T.StructField("mobile_no", T.StringType()),
    T.StructField("loan_type", T.StringType()),
    T.StructField("disbursed_at", T.TimestampType()),
    T.StructField("loan_paid_status", T.StringType()),
    T.StructField("flag_disbursement", T.IntegerType()),
])

CALLS = T.StructType([
    T.StructField("call_id", T.StringType()),
    T.StructField("call_at", T.TimestampType()),
    T.StructField("mobile", T.StringType()),
    T.StructField("campaign", T.StringType()),
    T.StructField("agent", T.StringType()),
    T.StructField("is_apc", T.IntegerType()),
    T.StructField("is_rpc", T.IntegerType()),
    T.StructField("is_ptp", T.IntegerType()),
    T.StructField("agent_group", T.StringType()),
    T.StructField("employee_id", T.StringType()),
    T.StructField("connected", T.IntegerType()),
    T.StructField("not_connected", T.IntegerType()),
    T.StructField("call_result", T.StringType()),
])

CAMPAIGN_MASTER = T.StructType([
    T.StructField("campaign", T.StringType()),
    T.StructField("reference", T.StringType()),
    T.StructField("subcategory", T.StringType()),
])

CONTACT_DETAILS = T.StructType([
    T.StructField("customer_id", T.LongType()),
    T.StructField("mobile", T.StringType()),
    T.StructField("change_date", T.DateType()),
    T.StructField("active", T.StringType()),
])

BUCKET_FLOW = T.StructType([
    T.StructField("loan_account", T.StringType()),
    T.StructField("bucket_date", T.DateType()),
    T.StructField("max_dpd", T.IntegerType()),
    T.StructField("loan_status", T.StringType()),
    T.StructField("outstanding", AMOUNT),
    T.StructField("overdue", AMOUNT),
    T.StructField("first_due", T.DateType()),
])

INSTALLMENTS = T.StructType([
    T.StructField("loan_account", T.StringType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("last_payment_date", T.DateType()),
    T.StructField("amount", AMOUNT),
    T.StructField("paid", T.DecimalType(18, 4)),
    T.StructField("is_delinq", T.IntegerType()),
    T.StructField("is_cur_delinq", T.IntegerType()),
    T.StructField("dpd", T.IntegerType()),
])

PTP = T.StructType([
    T.StructField("loan_account", T.StringType()),
    T.StructField("phone", T.LongType()),
    T.StructField("contact_date", T.TimestampType()),
    T.StructField("due_date", T.DateType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("amount", AMOUNT),
])

INPUTS = {
    "loan_master": LOAN_MASTER,
    "calls": CALLS,
    "campaign_master": CAMPAIGN_MASTER,
    "contact_details": CONTACT_DETAILS,
    "bucket_flow": BUCKET_FLOW,
    "installments": INSTALLMENTS,
    "ptp": PTP,
}

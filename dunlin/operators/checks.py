"""Ad-hoc checks over rows: duplicates of a key, the top rows of an ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import phone10
from ..sources.periods import KEY, Periods
from ..sources.tables import Tables
from .migration import called_customers_loans


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with how often (``HAVING count(key) > 1``; NULL keys do not count)."""
    g = df.groupBy(*keys).agg(F.count(F.struct(*keys) if len(keys) > 1 else keys[0]).alias("n"))
    return g.filter(F.col("n") > 1)


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first n rows of an ordering (sort, then head); the ordering should be total."""
    return df.orderBy(*order).limit(n)


def shared_loan_phones(t: Tables) -> DataFrame:
    """Phone keys that more than one loan names."""
    return duplicates(t.loan_master.select(phone10("mobile_no").alias("phone10")), "phone10")


def loans_called_on_several_numbers(t: Tables, periods: Periods) -> DataFrame:
    """Active loans of called customers that several called numbers reach."""
    return duplicates(called_customers_loans(t, periods), *KEY, "loan_account")


def largest_overdue(t: Tables, day, n: int = 20) -> DataFrame:
    """The n loans with the largest overdue amount on a day."""
    rows = t.bucket_flow.filter(F.col("bucket_date") == F.lit(day)).select("loan_account", F.col("overdue").cast("double").alias("overdue"), "max_dpd")
    return top_rows(rows, n, F.desc("overdue"), "loan_account")

"""Stored layouts of the input tables.

Days are partitions: the snapshot by its own date, the event tables by the day of the
column that the KPIs filter, in a partition column ``day`` next to the raw value.
Instalments are filtered by due date and by payment date, so those that have a payment are
stored a second time by the payment's day.  :meth:`Tables.during` translates a range of the raw column
to these partitions.

Loans are buckets (:func:`write_buckets`): every table keyed by loan is a catalog table
with the same number of buckets, sorted within.  Joins and aggregations of slices of
them by loan then read matching buckets side by side, and nothing is shuffled below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

# Table -> columns whose days it is stored by; the first copy holds all rows, a further one those with a value.
DAYS = {"calls": ["call_at"], "ptp": ["contact_date"], "installments": ["due_date", "last_payment_date"]}
SNAPSHOT_DAY = "bucket_date"
LOAN = "loan_account"
LOAN_TABLES = ("loan_master", "bucket_flow", "installments", "ptp")
ROWS_PER_BUCKET = 125_000  # of a day
FILES = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}  # sorted loans are kept as differences
ROWS_PER_TASK = 4_000_000  # that a task sorts and writes: all days of a bucket, or some of them


def copies(name: str) -> list[tuple[str | None, str | None, str]]:
    """(column whose day it is stored by, partition column, stored name) of each copy of a table."""
    if name == "bucket_flow":
        return [(SNAPSHOT_DAY, SNAPSHOT_DAY, name)]
    cols = DAYS.get(name)
    if not cols:
        return [(None, None, name)]
    return [(c, "day", name if k == 0 else f"{name}_by_{c}") for k, c in enumerate(cols)]


def _dated(t: Tables, name: str, column: str | None, part: str | None, first: bool) -> DataFrame:
    df: DataFrame = getattr(t, name)
    if not first:
        df = df.filter(F.col(column).isNotNull())
    return df.withColumn("day", F.to_date(column)) if part == "day" else df


def _opened(t: Tables, read, loan_buckets: dict | None = None) -> Tables:
    """Tables over stored copies; ``read(name, stored name, schema)`` opens one."""
    plain, by_day = {}, {}
    for name in t.names():
        declared = getattr(t, name)
        for k, (column, part, stored) in enumerate(copies(name)):
            schema = declared.schema if part != "day" else declared.withColumn("day", F.to_date(column)).schema
            df = read(name, stored, schema)
            if df is None:
                continue
            if part == "day":
                by_day[name, column] = df.select(*declared.columns, "day")
            if k == 0:
                plain[name] = df.select(*declared.columns)
    return Tables(**{n: plain.get(n, getattr(t, n)) for n in t.names()}, by_day=by_day, loan_buckets=loan_buckets or {})


def write_days(t: Tables, root: str) -> Tables:
    """Every table as Parquet below ``root``, by day where it has one; returns tables that read from there.

    Rows are rebalanced by day before they are written: adaptive execution puts small days into one
    task and cuts large ones, so the number of files follows the size of the data.  Within
    a file rows are sorted by the column itself, so its row groups can be skipped too.
    ``root`` must be a folder that all executors share."""
    root = root.rstrip("/")
    spark = t.calls.sparkSession
    for name in t.names():
        for k, (column, part, stored) in enumerate(copies(name)):
            df = _dated(t, name, column, part, k == 0)
            if part:
                df = df.hint("rebalance", part).sortWithinPartitions(part, *([LOAN] if column == SNAPSHOT_DAY else [column]))
                df.write.mode("overwrite").partitionBy(part).parquet(f"{root}/{stored}")
            else:
                df.write.mode("overwrite").parquet(f"{root}/{stored}")
    # with the declared schema: an empty table has no file to take it from
    return _opened(t, lambda name, stored, schema: spark.read.schema(schema).parquet(f"{root}/{stored}"))


def buckets_for(t: Tables, rows: int = ROWS_PER_BUCKET) -> int:
    """Buckets that hold about ``rows`` rows each of the snapshot's largest day: a count by day of one column."""
    most = t.bucket_flow.groupBy(SNAPSHOT_DAY).count().agg(F.max("count")).first()[0] or 0
    return max(1, -(-most // rows))


def _dealt(df: DataFrame, part: str | None, buckets: int, rows: int = ROWS_PER_TASK) -> DataFrame:
    """``df`` with every bucket of a day in one task, and about ``rows`` rows at most in a task: it sorts them, and
    what does not fit its memory is written to disk and read again."""
    pieces = -(-df.count() // (buckets * rows)) if part else 1
    if pieces <= 1:
        return df.repartition(buckets, LOAN)
    bucket = F.pmod(F.hash(LOAN), F.lit(buckets))  # as bucketBy numbers them
    return df.repartitionById(buckets * pieces, bucket + buckets * F.pmod(F.coalesce(F.unix_date(part), F.lit(0)), F.lit(pieces)))


def write_buckets(t: Tables, root: str, prefix: str, buckets: int | None = None, names=LOAN_TABLES) -> Tables:
    """The loan-keyed tables ``names`` as catalog tables ``{prefix}_{table}`` below ``root``, by day and by loan; returns tables that read from there.

    All have the same number of buckets (:func:`buckets_for` by default), as only
    equal numbers meet without a shuffle.  Rows are dealt by loan before they are written, so a bucket of a day is
    one file; the days of a bucket go to several tasks where they are many (:func:`_dealt`).  The other tables stay as they are."""
    n = buckets or buckets_for(t)
    for name in names:
        for k, (column, part, stored) in enumerate(copies(name)):
            w = _dealt(_dated(t, name, column, part, k == 0), part, n).write.format("parquet").options(**FILES).mode("overwrite")
            if part:
                w = w.partitionBy(part)
            w.bucketBy(n, LOAN).sortBy(LOAN).option("path", f"{root.rstrip('/')}/{stored}").saveAsTable(f"{prefix}_{stored}")
    return open_buckets(t.calls.sparkSession, prefix, t, n, names)


def open_buckets(spark: SparkSession, prefix: str, t: Tables, buckets: int, names=LOAN_TABLES) -> Tables:
    """``t`` with the loan-keyed tables replaced by the catalog tables that :func:`write_buckets` made."""
    return _opened(t, lambda name, stored, schema: spark.table(f"{prefix}_{stored}") if name in names else None, dict.fromkeys(names, buckets))


def drop_buckets(spark: SparkSession, prefix: str, names=LOAN_TABLES) -> None:
    """Take the tables out of the catalog; their files stay where they are."""
    for name in names:
        for _, _, stored in copies(name):
            spark.sql(f"DROP TABLE IF EXISTS {prefix}_{stored}")

"""Writing report rows: append, idempotent period replace, backup, CSV.

The reference appends a row after a DELETE of the same period (and, in old
versions, without one, which duplicated rows on re-runs).  Here the KPI
table is a Parquet dataset partitioned by the period start and written with
dynamic partition overwrite, so re-running a period replaces exactly that
period's partition and nothing else (deviation D-4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTITION_COL = "period_start"


def _with_partition(df: DataFrame) -> DataFrame:
    return df.withColumn(PARTITION_COL, F.col(df.columns[0]).cast("date"))


def append(df: DataFrame, path: str) -> None:
    """Append rows with the declared schema (no de-duplication)."""
    _with_partition(df).write.mode("append").partitionBy(PARTITION_COL).parquet(path)


def upsert_periods(df: DataFrame, path: str) -> None:
    """Replace the rows of the periods present in ``df``; other periods stay.
    Dynamic partition overwrite is set on the writer, not the session."""
    (_with_partition(df).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION_COL).parquet(path))


def read_table(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(PARTITION_COL)


def backup(spark, path: str, backup_path: str) -> None:
    """``DROP TABLE IF EXISTS x_temp; CREATE TABLE x_temp AS SELECT * FROM x``."""
    spark.read.parquet(path).write.mode("overwrite").parquet(backup_path)


def create_table(df: DataFrame, name: str) -> None:
    """``CREATE TABLE name AS SELECT``: a catalog table; fails if it exists."""
    df.write.format("parquet").mode("errorifexists").saveAsTable(name)


def insert_into(df: DataFrame, name: str) -> None:
    """``INSERT INTO name SELECT``: columns are matched by name, not by place."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header (spreadsheet exports are re-aimed to CSV), as many files as
    the frame has partitions: report rows make one, row-level frames stay distributed."""
    df.write.mode("overwrite").option("header", "true").csv(path)

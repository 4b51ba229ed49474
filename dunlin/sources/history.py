"""KPI history: month-end CSV files and the KPI table, read back newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the month-end history (dates as dd-MM-yyyy text).
MONTHEND_COLUMNS = [
    "WkstartDate", "WkendDate", "apc_wc_connected", "wccalled", "apc_rc_connected", "rccalled",
    "bucket1contacted", "bucketcallcontacted", "bucket1normalized_cnt", "bucket1normalized_denominator",
    "bucket2normalized_denominator", "bucket2normalized_cnt", "ptp_received", "kept_ptp",
    "bucket1ptppmt", "bucket2ptppmt", "FTE", "total_accounts", "active_works",
]
_DOUBLE = {"bucket1ptppmt", "bucket2ptppmt"}

# The published files' headers of two columns, which have to match.
PUBLISHED_HEADERS = {"bucket1normalized_greg": "bucket1normalized_cnt", "bucket2normalized_greg": "bucket2normalized_cnt"}


def monthend_schema() -> T.StructType:
    return T.StructType([
        T.StructField(c, T.StringType() if c in ("WkstartDate", "WkendDate")
                      else T.DoubleType() if c in _DOUBLE else T.LongType())
        for c in MONTHEND_COLUMNS])


# a comma outside quotes
_COMMA = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def scan_monthend_csv(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of month-end history CSV files in any of the three published layouts: 19 columns; 20 with an
    unnamed leading index; 18 with the index and no reminder-call columns.

    One scan of all files as lines, however many they are.  A line that names the period columns is
    its file's header; headers, a line per file, are joined to the lines of their file, which decides each
    file's layout on its own.  Missing columns become NULL; dates stay text (``dd-MM-yyyy``), plus
    parsed ``period_start/period_end``.  A line is rejected, and kept aside with its file
    and reason, if its number of fields is not the header's, a number or a date does not parse, or its file has no header.
    Blank lines are skipped.  A quoted field may hold commas, but no line break."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "[\\r\ufeff]", "").alias("line"))
    lines = lines.filter(F.trim("line") != "").withColumn("fields", F.transform(F.split("line", _COMMA), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', ""))))
    is_header = F.array_contains("fields", "WkstartDate") & F.array_contains("fields", "WkendDate")
    old, new = (F.array(*(F.lit(x) for x in side)) for side in zip(*PUBLISHED_HEADERS.items()))
    ours = lambda x: F.coalesce(F.get(new, F.array_position(old, x).cast("int") - 1), x)
    headers = lines.filter(is_header).groupBy("file").agg(F.first("fields").alias("header"))
    headers = headers.select("file", F.transform("header", ours).alias("header"))
    data = lines.filter(~is_header).join(headers, "file", "left")
    named = F.when(F.size("fields") == F.size("header"), F.col("fields"))
    value = {c: F.nullif(F.get(named, (F.array_position("header", c) - 1).cast("int")), F.lit("")) for c in MONTHEND_COLUMNS}
    # a column with gaps was written as 4667.0: text goes through decimal to BIGINT
    typed = {f.name: value[f.name] if isinstance(f.dataType, T.StringType)
             else value[f.name].try_cast("double") if f.name in _DOUBLE else value[f.name].try_cast("decimal(38,6)").cast(f.dataType) for f in monthend_schema().fields}
    dates = {"period_start": F.to_date(F.try_to_timestamp(value["WkstartDate"], F.lit("dd-MM-yyyy"))),
             "period_end": F.to_date(F.try_to_timestamp(value["WkendDate"], F.lit("dd-MM-yyyy")))}
    unread = [F.when(value[c].isNotNull() & typed[c].isNull(), F.lit(c)) for c in MONTHEND_COLUMNS]
    unread += [F.when(d.isNull(), F.lit(c)) for c, d in dates.items()]
    reason = (F.when(F.col("header").isNull(), "no header")
              .when(named.isNull(), F.concat(F.lit("fields: "), F.size("fields"), F.lit(" of "), F.size("header")))
              .otherwise(F.nullif(F.concat_ws(", ", F.array_compact(F.array(*unread))), F.lit(""))))
    parsed = data.select("file", "line", reason.alias("reason"), *(v.alias(c) for c, v in (typed | dates).items()))
    return (parsed.filter("reason is null").select(*MONTHEND_COLUMNS, *dates), parsed.filter("reason is not null").select("file", "line", "reason"))


def read_monthend_csv(spark: SparkSession, path) -> DataFrame:
    """The good rows of :func:`scan_monthend_csv`; ``path`` is a file, a folder, a pattern or a list of them."""
    return scan_monthend_csv(spark, path if isinstance(path, str) else list(path))[0]


def read_kpi_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """``select * from <kpi table> order by 1 desc``: the KPI table newest first."""
    df = spark.read.format(fmt).load(path)
    return df.orderBy(F.col(df.columns[0]).desc())

"""Long-form KPI trends: the data behind the reference's rate charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rates plotted over time.
TREND_METRICS = [
    "WelcomeCall_ContactRate", "remindercallcontactrate", "bucket1contactrate", "bucket2contactrate",
    "bucket3contactrate", "Bucket1_Normalized", "bucket2Normalizationrate", "bucket3Normalizationrate",
    "recoveryrate", "kept_ptp_rate", "rollback_rate",
]


def kpi_trends(report_rows: DataFrame, metrics=TREND_METRICS) -> DataFrame:
    """(WkstartDate, WkendDate, metric, value) rows from wide report rows."""
    present = [m for m in metrics if m in report_rows.columns]
    return report_rows.unpivot(["WkstartDate", "WkendDate"], present, "metric", "value")

"""Column helpers shared by the KPI operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phone10(c) -> Column:
    """Phone join key: last 10 characters (shorter strings returned whole).
    ``SUBSTR(x, -10)`` and ``RIGHT(x, 10)`` agree, including short strings."""
    return F.right(_c(c).cast("string"), F.lit(10))


def flag(c) -> Column:
    """Null-defaulted 0/1 flag: ``COALESCE(flag, 0)``."""
    return F.coalesce(_c(c), F.lit(0))


def dpd0(c) -> Column:
    """Days past due with NULL meaning 0."""
    return F.coalesce(_c(c), F.lit(0))


def safe_div(num, den) -> Column:
    """Ratio as DOUBLE; zero or NULL denominator gives NULL (deviation D-1:
    pandas would give inf/NaN, the warehouse an error)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def amount(c) -> Column:
    """Emit a decimal sum as DOUBLE (the report's FLOAT64 columns)."""
    return _c(c).cast("double")


# 9-way DPD bins of the recovery report (upper bound inclusive,
# label, number).  The first bin takes everything <= 0, the last everything > 360.
DPD_BINS = [
    (0, "B. Not Delinquent", 0),
    (30, "C. 1-30DPD", 1),
    (60, "D. 31-60DPD", 2),
    (90, "E. 61-90DPD", 3),
    (120, "F. 91-120DPD", 4),
    (150, "G. 121-150DPD", 5),
    (180, "H. 151-180DPD", 6),
    (360, "I. 181-360DPD", 7),
    (None, "J. >360DPD", 8),
]

# Legacy 5-way bins of the transition scripts.  Exactly 0, 1-30,
# 31-60, 61-90; anything else (including negative DPD) is "Over 90 DPD".
LEGACY_BINS = [
    ("Not Delinquent", 0),
    ("a. Bucket 1", 1),
    ("b Bucket 2", 2),
    ("c Bucket 3", 3),
    ("Over 90 DPD", 90),
]


def _bin(c, pick: int) -> Column:
    d = dpd0(c)
    expr = None
    for hi, label, num in DPD_BINS:
        val = F.lit(label if pick == 0 else num)
        if hi is None:
            expr = expr.otherwise(val)
        else:
            expr = F.when(d <= hi, val) if expr is None else expr.when(d <= hi, val)
    return expr


def dpd_bucket_label(c) -> Column:
    return _bin(c, 0)


def dpd_bucket(c) -> Column:
    return _bin(c, 1).cast("int")


def _legacy(c, pick: int) -> Column:
    d = dpd0(c)
    edges = [(d == 0), d.between(1, 30), d.between(31, 60), d.between(61, 90)]
    vals = [lbl if pick == 0 else num for lbl, num in LEGACY_BINS]
    expr = F.when(edges[0], F.lit(vals[0]))
    for cond, v in zip(edges[1:], vals[1:4]):
        expr = expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(vals[4]))


def legacy_bucket_label(c) -> Column:
    return _legacy(c, 0)


def legacy_bucket(c) -> Column:
    return _legacy(c, 1).cast("int")


def dd_mm_yyyy(c) -> Column:
    """Month-end history date format (``%d-%m-%Y``)."""
    return F.date_format(_c(c), "dd-MM-yyyy")


def parse_dd_mm_yyyy(c) -> Column:
    return F.to_date(_c(c), "dd-MM-yyyy")

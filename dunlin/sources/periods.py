"""Reporting periods: the ``dt(WkstartDate, WkendDate)`` parameter row, generalised
to N rows.

Every KPI operator takes a :class:`Periods` and returns one row per period (or
per period and bucket), keyed by ``WkstartDate, WkendDate``.  The period list
lives on the driver, so the size of both the period frame (N rows) and the day
calendar (sum of period lengths) is known before the plan runs; that known
bound is what lets us broadcast them (see :func:`Periods.calendar`).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PS = "WkstartDate"
PE = "WkendDate"
AS_OF = "as_of"
KEY = [PS, PE]

# A calendar of up to this many (period, day) rows is broadcast; beyond it the
# range join falls back to a shuffled equi-join on the day key.
BROADCAST_CALENDAR_ROWS = 2_000_000


def _date(x) -> _dt.date:
    if isinstance(x, _dt.datetime):
        return x.date()
    if isinstance(x, _dt.date):
        return x
    return _dt.date.fromisoformat(str(x))


@dataclass(frozen=True)
class Periods:
    """Ordered list of ``(start, end, as_of)`` triples (inclusive dates)."""

    spans: tuple[tuple[_dt.date, _dt.date, _dt.date], ...]

    @classmethod
    def of(cls, *spans, as_of=None) -> "Periods":
        """``Periods.of(("2024-01-08", "2024-01-14"), ...)``.  ``as_of`` replaces
        the reference's ``current_date()`` (deviation D-2); default = period end."""
        out = []
        for sp in spans:
            s, e = _date(sp[0]), _date(sp[1])
            a = _date(sp[2]) if len(sp) > 2 and sp[2] is not None else (
                _date(as_of) if as_of is not None else e)
            out.append((s, e, a))
        if not out:
            raise ValueError("at least one period is required")
        return cls(tuple(out))

    def __len__(self) -> int:
        return len(self.spans)

    @property
    def lo(self) -> _dt.date:
        return min(s for s, _, _ in self.spans)

    @property
    def hi(self) -> _dt.date:
        return max(e for _, e, _ in self.spans)

    @property
    def n_days(self) -> int:
        return sum(max(0, (e - s).days + 1) for s, e, _ in self.spans)

    def _values_sql(self) -> str:
        rows = ", ".join(f"(DATE'{s}', DATE'{e}', DATE'{a}')" for s, e, a in self.spans)
        return f"SELECT * FROM VALUES {rows} AS p({PS}, {PE}, {AS_OF})"

    def frame(self, spark: SparkSession) -> DataFrame:
        """N-row period frame (a local relation, broadcast: N is the length of
        a driver-side list)."""
        return F.broadcast(spark.sql(self._values_sql()))

    def calendar(self, spark: SparkSession) -> DataFrame:
        """One row per (period, day in period): turns ``date(x) BETWEEN start AND
        end`` into an equi-join on ``day``.  An inverted period yields no days."""
        cal = spark.sql(
            f"SELECT {PS}, {PE}, {AS_OF}, explode(sequence({PS}, {PE}, INTERVAL 1 DAY)) AS day "
            f"FROM ({self._values_sql()}) WHERE {PS} <= {PE}")
        return F.broadcast(cal) if self.n_days <= BROADCAST_CALENDAR_ROWS else cal

    # ---- pushdown helpers: literal bounds of the whole list --------------
    def ts_bounds(self, col: str):
        """``col`` within [lo, hi] days, as a half-open range on the raw
        timestamp so Parquet min/max statistics can skip row groups."""
        # string literals cast in the session time zone, like the columns
        # they are compared with (constant-folded, so still pushed down)
        lo = F.lit(f"{self.lo} 00:00:00").cast("timestamp")
        hi = F.lit(f"{self.hi + _dt.timedelta(days=1)} 00:00:00").cast("timestamp")
        return (F.col(col) >= lo) & (F.col(col) < hi)

    def date_bounds(self, col: str, slack: int = 0):
        """``col`` within [lo, hi], or ``slack`` days around it."""
        more = _dt.timedelta(days=slack)
        return F.col(col).between(F.lit(self.lo - more), F.lit(self.hi + more))


# ---- self-dating sources --------------------------------

def _dow_sun1(d: _dt.date) -> int:
    """Day of week with Sunday = 1 .. Saturday = 7 (the warehouse's EXTRACT)."""
    return d.isoweekday() % 7 + 1


def weekly(as_of, week_end: str = "SUN") -> Periods:
    """Previous complete week relative to ``as_of``.

    ``SUN``: Monday..Sunday, start = as_of - (dow + 5), end = as_of - (dow - 1).
    ``SAT``: Sunday..Saturday, start = as_of - (dow + 6), end = as_of - dow.
    """
    a = _date(as_of)
    dow = _dow_sun1(a)
    if week_end.upper() == "SUN":
        s, e = a - _dt.timedelta(days=dow + 5), a - _dt.timedelta(days=dow - 1)
    elif week_end.upper() == "SAT":
        s, e = a - _dt.timedelta(days=dow + 6), a - _dt.timedelta(days=dow)
    else:
        raise ValueError(week_end)
    return Periods.of((s, e, a))


def current_week(as_of) -> Periods:
    """Monday of the week of ``as_of`` .. the Sunday that opens the Sunday-based week one
    week later (``WEEK(MONDAY)`` truncation of today, ``WEEK(SUNDAY)`` truncation of today + 7 days)."""
    a = _date(as_of)
    later = a + _dt.timedelta(days=7)
    return Periods.of((a - _dt.timedelta(days=a.weekday()), later - _dt.timedelta(days=_dow_sun1(later) - 1), a))


def month_to_date(as_of) -> Periods:
    """Month start .. last Sunday on or before ``as_of`` (end = as_of + 1 - dow).
    Early in a month the end precedes the start: an empty period, as in the
    reference."""
    a = _date(as_of)
    s = a.replace(day=1)
    e = a + _dt.timedelta(days=1 - _dow_sun1(a))
    return Periods.of((s, e, a))


def year_to_date(as_of, start="2023-01-01") -> Periods:
    a = _date(as_of)
    return Periods.of((_date(start), a, a))


def weeks_between(first_monday, n: int, as_of=None) -> Periods:
    """``n`` consecutive Monday..Sunday weeks starting at ``first_monday``."""
    s0 = _date(first_monday)
    spans = [(s0 + _dt.timedelta(days=7 * i), s0 + _dt.timedelta(days=7 * i + 6)) for i in range(n)]
    return Periods.of(*spans, as_of=as_of)

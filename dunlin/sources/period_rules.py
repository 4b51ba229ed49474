"""Reporting periods as a relation: computed in the plan from a column of as-of days.

:mod:`dunlin.sources.periods` makes a few periods on the driver.  Here every day of a
table can be an as-of day: each rule's period is made with built-in date functions, and the KPIs of all
of them come from one pass.  Day of week counts from Sunday = 1.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .periods import AS_OF, PE, PS

RULE = "rule"


def _dow(d: Column) -> Column:
    return F.dayofweek(d)


def _rules(year_start: _dt.date) -> dict:
    """Rule -> (first day, last day) of the as-of day."""
    later = lambda d: F.date_add(d, 7)
    return {
        # the last complete Monday..Sunday and Sunday..Saturday weeks
        "week_to_sunday": lambda d: (F.date_sub(d, _dow(d) + 5), F.date_sub(d, _dow(d) - 1)),
        "week_to_saturday": lambda d: (F.date_sub(d, _dow(d) + 6), F.date_sub(d, _dow(d))),
        # Monday of this week to the Sunday that opens the Sunday-based week a week later
        "current_week": lambda d: (F.trunc(d, "WEEK"), F.date_sub(later(d), _dow(later(d)) - 1)),
        # the month's first day to the last Sunday; empty early in a month
        "month_to_sunday": lambda d: (F.trunc(d, "MM"), F.date_add(d, 1 - _dow(d))),
        "year_to_date": lambda d: (F.lit(year_start), d),
        "day_before": lambda d: (F.date_sub(d, 1), F.date_sub(d, 1)),
    }


def period_relation(days: DataFrame, column: str = AS_OF, rules=None, year_start=_dt.date(2023, 1, 1)) -> DataFrame:
    """(as_of, rule, WkstartDate, WkendDate) of every distinct, non-null day of ``column`` and every rule
    (all by default).  A period whose end precedes its start is kept: it is empty, as in the reference."""
    made = _rules(year_start)
    rules = list(made) if rules is None else list(rules)
    d = F.col(AS_OF)
    one = days.select(F.to_date(column).alias(AS_OF)).filter(d.isNotNull()).distinct()
    spans = F.array(*(F.struct(F.lit(r).alias(RULE), made[r](d)[0].alias(PS), made[r](d)[1].alias(PE)) for r in rules))
    return one.select(AS_OF, F.explode(spans).alias("p")).select(AS_OF, "p.*")


def distinct_in_periods(events: DataFrame, day: str, value: str, periods: DataFrame, name: str) -> DataFrame:
    """``periods`` with ``name`` = the number of distinct ``value`` s of ``events`` on the days of each period (0 if none).

    Events are reduced to one row per (day, value) first, and to one list of values per day; periods that share their days share
    the work.  The periods' days are joined by equality: a row per (period, day), never per (period, event).
    Meant for values that are few on a day (agents, campaigns); a day's list is one row."""
    per_day = events.filter(F.col(day).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(day).alias("_day")).agg(F.collect_set(value).alias("_values"))
    spans = periods.select(PS, PE).distinct()
    days = spans.filter(F.col(PS) <= F.col(PE)).select(PS, PE, F.explode(F.sequence(PS, PE)).alias("_day"))
    counted = days.join(per_day, "_day").select(PS, PE, F.explode("_values").alias("_value")).groupBy(PS, PE).agg(F.countDistinct("_value").alias(name))
    return periods.join(counted, [PS, PE], "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long")).select(*periods.columns, name)

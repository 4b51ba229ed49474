"""Declared schemas and their generations; published tables; margins; periods in the plan; tolerant CSV."""

import datetime as dt
import glob

import pytest

from dunlin.plans import declared, published, ytd
from dunlin.sources import history, period_rules, periods as PD

D = dt.date
ROW = "WkstartDate date, WkendDate date, n long, rate double"


def week(k, n=1, rate=0.5):
    return (D(2024, 1, 1) + dt.timedelta(7 * k), D(2024, 1, 7) + dt.timedelta(7 * k), n, rate)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- declared schemas ----

def test_appends_are_checked(spark, scratch):
    t = declared.DeclaredTable.create(spark, scratch, spark.createDataFrame([], ROW).schema)
    t.append(spark.createDataFrame([week(0)], ROW))
    t.append(spark.createDataFrame([week(1)], ROW).select("rate", "n", "WkendDate", "WkstartDate"))  # by name
    assert rows(t.read()) == [week(0), week(1)]
    for sql, text in (("n long, rate double, WkstartDate date, WkendDate string", "WkendDate: type"), ("WkstartDate date, WkendDate date, n long", "rate: missing"),
                      (ROW + ", x int", "x: extra"), ("WkstartDate date, WkendDate date, n int, rate double", "n: type")):
        with pytest.raises(declared.SchemaMismatch, match=text):
            t.append(spark.createDataFrame([], sql))
    with pytest.raises(declared.SchemaMismatch, match="n: type"):
        t.append(spark.createDataFrame([], "WkstartDate date, WkendDate date, n string, rate double"), evolve=True)
    assert rows(t.read()) == [week(0), week(1)] and len(t.generations()) == 1


def test_generations_read_together(spark, scratch):
    t = declared.DeclaredTable.create(spark, scratch, spark.createDataFrame([], ROW).schema)
    assert t.read().count() == 0
    t.append(spark.createDataFrame([week(0)], ROW))
    new = spark.createDataFrame([(*week(1)[:3], "a", 7)], "WkstartDate date, WkendDate date, n long, note string, more int")
    assert rows(t.difference(new)) == [(3, "rate", "missing", "double", None), (4, "note", "extra", None, "string"), (5, "more", "extra", None, "int")]
    t.append(new, evolve=True)
    t.append(spark.createDataFrame([week(2)], ROW), evolve=True)
    assert t.read().columns == ["WkstartDate", "WkendDate", "n", "rate", "note", "more"]
    assert rows(t.read()) == sorted([(*week(0), None, None), (*week(1)[:3], None, "a", 7), (*week(2), None, None)], key=str)
    assert rows(t.read(1)) == sorted([week(0), (*week(1)[:3], None), week(2)], key=str)
    assert [g for g, _ in t.generations()] == [1, 2]
    assert rows(declared.column_use(t.read()))[-1] == ("rate", 3, 2)
    with pytest.raises(Exception, match="(?i)exists"):
        declared.DeclaredTable.create(spark, scratch, new.schema)


# ---- published tables ----

def table(spark, scratch):
    return published.PublishedTable(spark, scratch, spark.createDataFrame([], ROW).schema, ["WkstartDate", "WkendDate"])


def test_a_failed_audit_leaves_the_old_rows(spark, scratch):
    t = table(spark, scratch)
    mk = lambda *w: spark.createDataFrame(list(w), ROW)
    assert t.read().count() == 0 and t.replace(mk(week(0), week(1))) == 1
    no_end = (week(2)[0], None, 1, 0.1)
    for bad, why in ((mk(week(1, 5), week(1, 6)), "one_row_per_period: 1"), (mk(week(1, 5), no_end), "key_not_null: 1"), (mk(), "some_rows"), (mk((None, *week(3)[1:])), "key_not_null")):
        with pytest.raises(published.AuditFailed, match=why):
            t.replace(bad)
        assert rows(t.read()) == [week(0), week(1)]
    assert t.replace(mk(week(1, 9), week(2))) == 2
    assert rows(t.read()) == sorted([week(0), week(1, 9), week(2)], key=str)
    assert rows(t.read(1)) == [week(0), week(1)]


def test_staged_rows_are_invisible_and_backups_restore(spark, scratch):
    t = table(spark, scratch)
    mk = lambda *w: spark.createDataFrame(list(w), ROW)
    t.replace(mk(week(0), week(1)))
    reader = t.read()
    version = t.stage(mk(week(0, 77)))
    assert rows(t.read()) == [week(0), week(1)]
    t.publish(version)
    assert rows(t.read()) == [week(0, 77), week(1)] and rows(reader) == [week(0), week(1)]
    assert t.restore(1) == 3 and rows(t.read()) == [week(0), week(1)]
    with pytest.raises(ValueError):
        t.restore(99)
    with pytest.raises(Exception, match="(?i)exists"):
        t._point(3, t.at(1))  # the number is taken
    assert all(len(glob.glob(f"{m}/part-*")) == 1 for m in glob.glob(f"{scratch}/manifest/*"))


def test_only_published_versions_are_scanned(spark, scratch):
    t = table(spark, scratch)
    for n in range(3):
        t.replace(spark.createDataFrame([week(0, n), week(1, n)], ROW))
    df = t.read()
    assert rows(df) == [week(0, 2), week(1, 2)]
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString().lower()


# ---- margins ----

def test_margins_come_from_one_aggregate(spark):
    cols = "period_start date, period_end date, " + ", ".join(f"{c} {'double' if 'ppmt' in c else 'long'}" for c in ytd._SUMS)
    mk = lambda d, n: (d, d, *[n] * 12, n + 0.25, None)
    df = spark.createDataFrame([mk(D(2023, 12, 1), 1), mk(D(2024, 1, 1), 2), mk(D(2024, 1, 8), 3), mk(D(2024, 2, 1), 4)], cols)
    got = {(r.year, r.month): (r.n_periods, r.wccalled, r.bucket1ptppmt, r.bucket2ptppmt) for r in ytd.margins_by_month(df).collect()}
    assert got == {("2023", "12"): (1, 1, 1.25, 0), ("2024", "1"): (2, 5, 5.5, 0), ("2024", "2"): (1, 4, 4.25, 0),
                   ("2023", "Total"): (1, 1, 1.25, 0), ("2024", "Total"): (3, 9, 9.75, 0), ("Total", "Total"): (4, 10, 11.0, 0)}
    table = {(r.StartDate, r.EndDate): r.wccalled for r in ytd.monthend_table(df).collect()}
    assert table == {("01-12-2023", "01-12-2023"): 1, ("01-01-2024", "01-01-2024"): 2, ("08-01-2024", "08-01-2024"): 3, ("01-02-2024", "01-02-2024"): 4, ("Total", ""): 10}
    for made in (ytd.margins_by_month(df), ytd.monthend_table(df)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Aggregate [") == 1 and plan.count("Expand") == 1
    assert ytd.monthend_table(df.limit(0)).count() == 0


# ---- periods in the plan ----

def test_rules_equal_the_drivers(spark):
    days = [D(2023, 12, 20) + dt.timedelta(k) for k in range(420)]
    df = spark.createDataFrame([(d,) for d in days] + [(days[0],), (None,)], "as_of date")
    got = {(r.as_of, r.rule): (r.WkstartDate, r.WkendDate) for r in period_rules.period_relation(df).collect()}
    driver = {"week_to_sunday": PD.weekly, "week_to_saturday": lambda d: PD.weekly(d, "SAT"), "current_week": PD.current_week, "month_to_sunday": PD.month_to_date,
              "year_to_date": PD.year_to_date, "day_before": lambda d: PD.Periods.of((d - dt.timedelta(1), d - dt.timedelta(1)))}
    assert got == {(d, r): f(d).spans[0][:2] for d in days for r, f in driver.items()}


def test_distinct_values_of_many_periods(spark):
    events = spark.createDataFrame([(D(2024, 1, 1), "a"), (D(2024, 1, 1), "a"), (D(2024, 1, 2), "b"), (D(2024, 1, 2), None), (None, "c")], "day date, who string")
    periods = spark.createDataFrame([("x", D(2024, 1, 1), D(2024, 1, 2)), ("y", D(2024, 1, 2), D(2024, 1, 1)), ("z", D(2024, 1, 2), D(2024, 1, 9)), ("x2", D(2024, 1, 1), D(2024, 1, 2))],
                                    "k string, WkstartDate date, WkendDate date")
    got = {r.k: r.n for r in period_rules.distinct_in_periods(events, "day", "who", periods, "n").collect()}
    assert got == {"x": 2, "x2": 2, "y": 0, "z": 1}


# ---- tolerant CSV ----

def test_a_thousand_files_in_one_scan(spark, scratch):
    cols = history.MONTHEND_COLUMNS
    for k in range(1000):
        d = (D(2020, 1, 1) + dt.timedelta(k)).strftime("%d-%m-%Y")
        names = cols if k % 2 else [c for c in cols if c not in ("apc_rc_connected", "rccalled")]
        with open(f"{scratch}/{k:04d}.csv", "w") as f:
            f.write(",".join(([""] if k % 3 == 0 else []) + names) + "\n")
            f.write(",".join((["0"] if k % 3 == 0 else []) + [d, d] + [str(k)] * (len(names) - 2)) + "\n")
    good, bad = history.scan_monthend_csv(spark, scratch)
    got = {r.period_start: (r.wccalled, r.rccalled, r.FTE) for r in good.collect()}
    assert got == {D(2020, 1, 1) + dt.timedelta(k): (k, k if k % 2 else None, k) for k in range(1000)} and bad.count() == 0
    scans = [x for x in good._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in x]
    assert len(scans) <= 2  # lines, and their headers


def test_broken_lines_are_reported(spark, scratch):
    with open(f"{scratch}/a.csv", "w") as f:
        f.write('﻿WkstartDate,WkendDate,wccalled,bucket1ptppmt\r\n"01-01-2024",31-01-2024,"12",3.5\r\n\r\n01-02-2024,29-02-2024,x,1\n01-02-2024,29-02-2024,1\n'
                '31-31-2024,29-02-2024,1,1\n01-03-2024,31-03-2024,,\n,,1,1\n')
    with open(f"{scratch}/b.csv", "w") as f:
        f.write("01-01-2024,31-01-2024,5,5\n")
    good, bad = history.scan_monthend_csv(spark, scratch)
    assert sorted((r.WkstartDate, r.wccalled, r.bucket1ptppmt) for r in good.collect()) == [("01-01-2024", 12, 3.5), ("01-03-2024", None, None)]
    assert sorted((r.file[-5:], r.line, r.reason) for r in bad.collect()) == [
        ("a.csv", ",,1,1", "period_start, period_end"), ("a.csv", "01-02-2024,29-02-2024,1", "fields: 3 of 4"), ("a.csv", "01-02-2024,29-02-2024,x,1", "wccalled"),
        ("a.csv", "31-31-2024,29-02-2024,1,1", "period_start"), ("b.csv", "01-01-2024,31-01-2024,5,5", "no header")]

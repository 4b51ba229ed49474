"""Hot phone numbers without adaptive execution; scalar lookups that match at most once."""

import datetime as dt
from statistics import median

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dunlin.operators import contact, migration, ptp, skew
from dunlin.operators.common import scalar_lookup
from dunlin.sources.derived import from_testdata
from dunlin.sources.periods import Periods
from tests.fixtures import TS, call, contact as active_number, loan, make_tables, snap

D = dt.date
WEEK = Periods.of(("2024-01-08", "2024-01-14"))
SF = "/root/testdata/sf0.001"


@pytest.fixture()
def no_adaptive(spark):
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def hot_tables(spark, n=6000):
    number = lambda k: f"63{0 if k % 3 == 0 else k:010d}"  # noqa: E731  one number on a third of all rows
    return make_tables(
        spark,
        loans=[loan(str(k), k, number(k)) for k in range(n // 4)],
        calls=[call(f"C{k}", TS(2024, 1, 8 + k % 7, k % 24), number(k % 1500), campaign=("SIGNUP", "VIEW", "CLICK", "ERROR")[k % 4], apc=k % 2) for k in range(n)]
        + [call(f"N{k}", TS(2024, 1, 9), None) for k in range(50)],
        contacts=[active_number(k, number(k)) for k in range(n // 4)],
        snapshot=[snap(str(k), D(2024, 1, 8), 1 + k % 90) for k in range(n // 4)] + [snap(str(k), D(2024, 1, 14), k % 40) for k in range(n // 4)])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tasks(df) -> list[int]:
    """Rows of each partition that has any."""
    return [r.n for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max(df.columns[-1])).collect()]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_a_number_on_a_third_of_the_rows_fills_no_task(spark, no_adaptive, how):
    t = hot_tables(spark)
    legs = t.calls.withColumn("ph", F.right("mobile", F.lit(10)))
    few = t.loan_master.select(F.right("mobile_no", F.lit(10)).alias("ph")).distinct()
    if how != "left_semi":
        few = few.withColumn("x", F.length("ph"))
    plain, split = legs.join(few, "ph", how), skew.split_join(legs, few, ["ph"], how)
    assert rows(split) == rows(plain) and split.columns == plain.columns
    # partitions of the join itself: the join keeps the rows where it read them
    assert max(tasks(plain)) > 3 * median(tasks(plain))
    assert max(tasks(split)) <= 4 * median(tasks(split)) and max(tasks(split)) < max(tasks(plain))


def test_kpis_on_hot_numbers(spark, no_adaptive):
    t = hot_tables(spark, 2000)
    for fn in (lambda t: contact.contact_rates(t, WEEK), lambda t: contact.welcome_call_contact_rate(t, WEEK), lambda t: contact.bucket_contact_rate(t, WEEK, 1),
               lambda t: migration.called_customers_loans(t, WEEK), lambda t: migration.bucket_transitions(t, WEEK, 1)):
        assert rows(fn(t.splitting())) == rows(fn(t))


def test_hot_keys_are_few(spark):
    df = spark.createDataFrame([("a",)] * 500 + [(f"k{i}",) for i in range(1000)] + [(None,)] * 900, "k string")
    hot = skew.hot_keys(df.filter("k is not null"), ["k"]).collect()
    assert [r.k for r in hot] == ["a"] and hot[0]._pieces == -(-500 * 8 * skew.PIECES // 1500)


def test_empty_and_one_row(spark):
    none = spark.createDataFrame([], "k string, v int")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    few = spark.createDataFrame([("a", 2)], "k string, w int")
    assert skew.split_join(none, few, ["k"]).count() == 0
    assert rows(skew.split_join(one, few, ["k"])) == [("a", 1, 2)]
    assert rows(skew.split_join(one, few.limit(0), ["k"], "left")) == [("a", 1, None)]
    with pytest.raises(ValueError):
        skew.split_join(one, few, ["k"], "full")


def promises(spark, snapshot):
    row = ("1", 630000000001, TS(2024, 1, 9), D(2024, 1, 12), 1, None)
    return make_tables(spark, ptp=[row, ("2", *row[1:]), (None, *row[1:])], snapshot=snapshot)


def test_a_second_snapshot_row_of_a_promise_is_an_error(spark):
    good = promises(spark, [snap("1", D(2024, 1, 9), 7), snap("3", D(2024, 1, 9), 1), snap("3", D(2024, 1, 9), 1), snap(None, D(2024, 1, 9), 1), snap(None, D(2024, 1, 9), 1)])
    assert sorted((str(r.loan_account), r.dpd) for r in ptp.ptp_with_dpd(good, WEEK).collect()) == [("1", 7), ("2", None), ("None", None)]
    for twice in (7, 8):
        bad = promises(spark, [snap("1", D(2024, 1, 9), 7), snap("1", D(2024, 1, 9), twice)])
        with pytest.raises(PySparkException, match="more than one snapshot row for .*2024-01-09"):
            ptp.ptp_with_dpd(bad, WEEK).collect()


def test_the_check_costs_no_shuffle(spark, no_adaptive):
    t = from_testdata(spark, SF)
    p, snapshot = t.ptp.select("loan_account", F.to_date("contact_date").alias("day")), t.bucket_flow.select("loan_account", F.col("bucket_date").alias("day"), "max_dpd")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    checked = scalar_lookup(p, snapshot, ["loan_account", "day"], "max_dpd", "dpd", "row")
    plain = p.filter("loan_account is not null and day is not null").join(snapshot, ["loan_account", "day"], "left")
    assert plan(checked).count("Exchange hashpartitioning") == plan(plain).count("Exchange hashpartitioning")

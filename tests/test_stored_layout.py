"""Tables stored by day and by loan: pruned scans, joins without a shuffle, files that follow the data, equal rows."""

import functools
import glob
import re
import uuid

import pytest
from pyspark.sql import DataFrame
from pyspark.sql.functions import count, spark_partition_id

from dunlin.operators import contact, migration, ptp, recovery
from dunlin.sources import stored
from dunlin.sources.derived import from_testdata
from dunlin.sources.periods import Periods
from dunlin.sources.tables import scratch_path

SF = "/root/testdata/sf0.001"
WEEK = Periods.of(("2024-01-08", "2024-01-14"))
WEEKS = Periods.of(("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"))


@pytest.fixture(scope="module")
def plain(spark):
    return from_testdata(spark, SF)


@pytest.fixture(scope="module")
def by_day(spark, plain):
    return plain.materialize(scratch_path(spark, "days"))


@pytest.fixture(scope="module")
def by_loan(spark, plain):
    prefix = f"t{uuid.uuid4().hex[:10]}"
    yield stored.write_buckets(plain, scratch_path(spark, "buckets"), prefix, buckets=3)
    stored.drop_buckets(spark, prefix)


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def tree(df) -> list[tuple[int, str]]:
    """(depth, operator) of the physical plan before it runs."""
    text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    out = []
    for line in text.splitlines():
        name = re.search(r"[A-Za-z]", line)
        if name:
            out.append((name.start(), line[name.start():]))
    return out


def below(df, operator: str) -> list[list[str]]:
    """The operators under each occurrence of ``operator``."""
    t = tree(df)
    out = []
    for k, (depth, text) in enumerate(t):
        if text.startswith(operator):
            under = []
            for d, x in t[k + 1:]:
                if d <= depth:
                    break
                under.append(x)
            out.append(under)
    return out


def shuffles(ops: list[str]) -> list[str]:
    return [x for x in ops if x.startswith("Exchange")]


@pytest.mark.parametrize("kpi,periods", [("bucket_normalization", WEEK), ("bucket_normalization", WEEKS), ("recovery_wide", WEEK), ("recovery_wide", WEEKS)])
def test_joins_by_loan_shuffle_nothing(plain, by_loan, no_broadcast, kpi, periods):
    fn = {"bucket_normalization": lambda t: migration.bucket_normalization(t, periods, 1), "recovery_wide": lambda t: recovery.recovery_wide(t, periods)}[kpi]
    ops = [x for _, x in tree(fn(by_loan))]
    # what is shuffled are the sums by period, above the aggregations and joins by loan
    assert shuffles(ops) and not any("loan_account" in x for x in shuffles(ops))
    assert all(not shuffles(j) for kind in ("SortMergeJoin", "ShuffledHashJoin") for j in below(fn(by_loan), kind))
    per_loan = [x for x in ops if x.startswith("HashAggregate(keys=[Wk") and "loan_account" in x.split("functions=")[0]]
    assert per_loan and sum("FileScan" in x and "Bucketed: true" in x for x in ops) >= 1
    assert any("loan_account" in x for x in shuffles([x for _, x in tree(fn(plain))]))
    assert rows(fn(by_loan)) == rows(fn(plain))


def test_a_normalisation_reads_both_days_in_one_scan(plain):
    ops = [x for _, x in tree(migration.bucket_normalization(plain, WEEKS, 1))]
    assert sum("FileScan" in x for x in ops) == 1 and sum("Join" in x.split("[")[0] for x in ops) == 1 and len(shuffles(ops)) == 2


def test_transitions_move_only_the_called_loans(plain, by_loan, no_broadcast):
    df = migration.bucket_transitions(by_loan, WEEKS, 1)
    # the join with the called loans shuffles them, to the snapshot's buckets
    outer = max((j for j in below(df, "SortMergeJoin") if any("max_dpd" in x for x in j)), key=len)
    moved = [x for x in shuffles(outer) if "loan_account" in x]
    assert moved and all("hashpartitioning(loan_account" in x and ", 3)" in x for x in moved)
    # one shuffle by loan, of the called side; the snapshot's side comes first and ends at its scan
    assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
    side = outer[: next(k for k, x in enumerate(outer) if "FileScan" in x) + 1]
    assert "max_dpd" in side[-1] and not shuffles(side)
    assert rows(df) == rows(migration.bucket_transitions(plain, WEEKS, 1))


def scans(df, column: str) -> list[str]:
    """Full texts of the file scans that read ``column``."""
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [x for x in map(str.strip, text.split("\n\n")) if "Scan parquet" in x[:40] and column in x]


def part_filters(scan: str) -> str:
    return next((x for x in scan.splitlines() if x.startswith("PartitionFilters")), "")


def test_scans_open_only_the_days_they_need(by_day):
    calls = scans(contact.bucket_contact_rate(by_day, WEEK, 1), "call_id")
    assert calls and all("2024-01-07" in part_filters(s) and "2024-01-15" in part_filters(s) and "day" in part_filters(s) for s in calls)
    paid = scans(recovery.recovery_wide(by_day, WEEK), "is_cur_delinq")
    assert paid and all("2024-01-08" in part_filters(s) and "2024-01-14" in part_filters(s) for s in paid)
    due = scans(migration.rollback(by_day, WEEK), "is_cur_delinq")
    assert due and all("2024-01-08" in part_filters(s) for s in due)
    promises = scans(ptp.ptp_payments_by_bucket(by_day, WEEK), "contact_date")
    assert promises and all("2024-01-07" in part_filters(s) for s in promises)
    assert all("2024-01-08" in part_filters(s) for s in scans(ptp.ptp_with_dpd(by_day, WEEK), "max_dpd"))


@pytest.mark.parametrize("fn", [lambda t: contact.contact_rates(t, WEEKS), lambda t: recovery.recovery_by_bucket(t, WEEKS), lambda t: migration.rollback(t, WEEKS),
                                lambda t: ptp.ptp_payments_by_bucket(t, WEEKS), lambda t: ptp.ptp_with_dpd(t, WEEK), lambda t: migration.called_customers_loans(t, WEEK)])
def test_stored_rows_give_equal_results(plain, by_day, fn):
    assert rows(fn(by_day)) == rows(fn(plain))


def test_a_writer_in_another_time_zone(spark, plain, scratch):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Manila")
    try:
        t = plain.materialize(scratch)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert rows(contact.contact_rates(t, WEEK)) == rows(contact.contact_rates(plain, WEEK))


def test_files_follow_the_size_of_the_data(spark, plain, scratch):
    parts = [plain.bucket_flow.filter(f"pmod(hash(loan_account), 8) = {k}") for k in range(8)]  # eight tasks write
    t = plain.with_(bucket_flow=functools.reduce(DataFrame.unionByName, parts))
    t.materialize(f"{scratch}/small")
    assert len(glob.glob(f"{scratch}/small/bucket_flow/*/*.parquet")) == 31
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        t.materialize(f"{scratch}/large")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(glob.glob(f"{scratch}/large/bucket_flow/*/*.parquet")) > 62


def test_buckets_follow_the_size_of_the_data(plain):
    day = plain.bucket_flow.filter("bucket_date = '2024-01-08'").count()
    assert stored.buckets_for(plain) == 1 and stored.buckets_for(plain, rows=day // 4 + 1) == 4


def test_a_task_writes_a_bounded_number_of_rows(spark, plain, scratch):
    flow = plain.bucket_flow.withColumn("day", plain.bucket_flow["bucket_date"])
    dealt = stored._dealt(flow, "day", 2, rows=flow.count() // 12 + 1)
    # six pieces of a bucket's days, every bucket of a day in one of them, none much larger than a sixth
    sizes = [r["n"] for r in dealt.groupBy(spark_partition_id().alias("p")).agg(count("*").alias("n")).collect()]
    assert len(sizes) == 12 and max(sizes) < 1.3 * sum(sizes) / 12
    dealt.write.partitionBy("day").bucketBy(2, "loan_account").sortBy("loan_account").option("path", f"{scratch}/flow").saveAsTable(f"t{uuid.uuid4().hex[:10]}")
    assert len(glob.glob(f"{scratch}/flow/*/*.parquet")) == 62
    assert stored._dealt(flow, "day", 2, rows=flow.count()).rdd.getNumPartitions() == 2


def test_payments_are_stored_by_their_day(by_day, plain):
    by_pay = by_day.by_day["installments", "last_payment_date"]
    assert by_pay.count() == plain.installments.filter("last_payment_date is not null").count()
    assert by_pay.filter("day <> last_payment_date").count() == 0
    changed = by_day.with_(installments=plain.installments.limit(0))
    assert changed.during("installments", "last_payment_date", WEEK).count() == 0
    assert ("calls", "call_at") in changed.by_day

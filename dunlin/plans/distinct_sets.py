"""Distinct counts over many days from stored, mergeable, exact sets.

A dictionary gives every agent and every loan a place: a block of 32,768 numbers and a bit
in it.  Members that come up on the same first day are given places together, so a day's accounts fill few blocks.  For each day the agents who worked, the loans in work and the accounts that
started are stored as one bitmap per block.  The count over any set of days is the
number of bits of the days' bitmaps or-ed block by block, so a yearly report reads a few
bitmaps a day and neither the calls nor the snapshot, and equals the exact rescan.

Places never change, so the sets of new days can be added to a stored folder, and a day that is
written again replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import dpd0
from ..operators.common import campaigns
from ..operators.staffing import CLOSED
from ..sources.periods import AS_OF, KEY, PE, PS, Periods
from ..sources.tables import Tables

BLOCK = 32768  # bits of a bitmap, fixed by Spark's bitmap functions
FILL = 30720  # members that are dealt to a block at a time: hashes deal unevenly, and few should need a second block

# What is counted -> dictionary of its members.
KINDS = {"FTE": "agent", "active_works": "loan", "total_accounts": "loan"}

_IDS = "value string, lane int, lanes int, pos long, dict string"
_SETS = "day date, block long, bits binary, kind string, part string"
WHOLE = "all"  # the part of a kind that is stored as a whole; other parts are days


@dataclass(frozen=True)
class DistinctSets:
    """Stored sets: (kind, part, day, block, bits)."""

    sets: DataFrame
    root: str

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> "DistinctSets":
        return cls(spark.read.schema(_SETS).parquet(f"{root}/sets"), root)

    def between(self, kind: str, lo, hi) -> DataFrame:
        """(day, block, bits) of a kind on the days lo to hi; the range also prunes the parts that are days."""
        day = F.col("day").between(F.lit(lo), F.lit(hi)) & ((F.col("part") == WHOLE) | F.col("part").between(str(lo), str(hi)))
        return self.sets.filter((F.col("kind") == kind) & day).select("day", "block", "bits")

    def before(self, kind: str, day) -> DataFrame:
        return self.sets.filter((F.col("kind") == kind) & (F.col("day") < F.lit(day)) & ((F.col("part") == WHOLE) | (F.col("part") < str(day)))).select("day", "block", "bits")


def members(t: Tables, periods: Periods) -> DataFrame:
    """(kind, day, value), with repeats: agents on campaign calls and loans in work on the days between the periods' first
    and last; accounts by the day they were disbursed, of all days, as a period counts those before it."""
    calls = t.during("calls", "call_at", periods)
    cm = campaigns(t, ["REM", "COLL", "WC"])
    agents = calls.join(cm, F.upper(calls["campaign"]) == cm["campaign_u"]).select(
        F.lit("FTE").alias("kind"), F.to_date("call_at").alias("day"), F.col("agent").alias("value"))
    works = t.bucket_flow.filter(periods.date_bounds("bucket_date") & dpd0("max_dpd").between(1, 179) & ~F.col("loan_status").isin(list(CLOSED))).select(
        F.lit("active_works").alias("kind"), F.col("bucket_date").alias("day"), F.col("loan_account").alias("value"))
    accounts = t.loan_master.filter((F.col("flag_disbursement") == 1) & ~F.col("loan_paid_status").isin(list(CLOSED))).select(
        F.lit("total_accounts").alias("kind"), F.to_date("disbursed_at").alias("day"), F.col("loan_account").alias("value"))
    return agents.unionByName(works).unionByName(accounts).filter("value is not null and day is not null")


def _stored_ids(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(_IDS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _IDS)


def extend_dictionary(values: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """Give a place to every (dict, value) that has none yet, and return the whole dictionary.

    New values are put in the order of their first ``day`` (if there is such a column) and, within a day, of a hash, and ``block``
    of them after the other go to each lane; positions count up within the lane, so numbers are dense and no task sees more
    than a lane.  The number of lanes is chosen when a dictionary starts, so that a lane fills about one block;
    later values go on in the lanes' next blocks."""
    spark = values.sparkSession
    old = _stored_ids(spark, path)
    have = {r["dict"]: r for r in old.groupBy("dict").agg(F.max("lanes").alias("lanes"), F.count(F.lit(1)).alias("n")).collect()}  # a row for each dictionary
    day = F.col("day") if "day" in values.columns else F.lit(None)
    new = values.groupBy("dict", "value").agg(F.coalesce(F.min(day.cast("date")), F.lit("1970-01-01").cast("date")).alias("first"))
    new = new.join(old.select("dict", "value"), ["dict", "value"], "left_anti")
    days = new.groupBy("dict", "first").agg(F.count(F.lit(1)).alias("n"))
    fresh = {r["dict"]: r.n for r in days.groupBy("dict").agg(F.sum("n").alias("n")).collect()}
    if not fresh:
        return old
    of = lambda x: F.create_map(*(F.lit(v) for kv in x.items() for v in kv))[F.col("dict")]
    lanes = {d: have[d].lanes if d in have else -(-n // block) for d, n in fresh.items()}
    begun = {d: have[d].n if d in have else 0 for d in fresh}
    before = F.sum("n").over(Window.partitionBy("dict").orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    days = days.withColumn("begin", F.coalesce(before, F.lit(0)) + of(begun))
    place = F.col("begin") + F.pmod(F.xxhash64("value"), F.col("n"))
    new = new.join(F.broadcast(days), ["dict", "first"])  # a row for each dictionary and day
    new = new.withColumn("lanes", of(lanes).cast("int")).withColumn("lane", F.pmod(F.floor(place / block), F.col("lanes")).cast("int"))
    used = old.groupBy("dict", "lane").agg((F.max("pos") + 1).alias("used"))
    nth = F.row_number().over(Window.partitionBy("dict", "lane").orderBy("value")) - 1
    new = new.join(used, ["dict", "lane"], "left").withColumn("pos", (nth + F.coalesce("used", F.lit(0))).cast("long"))
    new.select("value", "lane", "lanes", "pos", "dict").write.mode("append").partitionBy("dict").parquet(path)
    return spark.read.schema(_IDS).parquet(path)


def build(t: Tables, periods: Periods, root: str) -> DistinctSets:
    """Store the sets of the days between the periods' first and last below ``root`` (a shared folder), beside those already there.

    Accounts are stored anew, as one part: a loan that was closed since is no account any more.
    A day of agents or loans in work that is built again replaces itself.

    The members' days are read once and travel as one number for each member and month, whose bits are the days; they become
    rows of their own only in the task that sets the bits of a block and month."""
    spark = t.calls.sparkSession
    dicts = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    months = members(t, periods).groupBy("kind", "value", F.trunc("day", "month").alias("month")).agg(
        F.bit_or(F.expr("shiftleft(1, dayofmonth(day) - 1)")).alias("days"))
    months.withColumn("dict", dicts[F.col("kind")]).write.mode("overwrite").parquet(f"{root}/members")
    months = spark.read.schema("kind string, value string, month date, days int, dict string").parquet(f"{root}/members")
    first = F.date_add("month", F.bit_count(F.expr("(days & -days) - 1")))  # the lowest bit
    ids = extend_dictionary(months.select("dict", "value", first.alias("day")), f"{root}/ids", FILL)
    block = F.floor(F.col("pos") / BLOCK) * F.col("lanes") + F.col("lane")
    parts = sum(r.lanes for r in ids.groupBy("dict").agg(F.max("lanes").alias("lanes")).collect()) * len({(d.year, d.month) for s, e, _ in periods.spans for d in (s, e)})
    sets = months.join(ids, ["dict", "value"]).select("kind", "month", "days", "pos", block.cast("long").alias("block")).repartition(max(parts, 1), "block", "month")
    sets = sets.withColumn("nth", F.explode(F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.getbit("days", i) == 1)))
    sets = (sets.groupBy("kind", "month", F.date_add("month", F.col("nth")).alias("day"), "block")
            .agg(F.bitmap_construct_agg((F.col("pos") % BLOCK).cast("long")).alias("bits")).drop("month"))
    part = F.when(F.col("kind") == "total_accounts", WHOLE).otherwise(F.col("day").cast("string"))
    sets = sets.withColumn("part", part).hint("rebalance", "kind", "part").sortWithinPartitions("kind", "part", "day")
    sets.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "part").parquet(f"{root}/sets")
    return DistinctSets.open(spark, root)


def _bits(sets: DataFrame, by: list[str], name: str) -> DataFrame:
    """Number of members of the or-ed sets, by ``by``: partial ors before the shuffle, one bitmap per block after it."""
    merged = sets.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).cast("long").alias(name))


def staffing_counts(s: DistinctSets, periods: Periods) -> DataFrame:
    """FTE, total_accounts and active_works of each period, 0 where there are none: what
    :mod:`dunlin.operators.staffing` counts from the tables."""
    spark = s.sets.sparkSession
    frame = periods.frame(spark).drop(AS_OF)
    starts = sorted({p[0] for p in periods.spans})
    parts = [
        _bits(s.between("FTE", periods.lo, periods.hi).join(periods.calendar(spark).drop(AS_OF), "day"), KEY, "FTE"),
        _bits(s.before("total_accounts", starts[-1]).join(frame, F.col("day") < F.col(PS)), KEY, "total_accounts"),
        _bits(s.between("active_works", starts[0], starts[-1]).filter(F.col("day").isin(starts)).join(frame, F.col("day") == F.col(PS)), KEY, "active_works"),
    ]
    out = frame
    for p in parts:
        out = out.join(F.broadcast(p), KEY, "left")  # a row for each period
    return out.select(*KEY, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("FTE", "total_accounts", "active_works")))


def yearly_from_sets(rows: DataFrame, s: DistinctSets, window=None) -> DataFrame:
    """:func:`dunlin.plans.ytd.yearly_from_monthly` with the staffing read from stored sets: agents
    of any day that a row covers, accounts before the last row's start, loans in work on any row's start day."""
    from .ytd import _bounds, _one_row, _ratios
    from ..functions.keys import safe_div
    b = _bounds(rows)
    spans = rows.select(PS, PE).distinct()
    days = spans.filter(F.col(PS) <= F.col(PE)).select(F.explode(F.sequence(PS, PE)).alias("day")).distinct()
    starts = spans.select(F.col(PS).alias("day")).distinct()
    fte = _bits(s.between("FTE", b.s, b.e).join(days, "day", "left_semi"), [], "FTE")
    accounts = _bits(s.before("total_accounts", b.last), [], "total_accounts")
    works = _bits(s.between("active_works", b.s, b.last).join(starts, "day", "left_semi"), [], "active_works")
    sel = rows if window is None else rows.filter(F.col(PS).between(F.lit(window[0]), F.lit(window[1])))
    main = sel.agg(*_ratios(), safe_div(F.sum("kept_ptp"), F.sum("ptp_received")).alias("kept_ptp"))
    zero = [d.select(F.coalesce(F.col(d.columns[0]), F.lit(0)).alias(d.columns[0])) for d in (fte, accounts, works)]
    return _one_row(main, *zero)

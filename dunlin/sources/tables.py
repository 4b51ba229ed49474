"""The seven input tables as one value, plus loading and materialising them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, fields, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S

ROWS_PER_PART = 500_000

_NOT_TABLES = ("memo", "sizes", "by_day", "loan_buckets", "split_hot")


@dataclass(frozen=True)
class Tables:
    loan_master: DataFrame
    calls: DataFrame
    campaign_master: DataFrame
    contact_details: DataFrame
    bucket_flow: DataFrame
    installments: DataFrame
    ptp: DataFrame
    # Opt-in reuse of intermediate results shared by several KPIs (see
    # :meth:`reusing`); not part of the table identity.
    memo: dict | None = field(default=None, compare=False, repr=False)
    # Whether a table has at most so many rows: one check per table of this value.
    sizes: dict = field(default_factory=dict, compare=False, repr=False)
    # Stored copies partitioned by the day of a column: (table, column) -> frame with the column ``day``.
    by_day: dict = field(default_factory=dict, compare=False, repr=False)
    # Tables that are stored in buckets by loan, and the number of buckets (see :func:`dunlin.sources.stored.write_buckets`).
    loan_buckets: dict = field(default_factory=dict, compare=False)
    # Whether joins on phone numbers cut hot numbers into pieces themselves (see :meth:`splitting`).
    split_hot: bool = field(default=False, compare=False)

    def names(self) -> list[str]:
        return [f.name for f in fields(self) if f.name not in _NOT_TABLES]

    def during(self, name: str, column: str, periods) -> DataFrame:
        """Rows of table ``name`` whose date or timestamp ``column`` lies between the first and
        the last day of ``periods``.

        Where a copy partitioned by that column's day is stored, the range is also put on its
        partition column, so other days are not opened.  A timestamp's day was taken in the
        writer's time zone: one day more on either side is opened, and the range on the timestamp
        itself decides."""
        plain = getattr(self, name)
        stamp = isinstance(plain.schema[column].dataType, T.TimestampType)
        rows = periods.ts_bounds(column) if stamp else periods.date_bounds(column)
        stored = self.by_day.get((name, column))
        if stored is None:
            return plain.filter(rows)
        return stored.filter(periods.date_bounds("day", slack=int(stamp)) & rows).drop("day")

    def reusing(self) -> "Tables":
        """A copy whose shared intermediates (period slices of the snapshot,
        loan -> phone map, payment bases) are built once and persisted
        (MEMORY_AND_DISK; recomputed from lineage if an executor is lost).
        The caller owns it: ``with t.reusing() as shared: ...`` releases it, or
        call :meth:`release` when the results have been collected or written."""
        return replace(self, memo={})

    def splitting(self) -> "Tables":
        """A copy whose joins on phone numbers cut hot numbers into pieces (:mod:`dunlin.operators.skew`), for
        sessions without adaptive skew joins.  It costs one more count of the rows by number."""
        return replace(self, split_hot=True)

    def by_loan(self, name: str | None, rows: DataFrame, periods=()) -> DataFrame:
        """``rows`` of table ``name`` (None: of several), dealt by loan once: aggregations and joins by loan (and
        more) that follow stay in place.  Rows of a table stored by loan are dealt already; others go to the
        same number of partitions, so they meet stored ones where those are.  Without stored ones there are as many
        as keep to :data:`ROWS_PER_PART` rows, if a loan has a row in each of ``periods``: a task sorts and
        aggregates them several times over, and sizes of shuffled bytes do not tell how much memory that takes."""
        if name in self.loan_buckets:
            return rows
        n = next(iter(self.loan_buckets.values()), None)
        return rows.repartition(n or self.loan_parts(max(1, len(periods))), "loan_account")

    def loan_parts(self, rows: int) -> int:
        """Partitions for ``rows`` rows of every loan; the loan master is counted once (columnar files know their rows)."""
        key = ("loan_master", None)
        if key not in self.sizes:
            self.sizes[key] = self.loan_master.count()
        return max(self.loan_master.sparkSession.sparkContext.defaultParallelism, -(-self.sizes[key] * rows // ROWS_PER_PART))

    def __enter__(self) -> "Tables":
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def at_most(self, name: str, rows: int) -> bool:
        """True if table ``name`` has at most ``rows`` rows (a LIMIT rows + 1 count, made once)."""
        key = (name, rows)
        if key not in self.sizes:
            self.sizes[key] = getattr(self, name).limit(rows + 1).count() <= rows
        return self.sizes[key]

    def shared(self, key, build):
        if self.memo is None:
            return build()
        if key not in self.memo:
            self.memo[key] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self.memo[key]

    def release(self) -> None:
        for df in (self.memo or {}).values():
            df.unpersist()
        if self.memo is not None:
            self.memo.clear()

    def with_(self, **kw) -> "Tables":
        return replace(self, sizes={}, by_day={k: v for k, v in self.by_day.items() if k[0] not in kw}, loan_buckets={k: n for k, n in self.loan_buckets.items() if k not in kw}, **kw)

    @classmethod
    def load(cls, spark: SparkSession, root: str, fmt: str = "parquet") -> "Tables":
        """Read the seven tables from ``{root}/{name}`` with the declared schemas."""
        root = root.rstrip("/")
        out = {}
        for name, schema in S.INPUTS.items():
            reader = spark.read.format(fmt)
            if fmt == "csv":
                reader = reader.option("header", "true").schema(schema)
            df = reader.load(f"{root}/{name}")
            out[name] = df.select([df[f.name].cast(f.dataType) for f in schema.fields])
        return cls(**out)

    @classmethod
    def from_catalog(cls, spark: SparkSession, names: dict[str, str]) -> "Tables":
        """Bind to catalog tables, e.g. ``{"calls": "ops.call_attempts", ...}``."""
        return cls(**{k: spark.table(v) for k, v in names.items()})

    def materialize(self, root: str) -> "Tables":
        """The tables written below ``root`` by day (:func:`dunlin.sources.stored.write_days`) and read back."""
        from .stored import write_days
        return write_days(self, root)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the session's shared checkpoint dir."""
    from ..session import checkpoint_root
    return f"{checkpoint_root(spark)}/dunlin-{label}-{uuid.uuid4().hex[:12]}"

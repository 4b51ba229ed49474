"""KPI tables that readers never see half replaced: write, audit, publish.

New rows of some periods are staged in a version of their own; the audit reads the staged
files back; a manifest that names each period's version is published last, as one file.  Readers follow
the newest manifest.  A failed audit, or a writer that dies, leaves it as it was.
Earlier manifests stay, so a backup is a number and a restore publishes it again.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PERIOD, VERSION = "period_start", "version"
_MANIFEST = f"seq long, {PERIOD} date, {VERSION} string"


class AuditFailed(ValueError):
    """The staged rows must not be published."""


def audit(staged: DataFrame, key: list[str]) -> DataFrame:
    """(check, failed): how many rows or periods fail each check, in one aggregation by period.

    Every staged period has exactly one row, and no row lacks a part of the key."""
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(k).isNull()
    per = staged.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(null_key, 1)).alias("nulls"))
    one = per.agg(F.count(F.when(F.col("n") != 1, 1)).alias("one_row_per_period"), F.coalesce(F.sum("nulls"), F.lit(0)).cast("long").alias("key_not_null"),
                  F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).cast("long").alias("some_rows"))
    return one.unpivot([], ["one_row_per_period", "key_not_null", "some_rows"], "check", "failed")


class PublishedTable:
    """A KPI table below ``root`` (a shared folder), keyed by ``key``, whose first column is the period's start."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str]):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, list(key)

    def manifests(self) -> DataFrame:
        """Every published manifest: (seq, period_start, version)."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def seq(self) -> int:
        """Number of the newest manifest, 0 if none was published."""
        return self.manifests().agg(F.max("seq")).first()[0] or 0

    def at(self, seq: int) -> DataFrame:
        return self.manifests().filter(F.col("seq") == seq).select(PERIOD, VERSION)

    def _rows(self) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField(VERSION, T.StringType()), T.StructField(PERIOD, T.DateType())])
        return self.spark.read.schema(stored).parquet(f"{self.root}/rows")

    def read(self, seq: int | None = None) -> DataFrame:
        """Rows of a manifest (the newest by default).  The manifest, a row for each period, prunes the
        partitions that are read."""
        seq = self.seq() if seq is None else seq
        if not seq:
            return self.spark.createDataFrame([], self.schema)
        return self._rows().join(F.broadcast(self.at(seq)), [VERSION, PERIOD]).select(*self.schema.names)

    def stage(self, df: DataFrame) -> str:
        """Write rows to a version that no reader looks at yet, and return its name."""
        version = uuid.uuid4().hex
        rows = df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        rows = rows.withColumn(VERSION, F.lit(version)).withColumn(PERIOD, F.col(self.schema.names[0]).cast("date"))
        rows.write.mode("append").partitionBy(VERSION, PERIOD).parquet(f"{self.root}/rows")
        return version

    def staged(self, version: str) -> DataFrame:
        return self._rows().filter(F.col(VERSION) == version)

    def publish(self, version: str) -> int:
        """Audit a staged version; replace its periods in a new manifest, and return the manifest's number."""
        staged = self.staged(version)
        failed = [f"{r.check}: {r.failed}" for r in audit(staged, self.key).filter("failed > 0").collect()]
        if failed:
            raise AuditFailed(", ".join(failed))
        seq = self.seq()
        new = staged.select(PERIOD, VERSION).distinct()
        kept = self.at(seq).join(new.select(PERIOD), PERIOD, "left_anti")
        return self._point(seq + 1, kept.select(PERIOD, VERSION).unionByName(new))

    def replace(self, df: DataFrame) -> int:
        """Stage, audit and publish the periods of ``df``; other periods stay."""
        return self.publish(self.stage(df))

    def restore(self, seq: int) -> int:
        """Publish an earlier manifest again."""
        old = self.at(seq)
        if old.limit(1).count() == 0:
            raise ValueError(f"no manifest {seq}")
        return self._point(self.seq() + 1, old)

    def _point(self, seq: int, manifest: DataFrame) -> int:
        # one file, moved into place when it is complete; of two writers of one number the second fails
        manifest.select(F.lit(seq).cast("long").alias("seq"), PERIOD, VERSION).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/{seq:09d}")
        return seq

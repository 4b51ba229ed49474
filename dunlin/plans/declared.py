"""KPI tables with a declared schema: checked appends, generations of columns, column differences.

A table is a folder of Parquet rows, partitioned by period start, and beside it the schemas
that were declared for it, one per generation.  An append is compared with the newest schema
first.  New columns start a generation if the caller says so; rows of
older generations read back with NULL in them.  Readers use the declared schema, so
no footers are merged, however many files there are.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sinks import PARTITION_COL, _with_partition

_GENERATIONS = "generation int, schema string"
_DIFFERENCE = "position int, column string, change string, declared_type string, frame_type string"


class SchemaMismatch(ValueError):
    """The frame's columns are not those that the table declares."""


def schema_difference(declared: T.StructType, frame: T.StructType) -> list[tuple]:
    """(position, column, change, declared type, frame type) of every column that is ``missing`` from
    the frame, ``extra`` in it or of another ``type``; declared columns first, in their order.

    Names are compared as Spark compares them by default, without regard to case."""
    mine, theirs = ({f.name.lower(): f for f in s.fields} for s in (declared, frame))
    out = []
    for k, f in enumerate(declared.fields):
        other = theirs.get(f.name.lower())
        if other is None:
            out.append((k, f.name, "missing", f.dataType.simpleString(), None))
        elif other.dataType != f.dataType:
            out.append((k, f.name, "type", f.dataType.simpleString(), other.dataType.simpleString()))
    extra = [f for f in frame.fields if f.name.lower() not in mine]
    return out + [(len(declared.fields) + k, f.name, "extra", None, f.dataType.simpleString()) for k, f in enumerate(extra)]


class DeclaredTable:
    """A KPI table below ``root`` (a shared folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @classmethod
    def create(cls, spark: SparkSession, root: str, schema: T.StructType) -> "DeclaredTable":
        """Declare the first generation; fails if the table exists."""
        self = cls(spark, root)
        self._declare(1, schema)
        return self

    def _declare(self, generation: int, schema: T.StructType) -> None:
        row = self.spark.createDataFrame([(generation, schema.json())], _GENERATIONS)
        # two writers that declare the same generation: the second finds the folder and fails
        row.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/schemas/{generation:06d}")

    def generations(self) -> list[tuple[int, T.StructType]]:
        rows = self.spark.read.schema(_GENERATIONS).parquet(f"{self.root}/schemas/*").orderBy("generation").collect()
        return [(r.generation, T.StructType.fromJson(json.loads(r["schema"]))) for r in rows]

    def schema(self) -> T.StructType:
        return self.generations()[-1][1]

    def difference(self, df: DataFrame) -> DataFrame:
        """:func:`schema_difference` of the newest generation and ``df``, as rows."""
        return self.spark.createDataFrame(schema_difference(self.schema(), df.schema), _DIFFERENCE)

    def append(self, df: DataFrame, evolve: bool = False) -> None:
        """Append the rows of ``df``; columns are matched by name.

        A column of another type always raises.  Missing and extra columns raise too, unless
        ``evolve``: then missing ones are NULL in the new rows, and extra ones are declared in a new generation."""
        generation, declared = self.generations()[-1]
        diff = schema_difference(declared, df.schema)
        bad = [d for d in diff if d[2] == "type" or not evolve]
        if bad:
            raise SchemaMismatch("; ".join(f"{c}: {change} (declared {a}, frame {b})" for _, c, change, a, b in bad))
        extra = {d[1] for d in diff if d[2] == "extra"}
        if extra:
            declared = T.StructType(declared.fields + [T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name in extra])
            self._declare(generation + 1, declared)
        missing = {d[1] for d in diff if d[2] == "missing"}
        rows = df.select(*((F.lit(None).cast(f.dataType) if f.name in missing else F.col(f.name)).alias(f.name) for f in declared.fields))
        _with_partition(rows).write.mode("append").partitionBy(PARTITION_COL).parquet(f"{self.root}/rows")

    def read(self, generation: int | None = None) -> DataFrame:
        """All rows with the columns of a generation (the newest by default); NULL where a row was written before its column."""
        schemas = dict(self.generations())
        schema = schemas[generation or max(schemas)]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/rows").select(*schema.names)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)


def column_use(rows: DataFrame) -> DataFrame:
    """(column, n_rows, n_values): how many rows have a value in each column, in one pass over the rows."""
    counts = rows.agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(c) for c in rows.columns))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c in rows.columns))
    return counts.select("_rows", F.explode(pairs).alias("x")).select("x.column", F.col("_rows").alias("n_rows"), "x.n_values")

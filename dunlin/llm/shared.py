"""Shared scratch folder, tables written to it, and Arrow plumbing of the operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a temporary folder; any
    other master raises, as executors would not see the driver's disk.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dunlin-llm-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def row_key(by: str = "doc_id"):
    """Key of a row's id and text, so that what was decided for a row reaches this row alone, also without an id."""
    return F.concat_ws(":", F.xxhash64(by, "text"), F.xxhash64(F.lit(1), by, "text"))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose :func:`row_key` is in ``gone`` (__row)."""
    return docs.withColumn("__row", row_key()).join(gone.select("__row").distinct(), "__row", "left_anti").select(*docs.columns)


def stored(df: DataFrame, folder: str | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: cuts its
    lineage, and later stages survive the loss of any executor."""
    spark = df.sparkSession
    path = folder or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffer(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and the rows' offsets; a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset: arr.offset + len(arr) + 1]
    body = arr.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offs[0]: offs[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(offs: np.ndarray, most_bytes: int = 1 << 20, most_rows: int = 1024):
    """Consecutive row ranges of about ``most_bytes`` (one longer row is a range of its own)."""
    row, n = 0, len(offs) - 1
    while row < n:
        stop = int(np.searchsorted(offs, offs[row] + most_bytes, "right")) - 1
        stop = min(max(stop, row + 1), row + most_rows, n)
        yield row, stop
        row = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

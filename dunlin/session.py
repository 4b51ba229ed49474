"""SparkSession construction and the shared checkpoint folder.

Library code never creates a session of its own: every operator takes the
caller's DataFrames.  ``get_session`` is for tests, ``bench.py`` and the
command-line entry points; on a cluster the user's session (spark-submit,
notebook) is used as is.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every run needs for results that match the SQL oracle.
_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "dunlin") -> SparkSession:
    """Local/test session.  On a cluster pass nothing and let spark-submit decide."""
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("DUNLIN_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in _REQUIRED.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    for k, v in _REQUIRED.items():
        spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    if spark.sparkContext.master.startswith("local"):
        ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Falls back to the SparkContext's checkpoint dir; raises if neither is set
    (call :func:`ensure_checkpoint_dir` first in tests).
    """
    root = _named_dir(spark) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
    return root.rstrip("/")


def _named_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Use the session's ``spark.checkpoint.dir``; only when it is unset and the
    master is local (tests, local runs) create a fresh scratch folder.  On any
    other master a folder of the driver's disk is not shared, so it raises.
    Also registers the folder with the SparkContext for ``DataFrame.checkpoint()``."""
    sc = spark.sparkContext
    root = _named_dir(spark) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set; the cluster must name a shared folder")
        root = fallback or tempfile.mkdtemp(prefix="dunlin-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root.rstrip("/")

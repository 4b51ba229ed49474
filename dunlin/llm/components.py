"""Connected components by minimum labels with pointer jumping, each round stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import shared_dir, stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label): label is the smallest node that ``edges`` (long columns a, b) reach.

    Only nodes with an edge appear; an empty input gives an empty result.  A
    round takes the minimum over neighbours, then jumps to the label's label, so
    long chains halve.  Minima are combined before the shuffle, so a hub with
    many edges costs one row per task.  Each round is a table in the shared
    folder.  Null ends are ignored.
    """
    folder = shared_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = stored(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{folder}/edges")
    labels = stored(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), f"{folder}/0")
    for k in range(1, 200):
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = stored(step.join(jump, "to").select("node", "label", F.least("to", "beyond").alias("next")), f"{folder}/{k}")
        moved = new.where("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not moved:
            return labels
    raise RuntimeError("components did not settle")

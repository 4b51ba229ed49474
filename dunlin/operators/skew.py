"""Joins on a key that a large share of the rows may have, without adaptive execution's help.

A placeholder phone number can stand on a third of all calls or contacts.  A hash join sends
all of them to one task.  :func:`split_join` finds such keys with a partial count, cuts their
rows on the one side into pieces by a hash, and repeats the few matching rows of the
other side for each piece; every other key joins as usual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 4  # pieces for each share of a partition that a key's rows make


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """(key columns, pieces) of the keys that more than one shuffle partition's share of ``rows`` has.

    Fewer rows than there are shuffle partitions, as each key stands for more than 1 / partitions of the rows: small enough to broadcast."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("_n") * parts > F.col("_total"))
    return hot.select(*on, F.ceil(F.col("_n") * (parts * PIECES) / F.col("_total")).cast("int").alias("_pieces"))


def split_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``many.join(few, on, how)`` (inner, left or left_semi) with the hot keys of ``many`` cut into pieces.

    ``few`` should hold few rows of a key: those of a hot key are repeated once for each piece.  Rows of ``many``
    are told apart by a hash of all their columns, so a retried task deals them alike.  A null key
    matches nothing; its rows are not counted or cut, and an inner or semi join drops them before."""
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(how)
    known = None
    for c in on:
        known = F.col(c).isNotNull() if known is None else known & F.col(c).isNotNull()
    hot = F.broadcast(hot_keys(many.filter(known), on))
    left = many.filter(known) if how != "left" else many
    salt = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(*many.columns), F.col("_pieces")))
    # rows of a null key stay apart from one another too: they match nothing wherever they are
    salt = F.when(known, F.coalesce(salt, F.lit(0))).otherwise(F.xxhash64(*many.columns)).cast("long")
    left = left.join(hot, on, "left").withColumn("_piece", salt).drop("_pieces")
    right = few.join(hot, on, "left")
    right = right.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_pieces") - 1, F.lit(0)).cast("long")))).drop("_pieces")
    return left.join(right, [*on, "_piece"], how).drop("_piece")

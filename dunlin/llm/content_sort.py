"""Exact deduplication by sorting whole contents, in DataFrame functions only.

Every run of white space becomes one space.  Splitters sampled from the normalised
bytes deal the rows to ranges; Spark's external sort puts equal texts next to each other;
a window over the sorted rows compares each whole text with its neighbour's, and the
row with the smallest identifier of a run of equal texts stays.

A splitter is the text's first 64 code points and a hash of the whole text: it is
small however long the texts are, and texts that share an opening still fall into
many ranges.  A text that fills more than one range's share of the rows is cut into
as many pieces by a hash of the identifier; the pieces' first rows are merged
afterwards by the SHA-256 of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlin.llm.shared import shared_dir, stored

OPENING = 64  # code points of a splitter


def normalised(text):
    """The text with each run of ``[\\x20\\x09-\\x0D]`` as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def common_texts(rows: DataFrame) -> DataFrame:
    """(h, pieces) of the text hashes that more than one range's share of ``rows`` has.

    Fewer rows than there are shuffle partitions, as each stands for more than 1 / partitions of all rows.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = rows.count()
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * ranges > total)
    return counts.select("h", F.ceil(F.col("n") * ranges / F.lit(max(total, 1))).cast("int").alias("pieces"))


def content_sort(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; with ``carry`` also ``row``, a struct of all columns.

    keep_id is the smallest doc_id of the rows with an equal normalised text, group_size
    their number.  Exactly one row of a group is kept: of several rows with the smallest doc_id any one.
    A null text is empty; null doc_ids come last, and keep_id is null
    where a group has no other.  An empty table gives an empty result.  Columns of
    ``docs`` beside doc_id and text take no part, whatever their names.
    """
    folder = shared_dir(docs.sparkSession)
    cols = [docs["doc_id"].alias("doc_id"), normalised(docs["text"]).alias("norm")]
    if carry:
        cols.append(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = docs.select(*cols).withColumn("h", F.xxhash64("norm"))
    common = F.broadcast(stored(common_texts(rows.select("h")), f"{folder}/common"))
    rows = rows.join(common, "h", "left").withColumn(
        "piece", F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("pieces")).cast("int")).otherwise(-1))
    ranged = rows.withColumn("opening", F.substring("norm", 1, OPENING)).repartitionByRange("opening", "h", "piece")
    # equal texts of a piece lie in one range, so neither the window nor its sort moves rows again
    run = Window.partitionBy("opening", "h", "piece", "norm").orderBy(F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.select("*", F.row_number().over(run).alias("nth"), F.min("doc_id").over(whole).alias("least"), F.count(F.lit(1)).over(whole).alias("n"))
    found = stored(found.select("doc_id", *(["row"] if carry else []), "least", "n", (F.col("nth") == 1).alias("first"),
                                (F.col("piece") >= 0).alias("split"), F.sha2("norm", 256).alias("text_sha256")), f"{folder}/runs")
    # one row for each piece of a common text: at most two for each range
    merged = found.where("split and first").groupBy(F.col("text_sha256").alias("sha")).agg(F.min("least").alias("of_all"), F.sum("n").alias("in_all"))
    j = found.join(F.broadcast(merged), F.col("split") & (F.col("text_sha256") == F.col("sha")), "left")
    keep = F.when(F.col("split"), F.col("of_all")).otherwise(F.col("least"))
    return j.select("doc_id", *(["row"] if carry else []), keep.alias("keep_id"), F.when(F.col("split"), F.col("in_all")).otherwise(F.col("n")).alias("group_size"),
                    (F.col("first") & F.col("least").eqNullSafe(keep)).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return content_sort(docs, carry=True).where("kept").select("row.*")

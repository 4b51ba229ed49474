"""The corpus pipeline: quality filter, near-duplicate removal, decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dunlin.llm import decontam, ngram_join, packing, quality, secret_scan
from dunlin.llm.queries import tokenizer_path
from dunlin.llm.shared import shared_dir, stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return ngram_join.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside a benchmark window go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every found secret is replaced by a mark, a private key with its body; n_chars counts the new text."""
    return secret_scan.redact(docs, secret_scan.scan(docs, rules=secret_scan.WHOLE_RULES))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as op10 returns them."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", good_documents), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets),
          ("pack", pack)]

# Near-duplicate components, covariance factors and merges of a tokenizer are beyond SQL;
# tests/llm/test_pipeline.py holds run() against a brute-force version of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs

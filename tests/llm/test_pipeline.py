import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from dunlin.llm import decontam, ngram_join, quality
from dunlin.llm.secret_scan import RULES
from tests.llm.data import words
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_ngram_join import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    left = {i: rows[i].text for i in good}
    left = {i: left[i] for i in {c for _, c in groups(left).values()}}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    hit = leaks(left, {str(k): t for k, t in items.items()})
    left = {i: t for i, t in left.items() if not hit[i][4]}
    for i, t in left.items():
        spans = sorted(m.span() for _, p, g, least in RULES.values() for m in re.finditer(p, t or "") if len(m[g]) >= least)
        out, at = "", 0
        for a, b in spans:
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        left[i] = out + t[at:] if spans else t
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in left.items()}
    out = corpus_pipeline.run(spark, SF).collect()
    got = {}
    for r in out:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want and 50 < len(got) < len(rows)


def test_all_but_the_last_stage_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert np.array(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()).size == 0


def test_decisions_hold_for_their_row(spark):
    schema = "doc_id long, text string"
    a, b, c = words(1, 60), words(2, 60), words(3, 60)
    df = spark.createDataFrame([(1, a), (None, a), (2, a), (2, b), (None, c), (None, c + " more"), (None, "")], schema)
    left = [(r.doc_id, r.text) for r in ngram_join.deduplicated(df).collect()]
    assert (1, a) in left and (2, b) in left and (None, "") in left and len(left) == 4
    assert sum(t in (c, c + " more") for _, t in left) == 1
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    left = [(r.doc_id, r.text) for r in decontam.clean(df, items).collect()]
    assert a not in [t for _, t in left] and (2, b) in left and len(left) == 4
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted == 1}
    rejected = {t for i, t in texts.items() if i not in good}
    both = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    left = quality.kept(both, labels).select("doc_id", "text").collect()
    assert rejected and not rejected & {r.text for r in left} and {r.doc_id for r in left} == good | {None}


def test_one_row_of_a_group_stays(spark):
    a, b = words(1, 60), words(2, 60)
    df = spark.createDataFrame([(1, a, "p"), (1, a, "q"), (1, a, "p"), (2, b, "p"), (3, a + " x", "p"), (4, a + " y", "p"), (4, a + " z", "p"),
                                (5, "", "p"), (5, "", "p"), (6, None, "p"), (None, b, "p"), (7, words(3, 60), "p"), (7, words(3, 60) + " more", "p")],
                               "doc_id long, text string, x string").repartition(4)
    left = [(r.doc_id, r.text) for r in ngram_join.deduplicated(df).collect()]
    assert sorted(i for i, _ in left) == [1, 2, 5, 5, 6, 7] and (1, a) in left and (2, b) in left


def test_rows_that_only_share_a_doc_id_all_stay(spark):
    df = spark.createDataFrame([(9, words(k, 50)) for k in range(5)], "doc_id long, text string")
    assert ngram_join.deduplicated(df).count() == 5

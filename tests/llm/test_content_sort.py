import hashlib
import random
import re

from pyspark.sql import functions as F

from dunlin.llm import content_sort as C
from tests.llm.data import AWKWARD, documents, empty, words


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    """{(doc_id, sha256): (keep_id, group_size, number of rows)} and the kept ids of (doc_id, text) rows."""
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        some = sorted(i for i in ids if i is not None) + [None] * ids.count(None)
        out += [(i, some[0], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()) for k, i in enumerate(some)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def check(spark, rows, parts=5):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert result(C.content_sort(df)) == brute(rows)


def test_awkward_texts_and_repeats(spark):
    texts = AWKWARD | {20: "a  b", 21: "a\tb", 22: "a b ", 23: "A b", 24: "a b", 25: words(7, 12_000), 26: words(7, 12_000) + "x"}
    got = result(C.content_sort(documents(spark, texts, repeat=(4, 7, 20))))
    assert got == brute([*texts.items(), (4, texts[4]), (7, texts[7]), (20, texts[20])])


def test_null_ids_shared_ids_and_ties(spark):
    check(spark, [(None, "x"), (None, "x"), (3, "x"), (3, "x"), (3, "y"), (None, "z"), (None, "z"), (5, None), (2, ""), (2, " ")])


def test_a_common_text_is_split_and_still_one_group(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(10**6), words(1, 90) + " " * rnd.randrange(1, 3) + "end") for _ in range(600)] + [(k, words(k, 60)) for k in range(1200)]
    rows += [(k, words(1, 90) + f" other {k % 7}") for k in range(300)]  # texts that share the splitter's opening
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    pieces = C.common_texts(df.select(F.xxhash64(C.normalised(F.col("text"))).alias("h"))).collect()
    assert len(pieces) == 1 and pieces[0].pieces >= 2
    check(spark, rows)


def test_random_groups(spark):
    rnd = random.Random(4)
    check(spark, [(rnd.randrange(200), rnd.choice([" ", "\n\n", "\t"]).join(rnd.choice("ab") for _ in range(rnd.randrange(5)))) for _ in range(400)])


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, {1: "a b", 2: "a  b", 3: "c"}, repeat=(1, 3))
    out = C.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "a b"), (3, "c")]


def test_texts_are_moved_once_and_no_python_runs(spark):
    docs = documents(spark, {k: words(k, 30) for k in range(50)})
    plan = C.content_sort(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    ranged = C.normalised(docs["text"])
    from pyspark.sql import Window
    df = docs.select("doc_id", ranged.alias("norm")).withColumn("h", F.xxhash64("norm")).repartitionByRange("h")
    one = df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h", "norm")))._jdf.queryExecution().executedPlan().toString()
    assert one.count("Exchange rangepartitioning") == 1 and "hashpartitioning" not in one


def test_empty(spark):
    assert C.content_sort(empty(spark)).count() == 0 and C.deduplicated(empty(spark)).count() == 0

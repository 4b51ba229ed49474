import hashlib
import math
import random
import re
import zlib

import numpy as np

from dunlin.llm import resampling as R
from tests.llm.data import AWKWARD, documents, empty, words

LONG = "Ω" * 70 + " " + "x" * 63 + " " + "y" * 64 + " " + "z" * 65 + " " + "q" * 9000 + " tail"


def bag(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target):
    bags = [(i, *bag(t)) for i, t in rows]
    s, t = [0] * 10000, [0] * 10000
    for _, _, f in bags:
        for b in f:
            s[b] += 1
    for x in target:
        for b in bag(x)[1]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((b + 1.0) * (sum(s) + 10000.0) / ((a + 1.0) * (sum(t) + 10000.0)))) for a, b in zip(s, t)]
    out = []
    for i, n, f in bags:
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((x for x in out if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0], x[3], x[2]))
    for k, x in enumerate(able[: 25 * len(able) // 100]):
        x[5] = k + 1
    return sorted(((x[0], *x[2:]) for x in out), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def items(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_crc_of_words_and_pairs():
    crc, body = R.Crc(), (LONG + " a bc").encode()
    _, bucket, doc = R.features([body, b"", b"A,b", b"one"], crc, 1 << 31)
    w = R.WORD.findall(body.lower())
    want = [*w, b"a", b"b", b"one", *(a + b" " + b for a, b in zip(w, w[1:])), b"a b"]
    assert bucket.tolist() == [zlib.crc32(f) % (1 << 31) for f in want]
    assert np.bincount(doc, minlength=4).tolist() == [2 * len(w) - 1, 0, 3, 1]


def test_words_of_neighbouring_texts_never_pair():
    got = R.features([b"x", b"y", b"", b"z w"], R.Crc())[2]
    assert got.tolist() == [0, 1, 3, 3, 3]


def test_against_brute_force(spark):
    rnd = random.Random(5)
    texts = AWKWARD | {30 + k: words(rnd.randrange(90), rnd.randrange(5, 60), 60) for k in range(200)} | {300: LONG, 301: words(1, 19), 302: words(1, 20)}
    target = [words(k, 40, 25) for k in range(30)] + [None, "", "Only HERE"]
    docs = documents(spark, texts, repeat=(31, 32))
    want = brute([*texts.items(), (31, texts[31]), (32, texts[32])], target)
    got = R.resample(docs, items(spark, target))
    assert result(got) == want
    assert dict(got.dtypes) == {c: "bigint" for c in ("doc_id", "n_features", "weight", "score", "rank")}


def test_null_and_shared_ids(spark):
    rows = [(None, words(1, 30)), (None, words(2, 30)), (7, words(3, 30)), (7, words(4, 30)), (7, words(4, 30))] + [(k, words(k, 25)) for k in range(20, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(R.resample(df, items(spark, ["a b c"]))) == brute(rows, ["a b c"])


def test_drawn_rows_lean_to_the_target(spark):
    texts = {k: words(k, 60, 50) for k in range(300)} | {1000 + k: "t" + words(k, 60, 50).replace(" w", " t") for k in range(300)}
    target = ["t" + words(9000 + k, 60, 50).replace(" w", " t") for k in range(50)]
    docs = documents(spark, texts)
    drawn = [r.doc_id for r in R.sample(docs, items(spark, target)).collect()]
    assert len(drawn) == 150 and sum(i >= 1000 for i in drawn) > 120  # 75 by chance
    assert R.sample(docs, items(spark, target)).columns == docs.columns


def test_empty_tables(spark):
    assert R.resample(empty(spark), items(spark, ["a b"])).count() == 0
    docs = documents(spark, {k: words(k, 30) for k in range(8)})
    assert result(R.resample(docs, items(spark, []))) == brute([(k, words(k, 30)) for k in range(8)], [])
    assert R.resample(documents(spark, {1: "x", 2: None}), items(spark, ["a"])).where("rank is not null").count() == 0

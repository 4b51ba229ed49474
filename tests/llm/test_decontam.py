import hashlib
import re
from collections import defaultdict

from dunlin.llm import decontam
from tests.llm.data import AWKWARD, documents, empty, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall((t or "").encode().lower())


def brute(texts, items):
    windows = defaultdict(set)
    for i, t in items.items():
        w = split(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[s:s + k])].add(i)
    out = {}
    for d, t in texts.items():
        w, hit, found = split(t), set(), set()
        for size in {len(x) for x in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s:s + size]) in windows:
                    hit |= set(range(s, s + size))
                    found |= windows[tuple(w[s:s + size])]
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = {"1": words(50, 30), "10": words(50, 30), "2": words(51, 25) + "!", "3": "Only, four short words", "4": None, "5": "--- !", "6": "été über straße"}


def cases():
    a, b = ITEMS["1"].split(), ITEMS["2"].split()
    return AWKWARD | {
        20: ITEMS["1"], 21: words(60, 40) + " " + " ".join(a[5:15]) + " " + words(61, 40), 22: " ".join(a[5:14]),
        23: " ".join(a[:12]) + " x " + " ".join(b[3:20]).upper(), 24: "so only four, short words here", 25: "only four short", 26: "ÉTÉ über straße été über Straße",
        27: " ".join(a[:20] + a[:20]), 28: words(62, 500)}


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, 1) for i, t in items.items()], "item_id string, text string, doc_id int")


def test_matches_brute_force(spark):
    got = decontam.flagged(documents(spark, cases(), repeat=(20,)), benchmark(spark, ITEMS)).collect()
    assert len(got) == len(cases()) + 1
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(cases(), ITEMS)


def test_blocks_of_the_benchmark_agree(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    got = decontam.flagged(documents(spark, cases()), benchmark(spark, ITEMS)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(cases(), ITEMS)


def test_longest_matches_have_their_places(spark):
    r = {x.doc_id: x for x in decontam.scan(documents(spark, cases()), benchmark(spark, ITEMS)).collect()}
    assert {(s.item_id, s.item_word, s.word, s.n_words) for s in r[23].spans} == {("1", 0, 0, 12), ("10", 0, 0, 12), ("2", 3, 13, 17)}
    assert {(s.item_id, s.item_word, s.word, s.n_words) for s in r[21].spans} == {("1", 5, 40, 10), ("10", 5, 40, 10)}


def test_empty_tables_and_clean(spark):
    assert decontam.flagged(empty(spark), benchmark(spark, ITEMS)).count() == 0
    none = decontam.flagged(documents(spark, cases()), benchmark(spark, {})).collect()
    assert len(none) == len(cases()) and not any(r.contaminated or r.n_items for r in none)
    docs = documents(spark, cases())
    left = decontam.clean(docs, benchmark(spark, ITEMS))
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, v in brute(cases(), ITEMS).items() if not v[4]}


def test_documents_are_read_once_for_any_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 150)
    items = spark.createDataFrame([(k, words(k, 30)) for k in range(40)], "item_id long, text string")
    docs = documents(spark, {k: words(k, 60) for k in range(20)})
    plan = decontam.scan(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan

from collections import Counter, defaultdict

import numpy as np
import pytest

from dunlin.llm import ngram_join
from tests.llm.data import AWKWARD, documents, empty, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (len(sets[i]), top(i)) for i in ids}


def edited(text, at):
    w = text.split()
    for k in at:
        w[k] = f"new{k}"
    return " ".join(w)


def cases():
    out = dict(AWKWARD)
    base = words(1, 200)
    out |= {100 + k: edited(base, [k]) for k in range(20)}  # near copies of one text
    out |= {200 + k: edited(base, range(0, 15 * k, 15)) for k in range(1, 9)}  # ever farther: a chain
    chain = words(2, 150)
    for k in range(12):
        out[300 + k] = chain
        chain = edited(chain, [10 * k + 3, 10 * k + 4])
    passage = words(3, 60)
    out |= {400 + k: words(1000 + k, 30) + " " + passage for k in range(30)}  # share a passage, link seldom
    out |= {450 + k: passage + " " + words(2000 + k, 4) for k in range(10)}  # mostly the passage: all link
    out |= {500: "A b C d e", 501: "a B c D e", 502: "a b c d", 503: "A B C D", 504: "a b c d e f"}
    return out


def test_matches_all_pairs(spark):
    texts = cases()
    got = ngram_join.near_duplicates(documents(spark, texts, repeat=(4, 100)), 80).collect()
    assert len(got) == len(texts) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(texts)


def test_regions_beyond_one_node(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "NODE", 4)
    texts = {k: v for k, v in cases().items() if 100 <= k < 500}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents(spark, texts)).collect()}
    assert got == brute(texts)


def test_traversal_loses_no_linked_pair():
    sets = [np.array(sorted(hash(x) & 0xFFFFFFFFFF for x in shingle_set(t)), np.int64) for t in cases().values() if t and len(t) > 300]
    size = np.array([len(s) for s in sets])
    i, j = ngram_join.traverse(sets, size, sets, size, 80)
    found = set(zip(i.tolist(), j.tolist()))
    for a in range(len(sets)):
        for b in range(len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 80 * (size[a] + size[b] - both):
                assert (a, b) in found
    assert len(found) < len(sets) ** 2 / 2


def test_deduplicated_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, cases())
    left = ngram_join.deduplicated(docs)
    want = {c for _, c in brute(cases()).values()}
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == want


def test_empty(spark):
    assert ngram_join.near_duplicates(empty(spark)).count() == 0
    assert ngram_join.near_duplicates(documents(spark, {1: None, 2: ""})).count() == 2


def test_shared_tokens_counts_classes(spark):
    texts = {1: words(1, 40), 2: words(1, 40), 3: words(1, 40) + " x", 4: words(5, 30)}
    count = Counter(t for s in {shingle_set(t) for t in texts.values()} for t in s)
    got = defaultdict(int)
    for r in ngram_join.shared_tokens(documents(spark, texts)).collect():
        got[r.cid] += 1
        assert r.df == 2
    assert sorted(got.values()) == [sum(v > 1 for v in count.values())] * 2


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9])
def test_short_texts(spark, n):
    t = " ".join(f"q{k}" for k in range(n))
    r = {x.doc_id: x for x in ngram_join.document_sets(documents(spark, {1: t, 2: t.upper()}, parts=2)).collect()}
    assert r[1].n_shingles == max(1, n - 4) and r[1].cid == r[2].cid

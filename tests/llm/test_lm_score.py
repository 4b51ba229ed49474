import math
import zlib
from collections import Counter

import numpy as np

from dunlin.llm import lm_score as L
from dunlin.llm.words import Hasher, space_words
from tests.llm.data import AWKWARD, documents, empty, words


def tokens(t):
    return (t or "").encode().lower().split() + ["</s>"]


def test_block_recursion_equals_the_plain_forward():
    rng = np.random.default_rng(1)
    emit = rng.random((51, 3))
    m = L.Model(np.array([0.2, 0.5, 0.3]), rng.dirichlet(np.ones(3), 3), emit / emit.sum(0))
    n = np.array([1, 64, 65, 128, 700, 3, 1])
    obs = rng.integers(0, 51, n.sum())
    got = L.Recursion(m, obs, n).forward()
    at = 0
    want_counts, ll = np.zeros((51, 3)), 0.0
    for k, size in enumerate(n):
        o = obs[at: at + size]
        a = [m.pi * m.emit[o[0]]]
        for x in o[1:]:
            a.append((a[-1] @ m.step) * m.emit[x] * 20)  # plain rescaling
        assert abs(got[k] - (math.log(a[-1].sum()) - (size - 1) * math.log(20))) < 1e-8
        b = [np.ones(3)]
        for x in o[:0:-1]:
            b.append(m.step @ (m.emit[x] * 20 * b[-1]))
        for x, u, v in zip(o, a, b[::-1]):
            want_counts[x] += u * v / (u * v).sum()
        at += size
        ll += got[k]
    counts, xi, pi, total = L.Recursion(m, obs, n).expect()
    assert np.allclose(counts, want_counts) and abs(total - ll) < 1e-8
    assert abs(xi.sum() - (n - 1).sum()) < 1e-6 and abs(pi.sum() - len(n)) < 1e-9


def test_counts_base_score_and_fold(spark):
    texts = AWKWARD | {100 + k: words(k, 5 + k, 60 + 20 * (k % 3)) for k in range(80)}
    out = L.score(documents(spark, texts, repeat=(100, 1)), classes=64).collect()
    train = Counter()
    for i in [*texts, 100, 1]:
        if zlib.crc32(str(i).encode()) % 10:
            train.update(tokens(texts[i]))
    n, v = sum(train.values()), len(train)
    assert len(out) == len(texts) + 2
    for r in out:
        w = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(train[x] > 0 for x in w), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        want = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.score < 0


def test_words_beyond_the_sent_counts_are_joined(spark, monkeypatch):
    texts = {k: words(k, 30, 50) for k in range(30)}
    docs = documents(spark, texts)
    a = {r.doc_id: r for r in L.score(docs, classes=16).collect()}
    monkeypatch.setattr(L, "KNOWN_WORDS", 3)
    b = {r.doc_id: r for r in L.score(docs, classes=16).collect()}
    assert all(abs(a[i].base_score - b[i].base_score) < 1e-9 and a[i].n_known == b[i].n_known and abs(a[i].score - b[i].score) < 1e-6 for i in a)


def test_probabilities_of_a_class_sum_to_one():
    """With the share for unseen words, p(word | class) sums to one over a class's words."""
    c = np.array([5.0, 1.0, 0.0])
    assert abs(((c + 0.1) / (c.sum() + 0.1 * len(c))).sum() - 1) < 1e-12


def test_two_languages_score_better_than_the_base(spark):
    texts = {k: " ".join(f"{'ab'[k % 2]}{x}" for x in words(k, 60, 40).split()) for k in range(300)}
    out = [r for r in L.score(documents(spark, texts)).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out) > 0.15


def test_empty(spark):
    assert L.score(empty(spark)).count() == 0
    assert L.score(documents(spark, {1: None})).first().n_tokens == 1


def test_hash_is_the_words_alone():
    h = Hasher(space_words())
    one = h.words(np.frombuffer(b"ab cd ab", np.uint8), np.array([0, 8]))[0]
    two = h.words(np.frombuffer(b"xAB", np.uint8), np.array([0, 1, 3]))[0]
    assert one[0] == one[2] == two[1] != one[1]


def test_every_round_reads_all_training_texts(spark, monkeypatch):
    texts = {k: words(k, 40, 50) for k in range(40)}
    read, gains, of = [], [], L.expected_counts

    def spied(slices, model, classes):
        out = of(slices, model, classes)
        read.append(round(out[2].sum()))  # start counts: one for each text
        gains.append(out[3])
        return out

    monkeypatch.setattr(L, "expected_counts", spied)
    assert L.score(documents(spark, texts), classes=16).count() == len(texts)
    assert set(read) == {sum(zlib.crc32(str(i).encode()) % 10 > 0 for i in texts)}
    assert 2 <= len(read) <= L.MOST_ROUNDS and gains == sorted(gains)


def test_texts_side_by_side_equal_texts_in_blocks():
    rng = np.random.default_rng(5)
    emit = rng.random((201, 4))
    m = L.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), emit / emit.sum(0))
    n = np.array([1, 900, 3, 64, 65, 1, 300, 2])
    obs = rng.integers(0, 201, n.sum())
    want, logp = L.Recursion(m, obs, n).expect(), L.Recursion(m, obs, n).forward()
    steps, active, order = L.step_by_step(obs, n)
    assert np.allclose(L.SideBySide(m, steps, active).forward(), logp[order])
    for model, near in ((m, 1e-9), (m.single(), 1e-3)):
        got = L.SideBySide(model, steps, active).expect()
        assert all(np.allclose(a, b, rtol=near, atol=near) for a, b in zip(got, want))
    assert np.allclose(L.log_likelihood(m, obs, n), logp)


def test_long_texts_wait_for_one_another(spark, monkeypatch):
    monkeypatch.setattr(L, "LONG", 20)
    monkeypatch.setattr(L, "POOL", 300)
    monkeypatch.setattr(L, "LONGEST", 120)
    texts = {k: words(k, n, 60) for k, n in enumerate([5, 30, 19, 20, 21, 200, 119, 120, 121, 60, 70, 80, 90, 1, 0, 400])}
    df = documents(spark, texts, parts=1)
    rows = L.class_numbers(df, 64).collect()
    got = sum(int(np.frombuffer(r.active, "<i4")[:1].sum()) + len(r.long_n) // 4 for r in rows)
    assert got == len(texts) and sum(len(r.obs) // 2 + len(r.long_obs) // 2 for r in rows) == sum(len((t or "").split()) + 1 for t in texts.values())
    m = L.Model.start(np.ones(65), 4)
    counts, xi, pi, ll = L.expected_counts(L.class_numbers(df, 64), m, 64)
    assert round(pi.sum()) == len(texts) and abs(counts.sum() - sum(len(t.split()) + 1 for t in texts.values())) < 1e-2

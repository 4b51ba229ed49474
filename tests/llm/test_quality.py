import random
import zlib

import numpy as np

from dunlin.llm import quality
from tests.llm.data import AWKWARD, documents, empty, words


def texts():
    rnd = random.Random(2)
    good = {1000 + k: ". ".join(words(rnd.randrange(10**6), rnd.randrange(6, 20)).capitalize() for _ in range(rnd.randrange(2, 9))) + "." for k in range(150)}
    bad = {2000 + k: rnd.choice([lambda: words(k, 40).upper().replace(" ", "!! "), lambda: "same " * 80, lambda: words(k, 30).replace(" ", " | "),
                                 lambda: words(k, 40).replace(" ", "$$$ ")])() for k in range(90)}
    return good, bad


def labels(spark, good, bad, other=()):
    rows = [(i, 1, 0, "a") for i in good] + [(i, 0, 0, "b") for i in bad] + list(other)
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, f string")


def test_held_out_accuracy_and_awkward_rows(spark):
    good, bad = texts()
    docs = documents(spark, AWKWARD | good | bad, repeat=(1, 1000))
    out = quality.classify(docs, labels(spark, good, bad, [(None, 1, 0, ""), (5, None, 0, ""), (1000, 1, 1, "")])).collect()
    assert len(out) == len(AWKWARD) + len(good) + len(bad) + 2
    held = [r for r in out if r.held_out and r.doc_id >= 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 < r.score < 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == int(r.doc_id < 2000) for r in held) >= 0.95 * len(held) and len(held) > 20


def test_held_out_labels_change_nothing(spark):
    good, bad = texts()
    docs = documents(spark, good | bad)
    held = {i for i in good | bad if zlib.crc32(str(i).encode()) % 5 == 0}
    a = {r.doc_id: r.score for r in quality.classify(docs, labels(spark, good, bad)).collect()}
    flipped = labels(spark, [i for i in good if i not in held] + [i for i in bad if i in held], [i for i in bad if i not in held] + [i for i in good if i in held])
    b = {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_moments_and_density(spark):
    rng = np.random.default_rng(0)
    x = {0: rng.normal(size=(50, 3)), 1: rng.normal(size=(40, 3)) * 2 + 1}
    stats = {k: (float(len(v)), v.sum(0), v.T @ v) for k, v in x.items()}
    m = quality.Discriminant(stats, 3)
    z = rng.normal(size=(5, 3))
    every = np.concatenate([x[0], x[1]])
    mean, scale = every.mean(0), every.std(0)
    cov = {k: np.cov(((v - mean) / scale).T, bias=True) for k, v in x.items()}
    pooled = np.diag((50 * np.diag(cov[0]) + 40 * np.diag(cov[1])) / 90)
    odds = np.log(41 / 51) * np.ones(5)
    for k, sign in ((0, -1), (1, 1)):
        c = 0.9 * cov[k] + 0.1 * pooled + 1e-3 * np.eye(3)
        d = (z - mean) / scale - ((x[k] - mean) / scale).mean(0)
        odds += sign * -0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.log(np.linalg.det(c)))
    assert np.allclose(m.scores(z), 1 / (1 + np.exp(-odds)))


def test_without_labels_and_empty(spark):
    good, bad = texts()
    out = quality.classify(documents(spark, AWKWARD), labels(spark, {}, {})).collect()
    assert len(out) == len(AWKWARD) and {r.score for r in out} == {0.5}
    assert quality.classify(empty(spark), labels(spark, good, bad)).count() == 0
    docs = documents(spark, good | bad)
    left = quality.kept(docs, labels(spark, good, bad))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and len(ids & set(good)) > 0.97 * len(good) and len(ids & set(bad)) < 0.1 * len(bad)

import numpy as np
import pytest

from dunlin.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 0.0, 1) for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and len(v) and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in ok:
        if q % every == 0:
            out[q] = sorted((-float(v @ u), i) for i, u in ok if i != q and len(u) == len(v))[:k]
    return out


def recall(got, want):
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in w}) for q, w in want.items())
    return hits / sum(len(w) for w in want.values())


def test_recall_order_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 300)
    monkeypatch.setattr(ann, "BLOCK", 20)
    rng = np.random.default_rng(0)
    rows = [(i, v * s) for i, (v, s) in enumerate(zip(rng.normal(size=(900, 24)), rng.uniform(0.5, 2, 900)))]
    got, want = ann.nearest(table(spark, rows)).collect(), brute(rows)
    assert recall(got, want) > 0.95
    vec = {i: v.astype(np.float32).astype(float) for i, v in rows}
    for q in want:
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and q not in {r.vec_id for r in own}
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - vec[q] @ vec[r.vec_id]) < 1e-9 for r in own)


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8)) for i in range(60)]
    rows += [(100 + i, rows[20][1]) for i in range(50)]  # many copies of a query
    rows += [(200, None), (220, [0.0] * 8), (240, [1.0, None] * 4), (260, [float("nan")] * 8), (280, [float("inf")] + [0.0] * 7), (300, [])]
    rows += [(400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, [3.0])]  # other lengths
    want = brute(rows)
    got = ann.nearest(table(spark, rows + rows[20:22])).collect()
    assert {r.query_id for r in got} == {q for q, w in want.items() if w}
    for q, w in want.items():
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in w], q


def test_empty_and_no_queries(spark):
    assert ann.nearest(table(spark, [])).count() == 0
    assert ann.nearest(table(spark, [(1, [1.0, 2.0]), (3, [2.0, 1.0])])).count() == 0


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1.5], [-3, 0]], np.float32)
    got = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 1, 0]]), 1.0, 3)
    assert got.tolist() == [[1, 3, 4]]


@pytest.mark.parametrize("factor", [1e-20, 1e4, 1e20])
def test_one_norm_of_another_size(spark, monkeypatch, factor):
    monkeypatch.setattr(ann, "SMALL", 0)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    x[7] *= factor
    rows = [(i, v) for i, v in enumerate(x)]
    got, want = ann.nearest(table(spark, rows)).collect(), brute(rows)
    assert recall(got, want) >= 0.95 and all(sum(r.query_id == q for r in got) == 20 for q in want)


def test_norms_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 200)
    rng = np.random.default_rng(3)
    rows = [(i, v * 10.0 ** rng.uniform(-18, 18)) for i, v in enumerate(rng.normal(size=(400, 8)))]
    got, want = ann.nearest(table(spark, rows)).collect(), brute(rows)
    assert recall(got, want) >= 0.95 and all(sum(r.query_id == q for r in got) == 20 for q in want)


def test_fewer_classes_than_the_beam(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4)) for i in range(12)] + [(20 + i, [1.0, 0, 0, 0]) for i in range(3)]
    got, want = ann.nearest(table(spark, rows)).collect(), brute(rows)
    assert {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in want} == {q: [i for _, i in w] for q, w in want.items()}


@pytest.mark.parametrize("kind", ["normal", "many lengths", "yes and no", "one direction"])
def test_recall_on_vectors_without_groups(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6000, 64))
    if kind == "many lengths":
        x *= np.exp(rng.normal(size=(6000, 1)) / 2)
    elif kind == "yes and no":
        x = (rng.random((6000, 64)) < 0.3) + 1e-6 * rng.random((6000, 64))
    elif kind == "one direction":
        x = 5 + x / 20
    rows = list(enumerate(x))
    assert recall(ann.nearest(table(spark, rows)).collect(), brute(rows)) >= 0.95

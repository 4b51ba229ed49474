import hashlib
import math
import random

import numpy as np
import pytest

from dunlin.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, distance long, x string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, "y") for i, v in rows], SCHEMA).repartition(parts)


def brute(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(1 << 27), min(1 << 27, math.floor(1024 * float(np.float32(x))))) for x in v]))
    name = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    m = [v for _, v in sorted(((name(i), v) for i, v in kept))[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min((dist(v, c), n) for n, c in enumerate(m))
    for _ in range(rounds):
        own = [[] for _ in m]
        for _, v in kept:
            own[near(v)[1]].append(v)
        m = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, m)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    cost = [sum(d for _, c, d in got if c == n) for n in range(len(m))]
    return sorted(((i, c, d, cost[c], sum(cost), hashlib.sha256(",".join(map(str, m[c])).encode()).hexdigest()) for i, c, d in got), key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(seed, n, around=5, noise=0.05):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (around, 64))
    return [(int(k), (middle[rng.integers(around)] + rng.normal(0, noise, 64)).astype(np.float32).tolist()) for k in range(n)]


def awkward():
    one = [0.1] * 64
    return [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None] + [0.5] * 63), (905, [float("nan")] + [0.5] * 63),
            (906, [float("inf")] * 64), (907, [0.0] * 64), (908, [-0.0] * 64), (909, one), (909, one), (None, one), (None, [0.2] * 64), (910, [1e4] + [0.0] * 63)]


def test_against_brute_force(spark):
    rows = cloud(1, 400) + awkward()
    assert result(C.cluster(table(spark, rows))) == brute(rows)


def test_ties_copies_and_fewer_rows_than_clusters(spark):
    same = [(k, [0.25] * 64) for k in range(300)] + [(1000 + k, [0.25 * (k % 3)] * 64) for k in range(30)]
    assert result(C.cluster(table(spark, same))) == brute(same)
    few = cloud(2, 3)
    assert result(C.cluster(table(spark, few))) == brute(few)


def test_components_of_any_size(spark):
    rows = cloud(3, 40) + [(500, [3e38] * 64), (501, [-3e38] * 64), (502, [1e9] + [0.0] * 63)]
    got = {r.vec_id: r for r in C.cluster(table(spark, rows)).collect()}
    assert len(got) == 43 and all(0 <= r.distance < 1 << 63 for r in got.values())
    assert result(C.cluster(table(spark, rows))) == brute(rows)


def test_empty(spark):
    assert C.cluster(table(spark, [])).count() == 0
    assert C.cluster(table(spark, [(1, None), (2, [1.0])])).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_neighbouring_cells(n, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = [k.tobytes() for k in C.hilbert(cells, bits)]
    assert len(set(keys)) == len(keys)
    walk = cells[sorted(range(len(keys)), key=keys.__getitem__)]
    assert (abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_box_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(300):
        dim = int(rng.integers(1, 6))
        x = rng.integers(-20, 20, (int(rng.integers(1, 9)), dim)) + rng.integers(-60, 60, dim)
        m = rng.integers(-80, 80, (int(rng.integers(1, 9)), dim))
        among = C.candidates(x.min(0), x.max(0), m)
        d = ((x[:, None] - m[None]) ** 2).sum(2)
        number, least = C.nearest(x, m, among)
        assert (number == d.argmin(1)).all() and (least == d.min(1)).all()


def test_boxes_spare_comparisons(spark):
    rows = cloud(5, 3000, around=8, noise=0.01)
    good = C.usable(table(spark, rows))
    n, mean, deviation = C.spread(good, 64, C.SCALE)
    blocks = C.zone_maps(good, mean, deviation).cache()
    assert n == 3000 and sum(len(r.ids) for r in blocks.collect()) == 3000 and max(len(r.ids) for r in blocks.collect()) <= C.BLOCK
    middles = np.array([np.floor(1024 * np.array(v)) for _, v in rows[:8]]).astype(np.int64)
    compared = sum(t[3] for t in C.totals(blocks, middles).values())
    blocks.unpersist()
    assert compared < 0.7 * 8 * 3000

"""Centroid clustering (Lloyd's rounds on integer vectors) over Hilbert-ordered zone maps.

Vectors are dealt and sorted along a Hilbert curve, so that vectors near one another share a
block; a block keeps the least and the greatest value of each component (its
box).  In a round a block asks its box first: a centroid whose least possible
distance exceeds another's greatest possible distance can be nearest to no vector of the
block.  The centroids left are its candidates, and only they are compared with its
vectors, exactly, in whole numbers.  Blocks are written once to the shared folder; a round
reads them and combines counts and sums by cluster, in tasks and then in Spark.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import column, shared_dir, stored

DIM, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
BLOCK = 256  # vectors of a block
CELLS = 4  # bits of a component on the curve
LARGEST = 1 << 27  # of a scaled component, so that a squared distance of 64 components is a long

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def hilbert(cells: np.ndarray, bits: int = CELLS) -> np.ndarray:
    """(m, bytes) places of the rows of (m, n) cell numbers below 2 ** bits on the n-dimensional Hilbert curve, as bytes that sort alike.

    Skilling's transform (AIP Conference Proceedings 707, 2004), all rows at once.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) > 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    place = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).reshape(bits * n, -1)
    return np.packbits(place.T.astype(np.uint8), axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the centroids that can be nearest to a vector within the box (ties included)."""
    least = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(1)
    greatest = (np.maximum(abs(centroids - low), abs(high - centroids)) ** 2).sum(1)
    return np.flatnonzero(least <= greatest.min())


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid out of ``among`` and the squared distance, of each vector; ties to the smaller number."""
    d = np.stack([((vectors - centroids[c]) ** 2).sum(1) for c in among])
    best = d.argmin(0)
    return among[best], d[best, np.arange(len(vectors))]


def usable(table: DataFrame, vec: str = "embedding", dim: int = DIM) -> DataFrame:
    """vec_id and v (array<double>) of the rows with exactly ``dim`` components, none null or non-finite."""
    ok = F.forall(table[vec], lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.where(F.coalesce((F.size(table[vec]) == dim) & ok, F.lit(False)))
    return rows.select(table["vec_id"].cast("long").alias("vec_id"), table[vec].cast("array<double>").alias("v"))


def _matrix(col: pa.Array) -> np.ndarray:
    """(rows, length) array of a list column whose lists are all of one length."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _scaled(v: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(v * scale), -LARGEST, LARGEST).astype(np.int64)


def spread(rows: DataFrame, dim: int, scale: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, and the mean and standard deviation of each scaled component; only sums leave the tasks."""
    def add(batches):
        n, s, ss = 0, np.zeros(dim), np.zeros(dim)
        for b in batches:
            if b.num_rows:
                x = _scaled(_matrix(column(b, "v")), scale).astype(float)
                n, s, ss = n + len(x), s + x.sum(0), ss + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, n)), pa.array(np.arange(dim)), pa.array(s), pa.array(ss)], ["n", "i", "s", "ss"])

    got = rows.select("v").mapInArrow(add, "n long, i long, s double, ss double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    got = sorted(got.collect())
    n = got[0].n if got else 0
    mean = np.array([r.s for r in got]) / max(n, 1)
    return n, mean, np.sqrt(np.maximum(np.array([r.ss for r in got]) / max(n, 1) - mean * mean, 0))


def zone_maps(rows: DataFrame, mean: np.ndarray, deviation: np.ndarray, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """ids, body (the scaled vectors as 4-byte integers), low, high of each block of ``rows`` (vec_id, v).

    The curve runs through cells of a fixed number of standard deviations around the mean,
    components of larger spread first; values beyond lie in the outermost cells.  Rows are dealt to ranges
    of the curve and, on one place of it, of vec_id: a vector in a third of all rows fills many ranges.
    """
    by = np.argsort(-deviation, kind="stable")
    low, width = (mean - 2 * deviation)[by], np.maximum(deviation * 4, 1)[by]
    cells = 1 << CELLS

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _scaled(_matrix(column(b, "v")), scale)
            cell = np.clip((x[:, by] - low) / width * cells, 0, cells - 1).astype(np.int64)
            key = hilbert(cell)
            yield pa.RecordBatch.from_arrays(
                [column(b, "vec_id"), pa.array([r.tobytes() for r in x.astype("<i4")], pa.binary()), pa.array([k.tobytes() for k in key], pa.binary())], ["vec_id", "x", "place"])

    def cut(batches):
        ids, body = [], []

        def emit(final: bool):
            nonlocal ids, body
            while len(ids) >= block or (final and ids):
                x = np.frombuffer(b"".join(body[:block]), "<i4").reshape(min(block, len(ids)), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[:block]], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()),
                     pa.array([x.min(0)], pa.list_(pa.int32())), pa.array([x.max(0)], pa.list_(pa.int32()))], ["ids", "body", "low", "high"])
                ids, body = ids[block:], body[block:]

        for b in batches:
            ids += column(b, "vec_id").to_pylist()
            body += column(b, "x").to_pylist()
            yield from emit(False)
        yield from emit(True)

    placed = rows.select("vec_id", "v").mapInArrow(place, "vec_id long, x binary, place binary")
    dealt = placed.repartitionByRange("place", "vec_id", "x").sortWithinPartitions("place", "vec_id", "x")
    return dealt.select("vec_id", "x").mapInArrow(cut, "ids array<long>, body binary, low array<int>, high array<int>")


def _blocks(batch: pa.RecordBatch):
    """ids, vectors, low, high of each block."""
    for i in range(batch.num_rows):
        ids = column(batch, "ids")[i].values
        yield ids, np.frombuffer(column(batch, "body")[i].as_py(), "<i4").reshape(len(ids), -1).astype(np.int64), *(
            column(batch, c)[i].values.to_numpy().astype(np.int64) for c in ("low", "high"))


def totals(blocks: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int], int]]:
    """Per cluster that has vectors: their number, their summed distance, their sums by component, and how many distances were computed.

    Tasks hand on one row for each cluster; sums are decimals, so they are exact at any number of rows.
    """
    k, dim = centroids.shape

    def add(batches):
        n, cost, sums, compared = np.zeros(k, np.int64), [0] * k, [[0] * dim for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            for _, x, low, high in _blocks(batch):
                among = candidates(low, high, centroids)
                compared[among] += len(x)
                cluster, d = nearest(x, centroids, among)
                for c in np.unique(cluster):
                    own = cluster == c
                    n[c] += own.sum()
                    cost[c] += sum(d[own].tolist())
                    sums[c] = [a + int(b) for a, b in zip(sums[c], x[own].sum(0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype=np.int32)), pa.array(n), pa.array([str(c) for c in cost]), pa.array(compared), pa.array(sums, pa.list_(pa.int64()))],
            ["cluster", "n", "cost", "compared", "sums"])

    got = blocks.select("ids", "body", "low", "high").mapInArrow(add, "cluster int, n long, cost string, compared long, sums array<long>")
    got = got.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("cost").cast("decimal(38,0)")).alias("cost"), F.sum("compared").alias("compared"),
                                     *(F.sum(F.col("sums")[i].cast("decimal(28,0)")).alias(f"s{i}") for i in range(dim)))
    return {r.cluster: (r.n, int(r.cost), [int(r[f"s{i}"]) for i in range(dim)], r.compared) for r in got.collect() if r.n or r.compared}


def seeds(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The scaled vectors with the smallest sha256(seed:vec_id); of equal ids the smaller vector first, a null id is written as nothing."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.withColumn("h", named).orderBy("h", "v").limit(clusters).collect()
    return _scaled(np.array([r.v for r in first]), scale) if first else np.zeros((0, 0), np.int64)


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, vec: str = "embedding", dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row (see :func:`usable`).

    Components become floor(scale * x) (at most 2 ** 27 in size: a greater one counts as 2 ** 27, so that distances are
    longs).  Centroids start as the vectors of :func:`seeds`; with fewer rows than clusters there are as many centroids as rows.
    A round gives every vector its nearest centroid and moves each centroid that has vectors to the floor of their mean;
    rounds end early when no centroid moves, as all later ones would be the same.  A last assignment follows.  Repeated
    rows count each; an empty table gives an empty result; an inertia beyond a long is null.
    """
    spark = table.sparkSession
    rows = usable(table, vec, dim)
    n, mean, deviation = spread(rows, dim, scale)
    if not n:
        return spark.createDataFrame([], RESULT)
    blocks = stored(zone_maps(rows, mean, deviation, scale), f"{shared_dir(spark)}/blocks")
    centroids = seeds(rows, clusters, seed, scale)
    for _ in range(rounds):
        moved = centroids.copy()
        for c, (m, _, sums, _) in totals(blocks, centroids).items():
            if m:
                moved[c] = [s // m for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    cost = {c: t[1] for c, t in totals(blocks, centroids).items()}
    longs = [x if x < 1 << 63 else None for x in [*(cost.get(c, 0) for c in range(len(centroids))), sum(cost.values())]]
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def assign(batches):
        own, digest = pa.array(longs[:-1], pa.int64()), pa.array(names)
        for batch in batches:
            for ids, x, low, high in _blocks(batch):
                number, d = nearest(x, centroids, candidates(low, high, centroids))
                at = pa.array(number)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(number.astype(np.int32)), pa.array(d), own.take(at), pa.array([longs[-1]] * len(x), pa.int64()), digest.take(at)],
                    ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return blocks.select("ids", "body", "low", "high").mapInArrow(assign, RESULT)

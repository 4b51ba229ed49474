"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Equal vectors form a class and are indexed once.  Classes are dealt to shards of
bounded size by the size of their norm (a factor of 2^(1/16)) and a hash.  In a shard, greedy searches propose neighbours for every
node, and relaxed distance pruning keeps diverse edges (two rounds, the second with a
larger relaxation); the graph is stored.  Queries visit every shard in blocks of bounded
size; a beam search walks the shard's graph from nodes far apart, and the best of all shards are merged.

Nearness is the inner product.  Graphs are built on the vectors over M, the shard's largest norm, with one more
coordinate, sqrt(1 - |x/M|^2), which turns it into a Euclidean distance.  Bands are narrow, so that this coordinate
stays small: where it is large, neighbours in the graph are not those of queries.  A query's beam is longer than the
builder's.  What the beam found is ranked by the inner products of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlin.llm.shared import shared_dir, stored

SHARD = 16384  # classes of a shard
BLOCK = 16384  # queries that visit a shard together
SMALL = 256  # classes of a shard that are all compared
DEGREE, BEAM, WIDTH = 24, 64, 4  # edges of a node, length of the builder's beam, nodes expanded together
QUERY_BEAM, QUERY_WIDTH = 256, 16  # of a query
BANDS, ENTRIES = 16, 32  # bands of norms to a factor of two, nodes where searches start
RELAX = (1.0, 1.2)


def search(x: np.ndarray, graph: np.ndarray, start: np.ndarray, queries: np.ndarray, beam: int = BEAM, width: int = WIDTH):
    """(m, beam) node numbers and squared distances (nearest first; -1 and inf where there are fewer), walking from
    the nodes ``start``, of which there are no more than ``beam``."""
    m, n = len(queries), len(x)
    ids = np.full((m, beam), -1, np.int64)
    dist = np.full((m, beam), np.inf, np.float32)
    open_ = np.zeros((m, beam), bool)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # stands for a missing edge
    norm, qn = (x * x).sum(1), (queries * queries).sum(1)
    first = norm[start] + qn[:, None] - 2 * queries @ x[start].T
    order = np.argsort(first, 1, kind="stable")
    ids[:, : len(start)], open_[:, : len(start)], seen[:, start] = start[order], True, True
    dist[:, : len(start)] = np.take_along_axis(first, order, 1)
    rows = np.arange(m)[:, None]
    while True:
        live = open_.any(1)
        if not live.any():
            return ids, dist
        r = np.flatnonzero(live)
        pick = np.argsort(~open_[r], axis=1, kind="stable")[:, :width]
        nodes = np.where(np.take_along_axis(open_[r], pick, 1), np.take_along_axis(ids[r], pick, 1), -1)
        op = open_[r]
        np.put_along_axis(op, pick, False, 1)
        new = np.where((nodes >= 0)[:, :, None], graph[nodes], -1).reshape(len(r), -1)
        new = np.sort(np.where(new < 0, n, new), 1)
        fresh = ~seen[r[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[r[:, None], new] = True
        at = np.minimum(new, n - 1)
        d = norm[at] + qn[r][:, None] - 2 * np.einsum("mkd,md->mk", x[at], queries[r])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[r], d], 1)
        all_i = np.concatenate([ids[r], np.where(fresh, new, -1)], 1)
        all_o = np.concatenate([op, fresh], 1)
        best = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[r], ids[r], open_[r] = (np.take_along_axis(a, best, 1) for a in (all_d, all_i, all_o))
        open_[r] &= ids[r] >= 0


def robust_prune(x: np.ndarray, node: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """(m, degree) neighbours of ``node`` out of ``cand`` (-1: none): nearest first, dropping those that a chosen one is closer to by ``alpha``."""
    out = np.full((len(node), degree), -1, np.int64)
    for a in range(0, len(node), 256):
        p, c = node[a: a + 256], cand[a: a + 256]
        c = np.sort(c, 1)
        bad = (c < 0) | (c == p[:, None])
        bad[:, 1:] |= c[:, 1:] == c[:, :-1]
        v = x[np.maximum(c, 0)]
        d = np.where(bad, np.inf, ((v - x[p][:, None]) ** 2).sum(2))
        order = np.argsort(d, 1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
        v = x[np.maximum(c, 0)]
        sq = (v * v).sum(2)
        between = sq[:, :, None] + sq[:, None] - 2 * v @ v.transpose(0, 2, 1)
        alive, count = np.isfinite(d), np.zeros(len(p), np.int64)
        for i in range(c.shape[1]):
            take = np.flatnonzero(alive[:, i] & (count < degree))
            if not len(take):
                continue
            out[a + take, count[take]] = c[take, i]
            count[take] += 1
            alive[take] &= alpha * alpha * between[take, i] > d[take]
    return out


def entries(x: np.ndarray, many: int = ENTRIES) -> np.ndarray:
    """The row nearest to the mean, then each time the row farthest from those before, so groups apart from the others have one too."""
    out = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[out[0]]) ** 2).sum(1)
    while len(out) < min(many, len(x)):
        out.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
        far[out] = -1
    return np.array(out)


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(n, degree) graph over the rows of x and the nodes where searches start."""
    n = len(x)
    rng = np.random.default_rng(7)
    start = entries(x)
    graph = rng.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = -1
    for alpha in RELAX:
        order = rng.permutation(n)
        for a in range(0, n, 512):
            p = order[a: a + 512]
            found, _ = search(x, graph, start, x[p], beam)
            graph[p] = robust_prune(x, p, np.concatenate([found, graph[p]], 1), alpha, degree)
            # edges back; a node with too many is pruned anew
            src, dst = np.repeat(p, degree), graph[p].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, many = np.unique(dst, return_index=True, return_counts=True)
            wide = int(many.max(initial=0))
            back = np.full((len(to), wide), -1, np.int64)
            back[np.repeat(np.arange(len(to)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
            both = np.concatenate([graph[to], back], 1)
            both = np.sort(both, 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            both = -np.sort(-both, 1)
            fits = (both >= 0).sum(1) <= degree
            graph[to[fits]] = both[fits][:, :degree]
            if (~fits).any():
                graph[to[~fits]] = robust_prune(x, to[~fits], both[~fits], alpha, degree)
    return graph, start


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors over their largest component, then over their norm: no square overflows or vanishes."""
    v = v / abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def lifted(v: np.ndarray) -> np.ndarray:
    """Vectors over the largest norm, with the coordinate that makes the inner product a distance."""
    v = v / abs(v).max()
    sq = (v * v).sum(1)
    most = sq.max()
    return np.concatenate([v / np.sqrt(most), np.sqrt(np.maximum(1 - sq / most, 0))[:, None]], 1).astype(np.float32)


def band(v):
    """floor(BANDS * log2) of the norm: vectors of a band differ by less than a factor of 2^(1/BANDS) in length."""
    most = F.array_max(F.transform(v, F.abs))
    part = F.aggregate(v, F.lit(0.0), lambda a, c: a + (c / most) * (c / most))
    return F.floor((F.log2(most) + F.log2(part) / 2) * BANDS).cast("int")


def _vectors(col) -> np.ndarray:
    return np.array(col.to_pylist(), np.float64)


def usable(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is not null, not empty, not all zero, and has no null or non-finite component."""
    ok = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return table.where(F.col(vec).isNotNull() & F.col("vec_id").isNotNull()).where(F.coalesce(ok, F.lit(False)) & F.exists(vec, lambda c: c != 0))


def nearest(table: DataFrame, k: int = 20, every: int = 20, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row whose vec_id ``every`` divides, the k nearest other rows found.

    Nearest first, ties to the smaller vec_id; all others if there are fewer than k.  Unusable vectors (see
    :func:`usable`) neither ask nor answer; vectors of another length never meet.  Rows with equal vec_id and vector count once.
    Every row is indexed.  Norms may be of any size: scores beyond a double's range (components of about 1e150) do not count as found.  Of a class of equal vectors the k + 1 smallest vec_ids are kept as answers,
    as no query can return more.
    """
    spark = table.sparkSession
    folder = shared_dir(spark)
    rows = usable(table, vec).select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one component; the class key is two hashes of the components
    rows = rows.withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumn("c1", F.xxhash64("v")).withColumn(
        "c2", F.xxhash64(F.lit(1), "v")).withColumn("dim", F.size("v")).withColumn("band", band("v"))
    rows = stored(rows, f"{folder}/rows")
    classes = rows.groupBy("dim", "c1", "c2").agg(F.min("vec_id").alias("cid"), F.first("band").alias("band"))
    # a row for each length that occurs and each band of norms, of which doubles have 35,000
    shards = classes.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    shards = stored(shards, f"{folder}/shards")
    part = F.pmod(F.xxhash64(F.lit(3), "c1", "c2"), F.col("parts")).cast("int")
    classes = classes.join(F.broadcast(shards), ["dim", "band"]).withColumn("shard", F.struct("band", part.alias("part"))).drop("band", "parts")
    classes = stored(classes, f"{folder}/classes")
    w = Window.partitionBy("c1", "c2").orderBy("vec_id")
    answers = rows.select("dim", "c1", "c2", "vec_id").distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k + 1)
    answers = answers.join(classes.select("dim", "c1", "c2", "cid"), ["dim", "c1", "c2"]).select("cid", "vec_id")
    firsts = rows.join(classes, ["dim", "c1", "c2"]).where("vec_id = cid").dropDuplicates(["dim", "c1", "c2"]).select("dim", "shard", "cid", "v")

    def index(table: pa.Table) -> pa.Table:
        cid = table.column("cid").to_numpy()
        order = np.argsort(cid)
        table = table.take(pa.array(order))
        graph, start = build(lifted(_vectors(table.column("v"))))
        return table.append_column("edges", pa.array(list(graph.astype(np.int32)), pa.list_(pa.int32()))).append_column(
            "start", pa.array(np.isin(np.arange(len(cid)), start))).select(["dim", "shard", "cid", "v", "edges", "start"])

    graphs = stored(firsts.groupBy("dim", "shard").applyInArrow(
        index, "dim int, shard struct<band: int, part: int>, cid long, v array<double>, edges array<int>, start boolean"), f"{folder}/graphs")
    queries = rows.where(F.col("vec_id") % every == 0).select("dim", "vec_id", "v").dropDuplicates(["vec_id", "v"])
    asked = {r.dim: r.n for r in queries.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    blocks = F.create_map(*(x for d, n in asked.items() for x in (F.lit(d), F.lit(-(-n // BLOCK)))))
    every_shard = shards.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("dim", F.struct("band", "part").alias("shard"))
    visits = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks[F.col("dim")]).cast("int")).join(F.broadcast(every_shard), "dim")
    copies = graphs.where(F.col("dim").isin(list(asked))).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("dim")] - 1)))

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        right = right.take(pa.array(np.argsort(right.column("cid").to_numpy())))
        v, cid = _vectors(right.column("v")), right.column("cid").to_numpy()
        x = lifted(v)
        graph = np.array(right.column("edges").to_pylist(), np.int64)
        start = np.flatnonzero(right.column("start").to_numpy(zero_copy_only=False))
        qid, q = left.column("vec_id").to_numpy(), _vectors(left.column("v"))
        out = []
        for a in range(0, len(q), 512):
            part = q[a: a + 512]
            if len(x) <= SMALL:
                ids = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
            else:
                ids, _ = search(x, graph, start, np.concatenate([unit(part), np.zeros((len(part), 1))], 1).astype(np.float32), QUERY_BEAM, QUERY_WIDTH)
            score = np.einsum("mkd,md->mk", v[np.maximum(ids, 0)], part)
            score[ids < 0] = -np.inf
            names = cid[np.maximum(ids, 0)]
            best = np.lexsort((names, -score), axis=1)[:, : k + 1]
            score, names = np.take_along_axis(score, best, 1), np.take_along_axis(names, best, 1)
            ok = np.isfinite(score)
            out.append((np.repeat(qid[a: a + 512], ok.sum(1)), names[ok], score[ok]))
        return pa.table({"query_id": np.concatenate([o[0] for o in out]), "cid": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})

    keys = ["dim", "shard", "block"]
    found = visits.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(walk, "query_id long, cid long, score double")
    # the k + 1 best classes of a query hold its k nearest rows
    top = Window.partitionBy("query_id").orderBy(F.desc("score"), "cid")
    found = found.withColumn("nth", F.row_number().over(top)).where(F.col("nth") <= k + 1).select("query_id", "cid", "score")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    full = found.join(answers, "cid").where("vec_id <> query_id").withColumn("rank", F.row_number().over(final))
    return full.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

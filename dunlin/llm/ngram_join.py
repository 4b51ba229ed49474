"""N-gram Jaccard self-join by signature trees.

Sets are distinct 5-word shingles (hashed to 54 bits; 40 bits and the shuffle
part, about 46 bits at least, in the join).  Texts of one set form a class.

1. Tokens go to parts by hash, packed; a part knows every class that holds a
   token, so it counts them.  Only tokens of two classes or more come back.
2. A class keeps its rows if those tokens can make up 80 % of it; else nothing
   can link with it.
3. Rarest tokens first, two linked classes share one of the first
   m - ceil(0.8 n) + 1.  Each such token is a block; blocks of equal membership
   count once.
4. A block first compares its members with its most central one (its tokens
   occur most often): a crowd of near copies becomes a component without pairs.
5. What is left are regions (blocks that overlap) of several components.  Their
   members form tree nodes of bounded size; node pairs inside one component, or
   that sizes or OR-combined bitmaps rule out, are dropped; each other pair is
   one group in which two trees are traversed together down to exact checks.

Components then join the edges of 4 and 5.  No step emits all pairs of a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlin.llm.components import components
from dunlin.llm.shared import column, row_key, shared_dir, slices, stored, text_buffer
from dunlin.llm.words import Hasher, U, mix, shingles, space_words

GROUP_BYTES = 1 << 23  # text whose tokens a task holds at once
NODE = 128  # members of a tree node that are shipped together
LEAF = 4  # sets below a leaf of a tree in a task, and children of an inner node
BITS = 2048  # bits of a signature


def _sets(batches, k: int):
    """Per group of slices (about 8 MB of text) of each batch: batch, first row, rows, sizes,
    class ids, row of each token (from the group's first), tokens."""
    hasher = Hasher(space_words())
    for batch in batches:
        data, offs = text_buffer(column(batch, "text"))
        for first, stop in slices(offs, GROUP_BYTES, 1 << 30):
            parts = []
            for a, b in slices(offs[first: stop + 1] - offs[first]):
                a, b = a + first, b + first
                h, rows, _, _ = hasher.words(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                r, tok = shingles(h, rows, b - a, k)
                n = np.bincount(r, minlength=b - a)
                acc = np.concatenate([np.zeros(1, U), np.cumsum(mix(tok.astype(U) + U(1)), dtype=U)])
                cut = np.concatenate([[0], np.cumsum(n)])
                cid = mix(acc[cut[1:]] - acc[cut[:-1]] + n.astype(U)).view(np.int64)
                parts.append((n, cid, r + a - first, tok))
            yield (batch, first, stop - first, *(np.concatenate([p[i] for p in parts]) for i in range(4)))


def document_sets(docs: DataFrame, k: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, cid) of every row, and its string columns ``carry``; cid is the class of equal sets, null for an empty set."""

    def run(batches):
        for batch, first, rows, n, cid, _, _ in _sets(batches, k):
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()).slice(first, rows), pa.array(n, pa.int64()), pa.array(cid, pa.int64(), mask=n == 0),
                 *(column(batch, c).slice(first, rows) for c in carry)],
                ["doc_id", "n_shingles", "cid", *carry])

    return docs.select("doc_id", "text", *carry).mapInArrow(run, "doc_id long, n_shingles long, cid long" + "".join(f", {c} string" for c in carry))


def shared_tokens(docs: DataFrame, k: int = 5) -> DataFrame:
    """(cid, n, tok, df): tokens that at least two classes hold, with how many do."""
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        for _, _, _, n, cid, row, tok in _sets(batches, k):
            first = np.zeros(len(cid), bool)
            first[np.unique(cid, return_index=True)[1]] = True
            row, tok = row[first[row]], tok[first[row]]
            part = tok % n_parts
            order = np.argsort(part.astype(np.uint16 if n_parts < 65536 else np.int64), kind="stable")
            row, tok, part = row[order], tok[order], part[order]
            cut = np.searchsorted(part, np.arange(n_parts + 1))
            out = ([], [], [], [], [])
            for p in range(n_parts):
                a, b = cut[p], cut[p + 1]
                if a == b:
                    continue
                r = row[a:b]
                at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
                own = r[at]
                out[0].append(p)
                out[1].append(cid[own].tobytes())
                out[2].append(n[own].astype(np.uint32).tobytes())
                out[3].append(np.diff(np.append(at, b - a)).astype(np.uint32).tobytes())
                out[4].append((tok[a:b] >> 14).view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])],
                                                 ["part", "cids", "ns", "counts", "toks"])

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for p, *x in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(p, []).append(x)
        for p, chunks in held.items():
            cid, n, cnt = (np.concatenate([np.frombuffer(c[i], t) for c in chunks]) for i, t in ((0, np.int64), (1, np.uint32), (2, np.uint32)))
            raw = np.concatenate([np.frombuffer(c[3], np.uint8) for c in chunks]).reshape(-1, 5)
            chunks.clear()
            tok = np.zeros((len(raw), 8), np.uint8)
            tok[:, :5] = raw
            tok = tok.view(np.int64).ravel()
            first = np.zeros(len(cid), bool)
            first[np.unique(cid, return_index=True)[1]] = True
            keep = np.repeat(first, cnt)
            own = np.repeat(np.arange(len(cid)), cnt)[keep]
            tok = tok[keep]
            order = np.argsort(tok)
            s = tok[order]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
            runs = np.diff(np.append(starts, len(s)))
            df = np.repeat(runs, runs)
            many = df > 1
            own, s, df = own[order][many], s[many], df[many]
            back = np.argsort(own, kind="stable")
            own, s, df = own[back], s[back], df[back]
            for a in range(0, len(s), 1 << 16):
                o = own[a: a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[o]), pa.array(n[o].astype(np.int32)), pa.array(s[a: a + (1 << 16)] * n_parts + p), pa.array(df[a: a + (1 << 16)].astype(np.int32))],
                    ["cid", "n", "tok", "df"])

    packed = docs.select("text").mapInArrow(pack, "part int, cids binary, ns binary, counts binary, toks binary")
    return packed.repartitionById(n_parts, F.col("part")).mapInArrow(count, "cid long, n int, tok long, df int")


def linkable(tokens: DataFrame, percent: int) -> DataFrame:
    """(cid, n, p, weight, toks): classes whose shared tokens reach the threshold, rarest tokens first.

    ``p`` tokens from the front suffice to meet any partner; ``weight`` is the mean df.
    """

    def gather(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        cid, n, tok, df = (t.column(i).to_numpy() for i in range(4))
        order = np.lexsort((tok, df, cid))
        cid, n, tok, df = cid[order], n[order], tok[order], df[order]
        at = np.flatnonzero(np.concatenate([[True], cid[1:] != cid[:-1]]))
        m = np.diff(np.append(at, len(cid)))
        size = n[at].astype(np.int64)
        need = -(-percent * size // 100)
        ok = m >= need
        weight = np.add.reduceat(df, at) / m
        keep = np.repeat(ok, m)
        toks = tok[keep]
        offsets = np.concatenate([[0], np.cumsum(m[ok])])
        for a in range(0, int(ok.sum()), 512):
            b = min(a + 512, int(ok.sum()))
            o = offsets[a: b + 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[at][ok][a:b]), pa.array(size[ok][a:b]), pa.array((m - need + 1)[ok][a:b].astype(np.int32)), pa.array(weight[ok][a:b]),
                 pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32)), pa.array(toks[o[0]: o[-1]]))],
                ["cid", "n", "p", "weight", "toks"])

    return tokens.repartition("cid").mapInArrow(gather, "cid long, n long, p int, weight double, toks array<long>")


def _linked(percent: int):
    i = "size(array_intersect(a_toks, b_toks))"
    return F.expr(f"100 * {i} >= {percent} * (a_n + b_n - {i})")


def _tree(sets: list[np.ndarray], size: np.ndarray):
    """Levels of (OR bitmaps, least size, largest size, most tokens beyond one a bit), leaves (single sets) first."""
    words = BITS // 64
    bits = np.zeros((len(sets), words), U)
    for k, s in enumerate(sets):
        at = (mix(s.astype(U)) % U(BITS)).astype(np.int64)
        np.bitwise_or.at(bits[k], at >> 6, U(1) << (at & 63).astype(U))
    extra = np.array([len(s) for s in sets]) - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = [(bits, size, size, extra)]
    while len(levels[-1][0]) > 1:
        b, lo, hi, ex = levels[-1]
        at = np.arange(0, len(b), LEAF)
        levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))
    return levels


def traverse(a_sets, a_size, b_sets, b_size, percent: int):
    """Pairs (i, j) of set numbers that sizes and bitmaps cannot rule out, by dual traversal of two trees."""
    ta, tb = _tree(a_sets, a_size), _tree(b_sets, b_size)
    la, lb = len(ta) - 1, len(tb) - 1
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        (ba, loa, hia, exa), (bb, lob, hib, exb) = ta[la], tb[lb]
        fits = (100 * hib[j] >= percent * loa[i]) & (100 * hia[i] >= percent * lob[j])
        i, j = i[fits], j[fits]
        most = np.concatenate([np.bitwise_count(ba[i[s: s + 4096]] & bb[j[s: s + 4096]]).sum(1).astype(np.int64) for s in range(0, len(i), 4096)] or [np.zeros(0, np.int64)])
        most = np.minimum(most + np.minimum(exa[i], exb[j]), np.minimum(hia[i], hib[j]))
        ok = (100 + percent) * most >= percent * (loa[i] + lob[j])
        i, j = i[ok], j[ok]
        if not la and not lb or not len(i):
            return i, j
        if la >= lb:
            la -= 1
            i, j = (i[:, None] * LEAF + np.arange(LEAF)).ravel(), np.repeat(j, LEAF)
            i, j = i[i < len(ta[la][0])], j[i < len(ta[la][0])]
        else:
            lb -= 1
            j, i = (j[:, None] * LEAF + np.arange(LEAF)).ravel(), np.repeat(i, LEAF)
            i, j = i[j < len(tb[lb][0])], j[j < len(tb[lb][0])]


def _region_edges(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) component labels that a link joins. members: region, comp, cid, n; sets: cid, toks.

    Tokens join only the rows of node pairs that have to be traversed.
    """
    by_comp = members.groupBy("region", "comp").agg(F.count("*").alias("c"))
    main = by_comp.groupBy("region").agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("size"), F.count("*").alias("comps"))
    main = main.where("comps > 1 and size > 2").select("region", "size", F.col("m.c").alias("main_size"), F.col("m.comp").alias("main"))
    m = members.join(main, "region")
    rest = F.col("comp") != F.col("main")
    of = F.when(rest, F.col("size") - F.col("main_size")).otherwise(F.col("main_size"))
    node = F.when(F.col("size") <= NODE, F.lit(0)).otherwise(
        F.pmod(F.xxhash64("cid"), F.ceil(of / NODE)) * 2 + rest.cast("long") + 1)
    m = stored(m.select("region", "comp", "cid", "n", node.alias("node")))
    nodes = m.groupBy("region", "node").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    left, right = (nodes.select("region", *(F.col(c).alias(f"{s}_{c}") for c in ("node", "lo", "hi", "c0", "c1"))) for s in "ab")
    pairs = left.join(right, "region").where(
        f"a_node <= b_node and not (a_c0 = a_c1 and a_c0 = b_c0 and b_c0 = b_c1) and 100 * a_hi >= {percent} * b_lo and 100 * b_hi >= {percent} * a_lo"
    ).select("region", "a_node", "b_node")
    sides = pairs.select("region", "a_node", "b_node", F.col("a_node").alias("node"), F.lit(0).alias("side")).unionByName(
        pairs.where("a_node <> b_node").select("region", "a_node", "b_node", F.col("b_node").alias("node"), F.lit(1).alias("side")))

    def run(key, table):
        side, comp, cid, n = (table.column(c).to_numpy() for c in ("side", "comp", "cid", "n"))
        toks = [np.sort(np.asarray(x, np.int64)) for x in table.column("toks").to_pylist()]
        order = sorted(range(len(toks)), key=lambda k: (n[k], int(mix(toks[k].astype(U)).min()), cid[k]))
        a = [k for k in order if side[k] == 0]
        b = [k for k in order if side[k] == 1] or a
        i, j = traverse([toks[k] for k in a], n[a].astype(np.int64), [toks[k] for k in b], n[b].astype(np.int64), percent)
        up: dict[int, int] = {}

        def top(x):
            while up.get(x, x) != x:
                x = up[x]
            return x

        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            x, y = a[x], b[y]
            if top(comp[x]) == top(comp[y]):
                continue
            both = len(np.intersect1d(toks[x], toks[y], assume_unique=True))
            if 100 * both >= percent * (int(n[x]) + int(n[y]) - both):
                out.append((int(comp[x]), int(comp[y])))
                up[top(comp[x])] = top(comp[y])
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    rows = stored(sides.join(m, ["region", "node"]).drop("node"))
    return rows.join(sets, "cid").groupBy("region", "a_node", "b_node").applyInArrow(run, "a long, b long")


def class_components(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(node, label): classes with a link to another one, and their component's smallest class."""
    folder = shared_dir(docs.sparkSession)
    s = stored(linkable(shared_tokens(docs, k), percent), f"{folder}/sets")
    front = s.select("cid", "weight", F.explode(F.slice("toks", F.lit(1), F.col("p"))).alias("tok"))
    blocks = front.groupBy("tok").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("cid")).alias("sig"),
                                      F.max(F.struct("weight", "cid")).alias("top")).where("c > 1")
    blocks = blocks.groupBy("c", "sig", F.col("top.cid").alias("center")).agg(F.min("tok").alias("tok"))
    near = stored(front.select("cid", "tok").join(blocks.select("tok", "center"), "tok").where("cid <> center").select("cid", "center").distinct(), f"{folder}/near")
    a, b = (s.select(F.col("cid").alias(c), F.col("n").alias(f"{x}_n"), F.col("toks").alias(f"{x}_toks")) for x, c in (("a", "cid"), ("b", "center")))
    sizes = s.select(F.col("cid").alias("center"), F.col("n").alias("c_n"))
    fits = near.join(sizes, "center").join(s.select("cid", "n"), "cid").where(f"100 * least(n, c_n) >= {percent} * greatest(n, c_n)").select("cid", "center")
    stars = stored(fits.join(a, "cid").join(b, "center").where(_linked(percent)).select("cid", "center"), f"{folder}/stars")
    comps, regions = components(stars, "cid", "center"), components(near, "cid", "center")
    members = s.select("cid", "n").join(regions.select(F.col("node").alias("cid"), F.col("label").alias("region")), "cid").join(
        comps.select(F.col("node").alias("cid"), F.col("label").alias("comp")), "cid", "left").select(
        "region", F.coalesce("comp", "cid").alias("comp"), "cid", "n")
    more = stored(_region_edges(members, s.select("cid", "toks"), percent), f"{folder}/more")
    if not more.limit(1).count():
        return comps
    return components(stars.unionByName(more.select(F.col("a").alias("cid"), F.col("b").alias("center"))), "cid", "center")


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id that links (Jaccard of the k-word shingle
    sets of at least ``percent`` / 100) reach, the row's own included.  Texts that are null,
    empty or without words have no shingles and link with nothing.  Rows that
    repeat come out as often as they came in.  An empty table gives no rows.
    """
    return _labelled(docs, percent, k).select("doc_id", "n_shingles", "component_id")


def _labelled(docs: DataFrame, percent: int, k: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """:func:`near_duplicates` with the component's label (null for a row without shingles) and the string columns ``carry``."""
    sets = stored(document_sets(docs, k, carry))
    comps = class_components(docs, percent, k)
    classes = sets.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("first"))
    classes = classes.join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = classes.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = stored(classes.join(least, "label").select("cid", "component_id", "label"))
    full = sets.where("cid is not null").join(classes, "cid").select("doc_id", "n_shingles", "component_id", "label", *carry)
    return full.unionByName(sets.where("cid is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"), *carry))


def deduplicated(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the smallest doc_id.

    Rows without words are in no group and stay.  Exactly one row of a group stays: the one with the smallest doc_id,
    a null one last; of several texts with that doc_id the one with the least hash, and of equal rows any one.
    """
    me = docs.withColumn("__row", row_key())
    found = _labelled(me, percent, k, ("__row",)).where("label is not null")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    texts = found.where(first).select("label", "__row").distinct()  # of the smallest doc_id: one, unless texts share it
    least = texts.groupBy("label").agg(F.min("__row").alias("__least"))
    gone = found.where(~first).select("__row").unionByName(texts.join(least, "label").where("__row <> __least").select("__row"))
    # one of equal rows; a row without words is like no other
    alone = F.when(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)), F.monotonically_increasing_id())
    me = me.withColumn("__row", F.concat_ws(":", "__row", alone))
    me = me.withColumn("__nth", F.row_number().over(Window.partitionBy("__row").orderBy("__row"))).where("__nth = 1")
    return me.join(gone.distinct(), "__row", "left_anti").select(*docs.columns)

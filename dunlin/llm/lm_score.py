"""Language-model scores by a hidden Markov model over word classes.

p(text) = sum over state paths of prod p(z_t | z_t-1) p(class_t | z_t) p(word_t | class_t).
A word's class is its hash modulo ``CLASSES`` (a fixed number, so the model that goes
to the tasks has a fixed size); p(word | class) comes from counts of every training
word, which stay a distributed table.  The end token is a class of its own.

Baum-Welch: every task runs scaled forward and backward recursions over its texts
and emits expected counts by class; they are summed across partitions, and the
driver turns the sums (CLASSES x STATES numbers) into the next model.  Every round
runs over all training texts, until the log likelihood hardly changes.  Texts are hashed
to class numbers once, into the shared folder, in the order in which the rounds read them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import column, shared_dir, slices, stored, text_buffer
from dunlin.llm.words import Hasher, U, counts_of, mix, space_words

STATES = 4
CLASSES = 1 << 14  # at most 65,535, as they are stored in two bytes
MOST_ROUNDS, LEAST_GAIN = 8, 1e-3  # Baum-Welch rounds, and the relative gain in log likelihood below which they end
KNOWN_WORDS = 1 << 17  # counts sent to the tasks; all other words are joined
LONG = 1024  # tokens beyond which a text takes its steps with others like it
POOL = 1 << 20  # tokens of texts that take their steps together
LONGEST = 1 << 14  # tokens beyond which a text is cut into blocks
LONGEST_SCORED = 1 << 12  # the same where texts are scored, slice by slice
BLOCK = 64  # tokens of a block's transfer matrix
SLICE, SLICE_ROWS = 2 << 20, 4096  # bytes and rows of texts that take their steps together
END = -1  # the end token in the table of word counts


def remainder(n: int):
    """crc32 of doc_id as text, modulo n (null: null)."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


class Model:
    def __init__(self, pi: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.pi, self.step, self.emit = pi, step, emit  # (S), (S, S), (CLASSES + 1, S)

    def single(self) -> "Model":
        """In single precision: enough for the expected counts of a round, which are added up in double precision."""
        return Model(*(x.astype(np.float32) for x in (self.pi, self.step, self.emit)))

    @staticmethod
    def start(classes: np.ndarray, states: int) -> "Model":
        """classes: training tokens of each class. Fixed noise tells the states apart."""
        n = len(classes)
        noise = mix(np.arange(1, n * states + 1, dtype=U)).astype(np.float64).reshape(n, states) / 2.0**64
        emit = (classes + 0.1)[:, None] * (0.3 + noise)
        step = np.full((states, states), 0.05 / max(states - 1, 1))
        np.fill_diagonal(step, 0.95)
        return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def of_counts(classes: np.ndarray, gamma: np.ndarray, xi: np.ndarray, pi: np.ndarray) -> "Model":
        """Counts with a little of the overall class shares (emissions) and of uniform weights (states)."""
        share = (classes + 0.1) / (classes + 0.1).sum()
        emit = gamma + share[:, None] * 50.0
        step, first = xi + 0.5, pi + 0.5
        return Model(first / first.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


class SideBySide:
    """Scaled recursions over short texts: all texts of a slice take a step at a time.

    ``obs`` holds the texts' tokens step by step, longest text first: ``active[t]`` texts have a token number t.
    """

    def __init__(self, model: Model, obs: np.ndarray, active: np.ndarray):
        self.m, self.obs, self.active = model, obs, active
        self.at = np.cumsum(active) - active

    def forward(self, keep: bool = False) -> np.ndarray:
        """Natural log likelihood of each text, longest first; with ``keep`` also every token's weights and scale."""
        m, s = self.m, len(self.m.pi)
        emit = m.emit[self.obs]
        k0 = int(self.active[0]) if len(self.active) else 0
        kind = emit.dtype
        logp, a = np.zeros(k0), np.empty((k0, s), kind)
        if keep:
            self.emit, self.alpha, self.scale = emit, np.empty((len(self.obs), s), kind), np.empty(len(self.obs), kind)
        for t, (at, k) in enumerate(zip(self.at.tolist(), self.active.tolist())):
            a = (a[:k] @ m.step if t else np.broadcast_to(m.pi, (k, s))) * emit[at: at + k]
            c = a.sum(1)
            a /= c[:, None]
            logp[:k] += np.log(c)
            if keep:
                self.alpha[at: at + k], self.scale[at: at + k] = a, c
        return logp

    def expect(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected (class, state), transition and start counts, and the log likelihood."""
        logp = self.forward(keep=True)
        m, s = self.m, len(self.m.pi)
        beta, cross = np.ones((len(self.obs), s), self.emit.dtype), np.zeros((s, s))
        self.emit /= self.scale[:, None]
        for t in range(len(self.active) - 1, 0, -1):
            at, k, before = int(self.at[t]), int(self.active[t]), int(self.at[t - 1])
            v = self.emit[at: at + k] * beta[at: at + k]
            cross += self.alpha[before: before + k].T @ v
            beta[before: before + k] = v @ m.step.T
        gamma = self.alpha * beta
        counts = np.stack([np.bincount(self.obs, weights=gamma[:, z], minlength=len(m.emit)) for z in range(s)], 1)
        pi = gamma[: int(self.active[0])].sum(0, dtype=np.float64) if len(self.active) else np.zeros(s)
        return counts, m.step * cross, pi, float(logp.sum())


def step_by_step(obs: np.ndarray, n_tok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts that lie one after another, in the order of :class:`SideBySide`; ``active``; and the texts, longest first."""
    order = np.argsort(-n_tok, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    longest = int(n_tok.max(initial=0))
    active = np.searchsorted(-n_tok[order], -np.arange(longest), "left")
    doc = np.repeat(np.arange(len(n_tok)), n_tok)
    step = np.arange(len(obs)) - np.repeat(np.cumsum(n_tok) - n_tok, n_tok)
    out = np.empty_like(obs)
    out[(np.cumsum(active) - active)[step] + rank[doc]] = obs
    return out, active, order


class Recursion:
    """Scaled recursions over long texts, which are cut into blocks of BLOCK tokens.

    A block's transfer matrix carries the state weights over it, so long texts
    need as few sequential steps as blocks and all blocks run at once.
    """

    def __init__(self, model: Model, obs: np.ndarray, n_tok: np.ndarray):
        self.m, self.obs = model, obs
        n_blocks = -(-n_tok // BLOCK)
        doc = np.repeat(np.arange(len(n_tok)), n_blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        size = np.minimum(n_tok[doc] - nth * BLOCK, BLOCK)
        start = (np.cumsum(n_tok) - n_tok)[doc] + nth * BLOCK
        self.order = np.argsort(-size, kind="stable")
        self.start, self.size, self.first = start[self.order], size[self.order], nth[self.order] == 0
        self.place = np.empty(len(doc), np.int64)
        self.place[self.order] = np.arange(len(doc))
        self.n_tok, self.n_blocks = n_tok, n_blocks
        self.block0 = np.cumsum(n_blocks) - n_blocks
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(BLOCK)]  # blocks of more than t tokens

    def _emit(self, t: int, n: int) -> np.ndarray:
        return self.m.emit[self.obs[self.start[:n] + t]]

    def matrices(self) -> None:
        s, a = len(self.m.pi), self.m.step
        n = len(self.start)
        mat = np.where(self.first[:, None, None], np.broadcast_to(self.m.pi, (s, s)), a) * self._emit(0, n)[:, None, :] if n else np.zeros((0, s, s))
        scale = np.zeros(n)
        for t in range(1, BLOCK):
            k = self.active[t]
            if not k:
                break
            mat[:k] = (mat[:k].reshape(-1, s) @ a).reshape(k, s, s) * self._emit(t, k)[:, None, :]
            if t % 8 == 0:
                total = mat[:k].sum((1, 2))
                mat[:k] /= total[:, None, None]
                scale[:k] += np.log(total)
        self.mat, self.scale = mat, scale

    def forward(self) -> np.ndarray:
        """Natural log likelihood of each text; keeps the weights that enter each block."""
        self.matrices()
        s = len(self.m.pi)
        docs = np.argsort(-self.n_blocks, kind="stable")
        alpha = np.full((len(docs), s), 1 / s)
        self.enter = np.empty((len(self.start), s))
        logp = np.zeros(len(docs))
        for j in range(int(self.n_blocks.max(initial=0))):
            d = docs[: int((self.n_blocks > j).sum())]
            at = self.place[self.block0[d] + j]
            self.enter[at] = alpha[d]
            new = np.einsum("ds,dst->dt", alpha[d], self.mat[at])
            total = new.sum(1)
            alpha[d] = new / total[:, None]
            logp[d] += np.log(total) + self.scale[at]
        return logp

    def expect(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected (class, state), transition and start counts, and the log likelihood."""
        logp = self.forward()
        m, s, n = self.m, len(self.m.pi), len(self.start)
        docs = np.argsort(-self.n_blocks, kind="stable")
        beta = np.ones((len(docs), s))
        leave = np.empty((n, s))
        for j in range(int(self.n_blocks.max(initial=0)) - 1, -1, -1):
            d = docs[: int((self.n_blocks > j).sum())]
            at = self.place[self.block0[d] + j]
            leave[at] = beta[d]
            new = np.einsum("dst,dt->ds", self.mat[at], beta[d])
            beta[d] = new / new.sum(1, keepdims=True)
        alphas, a = [], self.enter
        for t in range(BLOCK):
            k = self.active[t]
            if not k:
                break
            a = a[:k] @ m.step if t else np.where(self.first[:, None], m.pi, a @ m.step)
            a = a * self._emit(t, k)
            a = a / a.sum(1, keepdims=True)
            alphas.append(a)
        gamma = np.empty((len(self.obs), s))
        cross, pi = np.zeros((s, s)), np.zeros(s)
        b = leave
        for t in range(len(alphas) - 1, -1, -1):
            k = self.active[t]
            g = alphas[t] * b[:k]
            g /= g.sum(1, keepdims=True)
            gamma[self.start[:k] + t] = g
            v = self._emit(t, k) * b[:k]
            if t:
                before = alphas[t - 1][:k]
            else:
                pi = g[self.first].sum(0)
                before, v = self.enter[~self.first], v[~self.first]
            norm = ((before @ m.step) * v).sum(1, keepdims=True)
            cross += before.T @ (v / norm)
            if t:
                nb = v @ m.step.T
                b[:k] = nb / nb.sum(1, keepdims=True)
        counts = np.stack([np.bincount(self.obs, weights=gamma[:, z], minlength=len(m.emit)) for z in range(s)], 1)
        return counts, m.step * cross, pi, float(logp.sum())


def _tokens(hasher: Hasher, data: np.ndarray, offs: np.ndarray, a: int, b: int):
    """Word hashes (63 bits), their rows, and words a row, of rows a to b."""
    h, rows, _, _ = hasher.words(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
    return (h >> U(1)).astype(np.int64), rows, counts_of(rows, b - a)


def _observed(h: np.ndarray, rows: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """Class of every token, each row's end token last."""
    obs = np.full(len(h) + len(n), classes, np.int64)
    obs[np.arange(len(h)) + rows] = h % classes
    return obs


def _split(obs: np.ndarray, n_tok: np.ndarray, limit: int):
    """Tokens and sizes of the texts of at most ``limit`` tokens, and of the longer ones; and which texts are longer."""
    is_long = n_tok > limit
    if not is_long.any():
        return obs, n_tok, obs[:0], n_tok[:0], is_long
    of = np.repeat(is_long, n_tok)
    return obs[~of], n_tok[~is_long], obs[of], n_tok[is_long], is_long


def class_numbers(texts: DataFrame, classes: int) -> DataFrame:
    """The classes of all tokens: rows of about POOL tokens of short or of long texts, step by step (two bytes
    a token) with the number of texts at each step; the longest texts one after another with their sizes."""
    def row(waiting):
        obs, n = (np.concatenate(x) for x in zip(*waiting))
        obs, n, long_obs, long_n, _ = _split(obs, n, LONGEST)
        steps, active, _ = step_by_step(obs, n)
        parts = [steps.astype("<u2"), active.astype("<i4"), long_obs.astype("<u2"), long_n.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], ["obs", "active", "long_obs", "long_n"])

    def run(batches):
        hasher, pools = Hasher(space_words()), ([], [])
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            for a, b in slices(offs, SLICE, SLICE_ROWS):
                h, rows, n = _tokens(hasher, data, offs, a, b)
                short, n_short, long_, n_long, _ = _split(_observed(h, rows, n, classes), n + 1, LONG)
                for pool, part in zip(pools, ((short.astype(np.uint16), n_short), (long_.astype(np.uint16), n_long))):
                    pool.append(part)
                    if sum(len(x) for x, _ in pool) >= POOL:
                        yield row(pool)
                        pool.clear()
        for pool in pools:
            if pool:
                yield row(pool)

    return texts.select("text").mapInArrow(run, "obs binary, active binary, long_obs binary, long_n binary")


def word_counts(train: DataFrame) -> DataFrame:
    """(w, c): how often each word hash occurs in the texts; END counts the texts."""

    def run(batches):
        hasher = Hasher(space_words())
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            found = [_tokens(hasher, data, offs, a, b)[0] for a, b in slices(offs)]
            w, c = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
            w, c = np.append(w, END), np.append(c, batch.num_rows)
            for a in range(0, len(w), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(w[a: a + (1 << 16)]), pa.array(c[a: a + (1 << 16)])], ["w", "c"])

    return train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where("c > 0")


def expected_counts(slices_: DataFrame, model: Model, classes: int):
    """One Baum-Welch pass over :func:`class_numbers`: expected counts of every task, summed across partitions."""
    states = len(model.pi)
    names = [f"s{z}" for z in range(states)]
    sent = slices_.sparkSession.sparkContext.broadcast(model)  # (CLASSES + 1) x STATES numbers

    def run(batches):
        m, short = sent.value, sent.value.single()
        total, xi, pi, ll = np.zeros((classes + 1, states)), np.zeros((states, states)), np.zeros(states), 0.0
        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in ("obs", "active", "long_obs", "long_n"))):
                obs, active, long_, n = (np.frombuffer(x, t).astype(np.int64) for x, t in zip(row, ("<u2", "<i4", "<u2", "<i4")))
                found = [SideBySide(short, obs, active).expect()] if len(active) else []
                if len(n):
                    found.append(Recursion(m, long_, n).expect())
                for c, x, p, one in found:
                    total += c
                    xi += x
                    pi += p
                    ll += one
        every = np.concatenate([total, xi, pi[None], np.full((1, states), ll)])
        k = np.flatnonzero(every.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), *(pa.array(every[k, z]) for z in range(states))], ["k", *names])

    rows = slices_.mapInArrow(run, "k long, " + ", ".join(f"{n} double" for n in names))
    got = rows.groupBy("k").agg(*(F.sum(n).alias(n) for n in names)).toArrow()
    every = np.zeros((classes + 1 + states + 2, states))
    every[got.column("k").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], 1) if got.num_rows else 0
    sent.unpersist()
    return every[: classes + 1], every[classes + 1: -2], every[-2], float(every[-1, 0])


def train(slices_: DataFrame, class_counts: np.ndarray, states: int = STATES) -> Model:
    """Baum-Welch rounds over :func:`class_numbers` of all training texts: MOST_ROUNDS, or fewer if the log likelihood gains less than LEAST_GAIN of itself."""
    classes = len(class_counts) - 1
    model, last = Model.start(class_counts, states), None
    for _ in range(MOST_ROUNDS):
        gamma, xi, pi, ll = expected_counts(slices_, model, classes)
        if pi.sum() == 0:
            break
        model = Model.of_counts(class_counts, gamma, xi, pi)
        if last is not None and ll - last < LEAST_GAIN * abs(last):
            break
        last = ll
    return model


def log_likelihood(model: Model, obs: np.ndarray, n_tok: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each of the texts that lie one after another in ``obs``."""
    short, n_short, long_, n_long, is_long = _split(obs, n_tok, LONGEST_SCORED)
    out = np.empty(len(n_tok))
    if len(n_long):
        out[is_long] = Recursion(model, long_, n_long).forward()
    if len(n_short):
        steps, active, order = step_by_step(short, n_short)
        out[np.flatnonzero(~is_long)[order]] = SideBySide(model, steps, active).forward()
    return out


def score(docs: DataFrame, folds: int = 10, states: int = STATES, classes: int = CLASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows whose crc32(doc_id) mod ``folds`` is 0 are held out; all others train,
    also rows without a doc_id.  A null text is empty: its only token is the end.
    Repeated rows train and score each.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "held_out", F.coalesce(remainder(folds) == 0, F.lit(False)))
    texts = docs.where("not held_out")
    words = stored(word_counts(texts), f"{folder}/words")
    level = F.floor(F.log2("c") * 8)
    levels = words.groupBy(level.alias("level"), (F.col("w") == END).alias("end")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    total, distinct = sum(r.n for r in levels), sum(r.v for r in levels)
    ends = sum(r.n for r in levels if r.end)
    least, room = None, KNOWN_WORDS
    for r in sorted((r for r in levels if not r.end), key=lambda r: -r.level):
        room -= r.v
        if room < 0:
            break
        least = r.level
    per_class = words.where(F.col("w") != END).groupBy((F.col("w") % classes).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()
    n_of, v_of = np.zeros(classes + 1), np.zeros(classes + 1)
    n_of[per_class.column("k").to_numpy()] = per_class.column("n").to_numpy()
    v_of[per_class.column("k").to_numpy()] = per_class.column("v").to_numpy()
    n_of[classes] = ends
    model = train(stored(class_numbers(texts, classes), f"{folder}/classes"), n_of, states)
    known = words.where((F.col("w") != END) & (level >= least)).toArrow() if least is not None else None
    top_w = known.column("w").to_numpy() if known is not None else np.zeros(0, np.int64)
    top_c = known.column("c").to_numpy() if known is not None else np.zeros(0, np.int64)
    order = np.argsort(top_w)
    share = np.log10(n_of[:classes] + 0.1 * (v_of[:classes] + 1))
    sent = spark.sparkContext.broadcast((model, top_w[order], top_c[order], share))  # KNOWN_WORDS and the model: fixed bounds

    def run(batches):
        from pyspark import TaskContext
        task, seen = TaskContext.get().partitionId(), 0
        m, tw, tc, share = sent.value
        tl = np.log10(tc + 0.1)
        hasher = Hasher(space_words())
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            for a, b in slices(offs, SLICE, SLICE_ROWS):
                h, rows, n = _tokens(hasher, data, offs, a, b)
                logp = log_likelihood(m, _observed(h, rows, n, classes), n + 1) / np.log(10)
                at = np.minimum(np.searchsorted(tw, h), max(len(tw) - 1, 0))
                is_top = tw[at] == h if len(tw) else np.zeros(len(h), bool)
                num = np.bincount(rows[is_top], weights=tl[at[is_top]], minlength=b - a)
                n_top = np.bincount(rows[is_top], minlength=b - a)
                den = np.bincount(rows, weights=share[h % classes], minlength=b - a)
                rr, rh = rows[~is_top], h[~is_top]
                o = np.lexsort((rh, rr))
                rr, rh = rr[o], rh[o]
                new = np.flatnonzero(np.concatenate([[True], (rr[1:] != rr[:-1]) | (rh[1:] != rh[:-1])])) if len(rr) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(rr)))
                cut = pa.array(np.searchsorted(rr[new], np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((task << 40) + seen + np.arange(a, b)), column(batch, "doc_id").slice(a, b - a), column(batch, "held_out").slice(a, b - a),
                     pa.array(n + 1, pa.int64()), pa.array(n_top, pa.int64()), pa.array(num, pa.float64()), pa.array(logp - den, pa.float64()),
                     pa.ListArray.from_arrays(cut, pa.array(rh[new], pa.int64())), pa.ListArray.from_arrays(cut, pa.array(times, pa.int64()))],
                    ["key", "doc_id", "held_out", "n_tokens", "n_top", "num", "rest", "rare", "times"])
            seen += batch.num_rows

    rows = stored(docs.mapInArrow(
        run, "key long, doc_id long, held_out boolean, n_tokens long, n_top long, num double, rest double, rare array<long>, times array<long>"), f"{folder}/rows")
    rare = rows.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("w"), F.col("x.times").alias("times"))
    rare = rare.join(words, "w", "left").groupBy("key").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("num"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    end = float(np.log10(ends + 0.1))
    per_token = float(np.log10(total + 0.1 * (distinct + 1)))
    j = rows.drop("rare", "times").join(rare.withColumnRenamed("num", "rare_num"), "key", "left")
    num = F.col("num") + F.coalesce("rare_num", F.lit(0.0))
    return j.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_top") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"), (num + F.lit(end) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (num + F.col("rest")).alias("score"))

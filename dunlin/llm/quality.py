"""Document quality by regularised quadratic discriminant analysis.

Each text gives a vector of transformed statistics.  Per class the labelled vectors'
sums and cross products are added up across partitions; the driver shrinks the two
covariances and factors them once (Cholesky).  A score is the logistic of the
difference of the two Mahalanobis log-densities and of the log priors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import column, row_key, shared_dir, slices, stored, text_buffer, without
from dunlin.llm.words import Hasher, counts_of, shingles, space_words

FEATURES = ("words", "word_length", "upper", "digits", "marks", "shouts", "bars", "stops", "lines", "beyond_ascii",
            "distinct_words", "same_again", "distinct_shingles", "capital_starts")
SHRINK = 0.1  # weight of the pooled diagonal in a class's covariance
FLOOR = 1e-3  # added to its diagonal (vectors are scaled to unit variance)
THRESHOLD = 0.3
FOLDS = 5
LIMIT = 30.0  # largest log odds: scores stay inside (0, 1)


def vectors(hasher: Hasher, data: np.ndarray, offs: np.ndarray, a: int, b: int) -> np.ndarray:
    """(rows, features) of rows a to b; shares are log((count + 0.5) / (total + 1)), so empty texts have a vector too."""
    x, o = data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]

    def count(*which):
        table = np.zeros(256, np.int64)
        for w in which:
            table[w] = 1
        acc = np.concatenate([[0], np.cumsum(table[x])])
        return acc[o[1:]] - acc[o[:-1]]

    def share(part, total):
        return np.log((part + 0.5) / (total + 1.0))

    h, rows, starts, _ = hasher.words(x, o)
    n = counts_of(rows, b - a)
    chars = np.diff(o) - count(slice(0x80, 0xC0))
    upper, lower = count(slice(65, 91)), count(slice(97, 123))
    again = np.flatnonzero((h[1:] == h[:-1]) & (rows[1:] == rows[:-1])) + 1
    first = x[starts]
    capital = rows[(first >= 65) & (first < 91)]
    words = np.maximum(n, 1)
    return np.stack([
        np.log1p(n), np.log((chars + 1.0) / (words + 1.0)), share(upper, upper + lower), share(count(slice(48, 58)), chars),
        share(count(list(b"#$%&*@^~<>{}[]\\_=+")), chars), share(count(33), chars), share(count(124), chars), share(count(list(b".,;:?")), chars),
        share(count(10), n), share(count(slice(0xC2, 256)), chars), share(counts_of(shingles(h, rows, b - a, 1)[0], b - a), n),
        share(np.bincount(rows[again], minlength=b - a), n), share(counts_of(shingles(h, rows, b - a, 5)[0], b - a), n),
        share(np.bincount(capital, minlength=b - a), n)], 1)


def features(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, f) of every row, and its string columns ``carry``."""

    def run(batches):
        hasher = Hasher(space_words())
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            ids = column(batch, "doc_id")
            for a, b in slices(offs):
                v = vectors(hasher, data, offs, a, b)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), flat, *(column(batch, c).slice(a, b - a) for c in carry)], ["doc_id", "f", *carry])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, "doc_id long, f array<double>" + "".join(f", {c} string" for c in carry))


def moments(labelled: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum of vectors, sum of their cross products; added up across partitions."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            y = column(batch, "y").to_numpy()
            f = column(batch, "f").flatten().to_numpy().reshape(-1, d)
            for k in np.unique(y).tolist():
                v = f[y == k]
                s = total.setdefault(k, [0.0, np.zeros(d), np.zeros((d, d))])
                s[0] += len(v)
                s[1] += v.sum(0)
                s[2] += v.T @ v
        keys = sorted(total)
        flat = [np.concatenate([[total[k][0]], total[k][1], total[k][2].ravel()]) for k in keys]
        m = 1 + d + d * d
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int32), m)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(keys))),
                                          pa.array(np.concatenate(flat or [np.zeros(0)]))], ["y", "i", "v"])

    rows = labelled.select("y", "f").mapInArrow(run, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect()
    out = {}
    for y in {r.y for r in rows}:
        v = np.zeros(1 + d + d * d)
        for r in rows:
            if r.y == y:
                v[r.i] = r.v
        out[y] = (v[0], v[1: 1 + d], v[1 + d:].reshape(d, d))
    return out


class Discriminant:
    """Means, Cholesky factors and log determinants of both classes over scaled vectors."""

    def __init__(self, stats: dict, d: int):
        n = {k: stats[k][0] if k in stats else 0.0 for k in (0, 1)}
        self.prior = np.log((n[1] + 1.0) / (n[0] + 1.0))
        self.parts = None
        if min(n.values()) < 2:  # one class, or none: the prior alone
            return
        every = n[0] + n[1]
        self.mean = (stats[0][1] + stats[1][1]) / every
        self.scale = np.sqrt(np.maximum(np.diag(stats[0][2] + stats[1][2]) / every - self.mean**2, 1e-9))
        cov, mu = {}, {}
        for k in (0, 1):
            m = stats[k][1] / n[k]
            mu[k] = (m - self.mean) / self.scale
            cov[k] = (stats[k][2] / n[k] - np.outer(m, m)) / np.outer(self.scale, self.scale)
        pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / every))
        self.parts = []
        for k in (0, 1):
            chol = np.linalg.cholesky((1 - SHRINK) * cov[k] + SHRINK * pooled + FLOOR * np.eye(d))
            self.parts.append((mu[k], np.linalg.inv(chol), 2 * np.log(np.diag(chol)).sum()))

    def scores(self, f: np.ndarray) -> np.ndarray:
        odds = np.full(len(f), self.prior)
        if self.parts is not None:
            z = (f - self.mean) / self.scale
            density = [-0.5 * ((((z - mu) @ inv.T) ** 2).sum(1) + logdet) for mu, inv, logdet in self.parts]
            odds = odds + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(odds, -LIMIT, LIMIT)))


def classify(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, threshold: float = THRESHOLD, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``, and its string columns ``carry``.

    Labels of rows whose crc32(doc_id) mod ``folds`` is 0 are never read; null
    labels and labels other than 0 and 1 are skipped, and labels that repeat count each.
    Null and empty texts score by their (all-zero) statistics; a row without a doc_id is scored but never
    trains.  Without labels of both classes every score is the prior.
    """
    spark = docs.sparkSession
    d = len(FEATURES)
    crc = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    f = stored(features(docs, carry), shared_dir(spark)).withColumn("held_out", F.coalesce(crc == 0, F.lit(False)))
    y = labels.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where(crc != 0)
    model = Discriminant(moments(f.join(y, "doc_id"), d), d)

    def run(batches):
        for batch in batches:
            v = column(batch, "f").flatten().to_numpy().reshape(-1, d)
            s = model.scores(v)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32)), *(column(batch, c) for c in carry)],
                                             ["doc_id", "held_out", "score", "predicted", *carry])

    return f.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + "".join(f", {c} string" for c in carry))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    return without(docs, classify(docs.withColumn("__row", row_key()), labels, carry=("__row",)).where("predicted = 0"))

"""Importance resampling of documents towards a target distribution of hashed word n-grams.

A batch's texts are joined with a separator that is no word character, one regular
expression pass finds the words of all of them, and ``searchsorted`` over the
documents' offsets tells each word's document; pairs of words of two documents are
masked before the buckets are counted.  A feature's bucket is the CRC-32 of its bytes; the
CRC of two words comes from the words' own CRCs, as CRC is linear.

Counts are bucket sums of whole tables, combined in Spark.  A document's weight is the mean
gain of its features; with Gumbel noise drawn from its id the highest scores are a
sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlin.llm.shared import column, shared_dir, stored

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SEPARATOR = b"\x00"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHORT = 64  # bytes of a word up to which its CRC is computed for all words at once


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


class Crc:
    """CRC-32 of many words at once, and of two words joined by a space."""

    def __init__(self):
        self.table = crc_table()
        # after[n][k][v]: what byte k of a CRC, of value v, becomes when n zero bytes follow
        step = (np.arange(256, dtype=np.uint32)[None] << (np.arange(4, dtype=np.uint32) * 8)[:, None]).astype(np.uint32)
        after = [step]
        for _ in range(SHORT + 1):
            after.append(self.table[after[-1] & 255] ^ (after[-1] >> 8))
        self.after = np.stack(after)
        self.space = self.behind(np.full(SHORT + 1, zlib.crc32(b" "), np.uint32), np.arange(SHORT + 1))

    def behind(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The part of ``crc`` in the CRC of a text that goes on for n more bytes."""
        t = self.after
        return t[n, 0, crc & 255] ^ t[n, 1, (crc >> 8) & 255] ^ t[n, 2, (crc >> 16) & 255] ^ t[n, 3, crc >> 24]

    def words(self, body: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        data, size = np.frombuffer(body, np.uint8), end - start
        order = np.argsort(-size, kind="stable")
        first, long_ = start[order], int((size > SHORT).sum())
        many = np.searchsorted(-size[order], -np.arange(SHORT), "left")  # words of more than j bytes
        crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
        for j in range(SHORT):
            m = many[j]
            if not m:
                break
            crc[:m] = self.table[(crc[:m] ^ data[first[:m] + j]) & 255] ^ (crc[:m] >> 8)
        out = np.empty(len(start), np.uint32)
        out[order] = ~crc
        for i in order[:long_]:
            out[i] = zlib.crc32(body[start[i]: end[i]])
        return out

    def pairs(self, body: bytes, start: np.ndarray, end: np.ndarray, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
        """CRCs of word ``left`` + space + the word after it."""
        right = left + 1
        size = end[right] - start[right]
        near = np.minimum(size, SHORT)
        out = self.behind(crc[left], near + 1) ^ self.space[near] ^ crc[right]
        for i in np.flatnonzero(size > SHORT):
            out[i] = zlib.crc32(b" " + body[start[right[i]]: end[right[i]]], int(crc[left[i]]))
        return out


def features(texts: list[bytes], crc: Crc, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; and the bucket and the text's number of every feature (one or two words) of all texts."""
    body = SEPARATOR.join(texts).lower()
    span = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(body))), np.int64).reshape(-1, 2)
    start, end = span[:, 0], span[:, 1]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
    doc = np.searchsorted(offsets, start, "right") - 1
    one = crc.words(body, start, end)
    left = np.flatnonzero(doc[:-1] == doc[1:])
    two = crc.pairs(body, start, end, one, left)
    return np.bincount(doc, minlength=len(texts)), np.concatenate([one, two]) % np.uint32(buckets), np.concatenate([doc, doc[left]])


def _batches(batch: pa.RecordBatch, most_bytes: int = 2 << 20):
    """(first row, texts as bytes) of consecutive rows of about ``most_bytes``; a longer text goes alone."""
    texts, size, first = [], 0, 0
    for k, t in enumerate(column(batch, "text").cast(pa.large_binary()).to_pylist()):
        t = t or b""
        if texts and size + len(t) > most_bytes:
            yield first, texts
            texts, size, first = [], 0, k
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts of ``table`` in each bucket; tasks count, Spark adds up, ``buckets`` rows reach the driver."""
    def count(batches):
        total, crc = np.zeros(buckets, np.int64), Crc()
        for batch in batches:
            for _, texts in _batches(batch):
                total += np.bincount(features(texts, crc, buckets)[1], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in table.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the corpus's share) of every bucket, shares smoothed by one."""
    s_all, t_all, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise from the first 32 bits of sha256(seed:doc_id), in thousandths, floored; a null id is written as nothing."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score (weight and noise) of every row."""
    def weigh(batches):
        crc = Crc()
        for batch in batches:
            ids = column(batch, "doc_id").to_pylist()
            for first, texts in _batches(batch):
                words, bucket, doc = features(texts, crc, len(gain))
                n = np.bincount(doc, minlength=len(texts))
                total = np.bincount(doc, weights=gain[bucket], minlength=len(texts)).astype(np.int64)  # sums of integers: exact
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                part = ids[first: first + len(texts)]
                score = weight + np.array([noise(i, seed) for i in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *(pa.array(np.asarray(c, np.int64)) for c in (words, n, weight, score))],
                                                 ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        weigh, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where a row is not drawn.

    Drawn are floor(percent * N / 100) rows of the N rows with at least ``least_words`` words: the
    highest scores, ties to the smaller doc_id (null last), then to the smaller weight and number of features; rows equal in all of these
    may be drawn in either order.  Null and empty texts have no features, weight 0 and are not
    drawn.  An empty target counts no features; an empty table gives an empty result.

    Ranks need no sort of all rows: scores are whole thousandths, of which the gains'
    logarithm and 32 bits of noise allow about a hundred thousand different ones.
    Their counts give each score's first rank; rows are ordered within a score.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    rows = stored(weights(docs, gain, seed), f"{shared_dir(spark)}/weights")
    of_score = {r.score: r.n for r in rows.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = percent * sum(of_score.values()) // 100
    before, first = 0, []
    for score in sorted(of_score, reverse=True):
        if before >= drawn:
            break
        first.append((score, before))
        before += of_score[score]
    able = F.col("n_words") >= least_words
    lowest = F.lit(first[-1][0] if first else None).cast("long")
    near = F.coalesce(able & (F.col("score") >= lowest), F.lit(False))
    within = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "weight", "n_features")
    starts = F.broadcast(spark.createDataFrame(first, "score long, before long"))
    ranked = rows.where(near).join(starts, "score").withColumn("rank", F.col("before") + F.row_number().over(within))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(rows.where(~near).withColumn("rank", F.lit(None).cast("long")).select(*cols))


def sample(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that share a drawn row's doc_id come with it."""
    ids = resample(docs, target, **how).where("rank is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")

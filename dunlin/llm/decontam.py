"""Benchmark decontamination by suffix arrays of the training words.

Each slice of the documents (about 1 MB) is a shard: its words become numbers,
and a suffix array (sorted to the depth of a window) is built over the positions
where a match can begin, that is where enough benchmark words follow one another.
Every suffix of every benchmark item is then binary-searched in every shard.
Shards are read where they lie, so documents are never shuffled; the benchmark is
the stated query set and goes to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunlin.llm.shared import column, row_key, slices, text_buffer, without
from dunlin.llm.words import Hasher, U, alnum_words, counts_of

WINDOW = 10
BLOCK_BYTES = 2_000_000  # benchmark text sent to the tasks at once


class Tests:
    """Windows of a benchmark block: distinct keys, their length, and the items that hold them."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hasher = Hasher(alnum_words())
        data, offs = text_buffer(pa.array([t or "" for _, t in items], pa.large_string()))
        h, rows, _, _ = hasher.words(data, offs)
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h).astype(np.int64) + 1
        n = counts_of(rows, len(items))
        keys, owner, at = [], [], []
        first = np.concatenate([[0], np.cumsum(n)])
        for k in range(len(items)):
            w = ids[first[k]: first[k + 1]]
            size = min(window, len(w))
            for s in range(len(w) - size + 1 if size else 0):
                keys.append(tuple(w[s: s + size].tolist()))
                owner.append(k)
                at.append(s)
        distinct = sorted(set(keys))
        number = {key: i for i, key in enumerate(distinct)}
        self.size = np.array([len(k) for k in distinct], np.int64)
        self.low = _keys([list(k) + [0] * (window - len(k)) for k in distinct], window)
        self.high = _keys([list(k) + [0xFFFFFFFF] * (window - len(k)) for k in distinct], window)
        self.full = [len(k) == window for k in distinct]
        of = np.array([number[k] for k in keys], np.int64)
        order = np.argsort(of, kind="stable")
        self.owner, self.at = np.array(owner, np.int64)[order], np.array(at, np.int64)[order]
        self.cut = np.searchsorted(of[order], np.arange(len(distinct) + 1))
        starts = sorted({k[0] for k in distinct if len(k) < window})
        self.short_start = np.zeros(len(self.vocab) + 1, bool)
        self.short_start[starts] = True
        self.ids = [str(i) for i, _ in items]
        self.window = window


def _keys(rows: list[list[int]], window: int) -> np.ndarray:
    """Word numbers as fixed-width byte strings that sort like the sequences."""
    a = np.array(rows, np.int64).reshape(len(rows), window).astype(">u4")
    return np.frombuffer(a.tobytes(), f"S{4 * window}")


def _matches(tests: Tests, h: np.ndarray, rows: np.ndarray):
    """(position in the shard, distinct window) of every occurrence."""
    none = np.zeros(0, np.int64)
    if not len(h) or not len(tests.vocab):
        return none, none
    at = np.searchsorted(tests.vocab, h)
    ids = np.where(tests.vocab[np.minimum(at, len(tests.vocab) - 1)] == h, at + 1, 0)
    n, w = len(ids), tests.window
    stop = (ids == 0)
    last = np.concatenate([rows[1:] != rows[:-1], [True]])
    ends = np.where(stop, np.arange(n), np.where(last, np.arange(1, n + 1), n + 1))
    limit = np.minimum.accumulate(ends[::-1])[::-1]
    run = limit - np.arange(n)  # known words from here on in the same row
    starts = np.flatnonzero((run >= w) | (tests.short_start[ids] & (run > 0)))
    if not len(starts):
        return none, none
    grid = starts[:, None] + np.arange(w)
    words = np.where(grid < limit[starts][:, None], ids[np.minimum(grid, n - 1)], 0)
    keys = np.frombuffer(np.ascontiguousarray(words.astype(">u4")).tobytes(), f"S{4 * w}")
    array = np.argsort(keys, kind="stable")  # the shard's suffix array
    ordered = keys[array]
    lo, hi = np.searchsorted(ordered, tests.low, "left"), np.searchsorted(ordered, tests.high, "right")
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return none, none
    many = (hi - lo)[found]
    which = np.repeat(found, many)
    pos = array[np.repeat(lo[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    return starts[pos], which


def _blocks(benchmark: DataFrame):
    """The benchmark in blocks of about BLOCK_BYTES, by a hash of the item."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for k in range(n):
        part = b if n == 1 else b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield k, sorted((r[0] or "", r[1]) for r in part.toLocalIterator())


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, by: str = "doc_id") -> DataFrame:
    """One row per document: ``by``, n_words, n_hit, items (sorted ids), spans.

    Words: A-Z lower-cased, digits, letters and all beyond ASCII.  A window is
    ``window`` consecutive words of an item, or the whole of a shorter one; a document's
    word inside any occurrence is hit.  spans are the longest verbatim matches:
    item_id, item_word, word, n_words.  Null or wordless texts have no words and no
    matches; repeated rows come out as often as they came in; an empty benchmark hits
    nothing.

    The benchmark goes to the tasks in blocks of about BLOCK_BYTES; documents are read and their words hashed
    once, whatever the number of blocks, and a shard is searched for one block after another.
    """
    return _scan(docs, benchmark, window, by).drop("row_key")


def _scan(docs: DataFrame, benchmark: DataFrame, window: int, by: str) -> DataFrame:
    """:func:`scan` with the row's key."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(items) for _, items in _blocks(benchmark)]  # at most about BLOCK_BYTES each

    def run(batches):
        every, hasher = [Tests(x.value, window) for x in sent], Hasher(alnum_words())
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            ids = column(batch, by)
            for a, b in slices(offs):
                h, rows, _, _ = hasher.words(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])
                n = counts_of(rows, b - a)
                first = np.concatenate([[0], np.cumsum(n)])
                hit = np.zeros(len(h), bool)
                found: list[set[str]] = [set() for _ in range(b - a)]
                spans: list[list[dict]] = [[] for _ in range(b - a)]
                for tests in every:
                    pos, which = _matches(tests, h, rows)
                    if len(pos):
                        hit |= _covered(len(h), pos, tests.size[which])
                        for r, span in _spans(tests, pos, which, rows, first):
                            found[r].add(span["item_id"])
                            spans[r].append(span)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(np.bincount(rows[hit], minlength=b - a), pa.int64()),
                     pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                     pa.array(spans, pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("n_words", pa.int64())]))),
                     column(batch, "row_key").slice(a, b - a)],
                    [by, "n_words", "n_hit", "items", "spans", "row_key"])

    kind = dict(docs.dtypes)[by]
    return docs.select(by, "text", row_key(by).alias("row_key")).mapInArrow(
        run, f"{by} {kind}, n_words long, n_hit long, items array<string>, spans array<struct<item_id:string,item_word:long,word:long,n_words:long>>, row_key string")


def _covered(n: int, pos: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Words inside any of the occurrences at pos, of that many words."""
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, pos, 1)
    np.add.at(mark, pos + size, -1)
    return np.cumsum(mark[:-1]) > 0


def _spans(tests: Tests, pos: np.ndarray, which: np.ndarray, rows: np.ndarray, first: np.ndarray):
    """(row, longest verbatim match) of the occurrences: windows of an item that follow one another are one match."""
    many = (tests.cut[1:] - tests.cut[:-1])[which]
    flat = np.repeat(tests.cut[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    p, item, off, size = np.repeat(pos, many), tests.owner[flat], tests.at[flat], np.repeat(tests.size[which], many)
    row = rows[p]
    order = np.lexsort((p, p - off, item, row))
    p, item, off, size, row = p[order], item[order], off[order], size[order], row[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | ((p - off)[1:] != (p - off)[:-1]) | (p[1:] != p[:-1] + 1)])
    at = np.flatnonzero(new)
    for s, e in zip(at, np.append(at[1:], len(p)) - 1):
        yield int(row[s]), {"item_id": tests.ids[item[s]], "item_word": int(off[s]), "word": int(p[s] - first[row[s]]), "n_words": int(p[e] - p[s] + size[e])}


def flagged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Query form of :func:`scan`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    return scan(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["n_words"])), F.lit(0)).cast("long").alias("longest"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text has a hit word; columns as they were."""
    return without(docs, _scan(docs, benchmark, window, "doc_id").where("n_hit > 0").select(F.col("row_key").alias("__row")))

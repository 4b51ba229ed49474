"""Substring deduplication by hashing of text units.

Units are the lines of a text and, beside them, chunks of some words.  A chunk begins at a word
that is the least of any WINDOW words in a row (by a sum over its bytes and those of the word before), so a passage is cut alike
wherever it stands, and two windows' length of it holds a whole chunk.  Units
are normalised (A-Z lower-cased, white space runs to one space, trimmed) and hashed to 128 bits; equal
digests are grouped over all documents, and the occurrence with the smallest (rank, place) stays.

Every line that occurred before goes, however short.  Repeated chunks that follow one
another are a run; a run is extended word by word, on both sides, as far as its
text and the text around its first occurrence agree, so a passage glued into other sentences counts in
full.  A run of enough words is a passage and goes too.  (A repeated paragraph is repeated lines.)
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunlin.llm.shared import column, shared_dir, slices, stored, text_buffer
from dunlin.llm.words import Hasher, U, mix, space_words

WINDOW = 25  # words of which one begins a chunk; chunks have 13 words on average
MOST = 2 * WINDOW  # words that a chunk can have
LEAST_RUN = 8  # words of repeated chunks that are looked at as a passage
LEAST_PASSAGE = 25  # words of a passage
LINE, CHUNK = 0, 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")

ROW = ["did", "th"]  # a row of documents: doc_id (LAST if null) and a hash of its text
LAST = (1 << 63) - 1


def cuts(size: np.ndarray, first: np.ndarray, last: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a word is the first of a chunk; from the words' bytes: number, first, last.

    Of each WINDOW words of a row the one with the least sum begins a chunk, of equal ones the last; so does a row's first word."""
    n = len(size)
    if not n:
        return np.zeros(0, bool)
    starts = np.concatenate([[True], row[1:] != row[:-1]])
    if n >= WINDOW:
        before = lambda x: np.where(starts, 0, np.concatenate([[0], x[:-1]]))
        value = ((131 * size + 31 * last + 17 * first + 7 * before(last) + 3 * before(first)) % 251).astype(np.int32) * 64
        near = np.lib.stride_tricks.sliding_window_view(value, WINDOW) + np.arange(WINDOW - 1, -1, -1, dtype=np.int32)
        least = near.min(1) % 64  # distance from the window's end
        inside = row[: n - WINDOW + 1] == row[WINDOW - 1:]
        at = np.arange(WINDOW - 1, n) - least
        starts[at[inside]] = True
    return starts


def _digests(hasher: Hasher, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the word sequences start to end."""
    out = []
    for x in (h, mix(h ^ U(0x5851F42D4C957F2D))):
        acc = np.concatenate([np.zeros(1, U), np.cumsum(x * hasher.pw[: len(x)], dtype=U)])
        out.append(mix((acc[end] - acc[start]) * hasher.ipw[start] + (end - start).astype(U)).view(np.int64))
    return out[0], out[1]


def identified(docs: DataFrame) -> DataFrame:
    """did, th and text of every row; rows of one doc_id with different texts are different rows (a doc_id of 2^63 - 1 counts as null)."""
    return docs.select(*_identity(docs), docs["text"])


def _identity(docs: DataFrame) -> list:
    did = F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST))
    return [did.alias("did"), F.hash(docs["text"], did == LAST).cast("long").alias("th")]


UNITS = ["key", "span", "n_words", "d1", "d2"]


def units(rows: DataFrame) -> DataFrame:
    """did, key, span, n_words, d1, d2 of every line with words and every chunk, packed as they are shuffled twice.

    key is the text's hash and the place (twice the number of words before, one more for a chunk), 32 bits each; span the
    start and the end in code points, end exclusive, without the white space around."""
    def run(batches):
        hasher, low = Hasher(space_words()), np.arange(256)
        low[65:91] += 32
        for batch in batches:
            data, offs = text_buffer(column(batch, "text"))
            for a, b in slices(offs):
                body, at = data[offs[a]: offs[b]], offs[a: b + 1] - offs[a]
                h, row, ws, we = hasher.words(body, at)
                if not len(h):
                    continue
                point = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])  # code points before a byte
                base, line = point[at[:-1]], np.cumsum(body == 10)[ws]
                new_row = np.concatenate([[True], row[1:] != row[:-1]])
                word_of_row = np.arange(len(h)) - np.maximum.accumulate(np.where(new_row, np.arange(len(h)), 0))
                new_line = new_row | np.concatenate([[False], line[1:] != line[:-1]])
                found = []
                for kind, starts in ((LINE, new_line), (CHUNK, cuts(we - ws, low[body[ws]], low[body[we - 1]], row))):
                    s = np.flatnonzero(starts)
                    e = np.append(s[1:], len(h))
                    r = row[s]
                    d1, d2 = _digests(hasher, h, s, e)
                    found.append((r, 2 * word_of_row[s] + kind, (point[ws[s]] - base[r]) << 32 | point[we[e - 1]] - base[r], e - s, d1 ^ kind, d2))
                r, place, *cols = (np.concatenate(c) for c in zip(*found))
                own = pa.array(r + a)
                key = column(batch, "th").take(own).to_numpy() << 32 | place
                yield pa.RecordBatch.from_arrays([column(batch, "did").take(own), pa.array(key)] + [pa.array(c.astype(np.int64)) for c in cols], ["did"] + UNITS)

    return rows.mapInArrow(run, "did long, " + ", ".join(f"`{c}` long" for c in UNITS))


def _unpacked(u: DataFrame) -> DataFrame:
    """th, kind, word0, start, end of a unit's key and span."""
    place = F.col("key").bitwiseAND(0xFFFFFFFF)
    return u.withColumns({"th": F.shiftright("key", 32), "kind": place.bitwiseAND(1), "word0": F.shiftright(place, 1),
                          "start": F.shiftright("span", 32), "end": F.col("span").bitwiseAND(0xFFFFFFFF)}).drop("key", "span")


def _around(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """side, pos, words, places for each asked (row, side, pos): 32-bit hashes of the at most MOST words before (side 0, nearest
    first) or after (side 1) a place in the row's text, and how far from it each begins (0) or ends (1)."""
    def run(batches):
        import zlib
        for batch in batches:
            out = []
            keys = list(zip(*(column(batch, c).to_pylist() for c in ROW)))
            for key, text, asks in zip(keys, column(batch, "text").to_pylist(), column(batch, "asks").to_pylist()):
                found = [(m.start(), m.end(), m.group().encode().lower()) for m in WORD.finditer(text or "")]
                begins = np.array([f[0] for f in found])
                for ask in asks:
                    k = int(np.searchsorted(begins, ask["pos"]))
                    near = found[max(k - MOST, 0): k][::-1] if ask["side"] == 0 else found[k: k + MOST]
                    out.append((*key, ask["side"], ask["pos"], [zlib.crc32(f[2]) - (1 << 31) for f in near], [abs(f[ask["side"]] - ask["pos"]) for f in near]))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*ROW, "side", "pos", "words", "places"])

    asks = asked.distinct().groupBy(*ROW).agg(F.collect_list(F.struct("side", "pos")).alias("asks"))
    answers = rows.join(asks, ROW).mapInArrow(run, "did long, th long, side long, pos long, words array<int>, places array<int>")
    return answers.dropDuplicates([*ROW, "side", "pos"])  # repeated rows answer twice


def repeated(docs: DataFrame, least_passage: int = LEAST_PASSAGE, least_run: int = LEAST_RUN) -> DataFrame:
    """did, th, kind, start, end, n_words, keeper of all that goes: repeated lines (kind 0) and passages (kind 1).

    Rank is doc_id, null last, then a hash of the text: the row of smallest rank keeps a unit, and of one row the first place.  keeper
    is the doc_id (LAST: null) of the row that keeps the line, or a passage's first chunk.  Rows that repeat a doc_id and its text are one row; null and empty
    texts have no units, an empty table has nothing to remove.  First occurrences are minima that combine before the shuffle; only digests that
    occur twice or more are joined back, so a line of a third of all rows costs a row per occurrence, and nothing is
    gathered but a row's own places.  A passage is found if its whole chunks have ``least_run`` words or more: nearly always from
    two windows (50 words) on, mostly from 30 words on."""
    folder = shared_dir(docs.sparkSession)
    rows = identified(docs)
    u = stored(units(rows), f"{folder}/units")
    me = F.struct("did", "key", "span")
    first = u.groupBy("d1", "d2").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = u.join(first, ["d1", "d2"]).where((F.col("did") != F.col("first.did")) | (F.col("key") != F.col("first.key"))).drop("d1", "d2")
    again = stored(again, f"{folder}/again")
    again = _unpacked(again).withColumn("first", F.struct(F.col("first.did").alias("did"), F.shiftright("first.key", 32).alias("th"),
                                                          F.shiftright("first.span", 32).alias("start"), F.col("first.span").bitwiseAND(0xFFFFFFFF).alias("end")))
    lines = again.where(F.col("kind") == LINE).select(*ROW, "kind", "start", "end", "n_words", F.col("first.did").alias("keeper")).distinct()
    chunks = again.where(F.col("kind") == CHUNK).select(*ROW, "word0", "start", "end", "n_words", "first").distinct()  # repeated rows are one
    of_row = Window.partitionBy(*ROW).orderBy("word0")
    new = F.when(F.lag(F.col("word0") + F.col("n_words")).over(of_row) == F.col("word0"), 0).otherwise(1)
    runs = chunks.withColumn("new", new).withColumn("island", F.sum("new").over(of_row)).groupBy(*ROW, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"),
        F.min(F.struct("word0", "first"))["first"].alias("head"), F.max(F.struct("word0", "first"))["first"].alias("tail"))
    runs = stored(runs.where(F.col("n_words") >= least_run), f"{folder}/runs")
    places = [(ROW, "start", 0), ([f"head.{c}" for c in ROW], "head.start", 0), (ROW, "end", 1), ([f"tail.{c}" for c in ROW], "tail.end", 1)]
    asked = None
    for key, pos, side in places:
        one = runs.select(*(F.col(k).alias(c) for k, c in zip(key, ROW)), F.lit(side).cast("long").alias("side"), F.col(pos).alias("pos"))
        asked = one if asked is None else asked.unionByName(one)
    around = stored(_around(rows, asked), f"{folder}/around")
    j = runs
    for k, (key, pos, side) in enumerate(places):
        own = [F.col("places").alias(f"places{k}")] if key is ROW else []
        a = around.where(F.col("side") == side).select(*(F.col(c).alias(f"{c}{k}") for c in (*ROW, "pos")), F.col("words").alias(f"words{k}"), *own)
        on = F.col(pos) == F.col(f"pos{k}")
        for x, c in zip(key, ROW):
            on = on & (F.col(x) == F.col(f"{c}{k}"))
        j = j.join(a, on)
    # words that agree, nearest first
    same = lambda a, b: F.array_position(F.array_append(F.zip_with(F.slice(a, 1, F.least(F.size(a), F.size(b))), b, lambda x, y: x.eqNullSafe(y)), F.lit(False)), False) - 1
    j = j.withColumn("left", same("words0", "words1")).withColumn("right", same("words2", "words3")).withColumn("n_words", F.col("n_words") + F.col("left") + F.col("right"))
    passages = j.where(F.col("n_words") >= least_passage).select(
        *ROW, F.lit(CHUNK).cast("long").alias("kind"), F.when(F.col("left") > 0, F.col("start") - F.get("places0", (F.col("left") - 1).cast("int"))).otherwise(F.col("start")).alias("start"),
        F.when(F.col("right") > 0, F.col("end") + F.get("places2", (F.col("right") - 1).cast("int"))).otherwise(F.col("end")).alias("end"), "n_words",
        F.col("head.did").alias("keeper"))
    return lines.unionByName(passages)


def merged(gone: DataFrame) -> DataFrame:
    """did, th, start, end of the union of overlapping spans, row by row."""
    before = Window.partitionBy(*ROW).orderBy("start", "end")
    reach = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    numbered = gone.select(*ROW, "start", "end").distinct().withColumn("new", new).withColumn("island", F.sum("new").over(before))
    return numbered.groupBy(*ROW, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, line_words, n_passages, longest_passage, n_removed, spans of every row: repeated lines and their
    words, passages and the words of the longest, and the code points that go with their places (``start:end``, joined by commas)."""
    gone = stored(repeated(docs, **how))
    line = F.col("kind") == LINE
    counts = gone.groupBy(*ROW).agg(
        F.count(F.when(line, 1)).alias("n_lines"), F.sum(F.when(line, F.col("n_words"))).alias("line_words"),
        F.count(F.when(~line, 1)).alias("n_passages"), F.max(F.when(~line, F.col("n_words"))).alias("longest_passage"))
    spans = merged(gone).groupBy(*ROW).agg(F.sum(F.col("end") - F.col("start")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s"))
    spans = spans.select(*ROW, "n_removed", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))
    j = identified(docs).select(*ROW).join(counts.join(spans, ROW), ROW, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return j.select(F.when(F.col("did") != LAST, F.col("did")).alias("doc_id"), *(zero(c) for c in ("n_lines", "line_words", "n_passages", "longest_passage", "n_removed")),
                    F.coalesce("spans", F.lit("")).alias("spans"))


def cleaned(docs: DataFrame, spans: str = "removed_spans", **how) -> DataFrame:
    """``docs`` with all that goes cut out of text, and a column ``spans`` of the (start, end) cut out of the original, null where
    nothing was; n_chars, if there is such a column, counts the new text.  Raises if there is a column of that name."""
    if spans in docs.columns:
        raise ValueError(f"there is a column {spans}")
    gone = merged(repeated(docs, **how)).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__cut"))
    sub = lambda a, n: F.substr("text", a.cast("int"), n.cast("int"))
    # what stays lies between the spans
    from_ = F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda s: s["end"]))
    to = F.array_append(F.transform("__cut", lambda s: s["start"]), F.length("text").cast("long"))
    kept = F.array_join(F.transform(F.arrays_zip(from_.alias("a"), to.alias("b")), lambda x: sub(x["a"] + 1, x["b"] - x["a"])), "")
    keyed = docs.withColumns({f"__{c}": x for c, x in zip(ROW, _identity(docs))})
    j = keyed.join(gone.select(*(F.col(c).alias(f"__{c}") for c in ROW), "__cut"), [f"__{c}" for c in ROW], "left")
    changed = F.col("__cut").isNotNull()
    j = j.withColumn("text", F.when(changed, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        n = F.when(changed, F.length("text")).otherwise(F.col("n_chars"))
        j = j.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return j.select(*docs.columns, F.col("__cut").alias(spans))

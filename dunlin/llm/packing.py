"""Hierarchical multi-length packing of token ids.

A document's ids (with the end id) give full windows of the longest context size;
its rest goes to the tier of the smallest context size that holds it.  Tiers are
packed from the longest down: each rest opens a window of its tier, and the gap is
filled from shorter tiers, cut where nothing fits whole.  Windows are powers of two,
so what a task has left at its end splits into exact windows and padding is zero
where documents can be cut freely.  Each task packs the rows that it reads: ids
are never shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dunlin.llm.shared import column, slices, text_buffer
from dunlin.llm.words import BASE, BASE_INV, U, mix

TIERS = (2048, 1024, 512, 256)


LETTER, NUMBER, SPACE, OTHER, BLANK, QUOTE, ODD = range(7)  # classes of bytes; BLANK is U+0020 alone


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte's character; ODD where the tokenizer's own splitting is needed.

    ODD: white space beyond ASCII, code points that Unicode 3.2 lacks (their
    class may differ between libraries), and those beyond U+FFFF.
    """
    import unicodedata

    import regex
    letter, number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    ascii_class = np.full(256, ODD, np.uint8)
    for c in range(128):
        ascii_class[c] = (LETTER if chr(c).isalpha() else NUMBER if chr(c).isdigit() else BLANK if c == 32 else SPACE if 9 <= c <= 13
                          else QUOTE if c == 39 else ODD if 0x1C <= c <= 0x1F else OTHER)
    cls = ascii_class[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        x = np.concatenate([data, np.zeros(3, np.uint8)])
        l0, l1, l2 = x[lead].astype(np.int64), x[lead + 1].astype(np.int64) & 63, x[lead + 2].astype(np.int64) & 63
        code = np.where(l0 < 0xE0, (l0 & 31) << 6 | l1, np.where(l0 < 0xF0, (l0 & 15) << 12 | l1 << 6 | l2, 0x10FFFF))
        kinds, which = np.unique(code, return_inverse=True)
        of = np.empty(len(kinds), np.uint8)
        for k, c in enumerate(kinds.tolist()):
            ch = chr(c)
            odd = c > 0xFFFF or ch.isspace() or c in (0x180E, 0x200B) or unicodedata.ucd_3_2_0.category(ch) in ("Cn", "Co", "Cs")
            of[k] = ODD if odd else LETTER if letter.match(ch) else NUMBER if number.match(ch) else OTHER
        for j in range(4):  # a character's bytes share its class
            at = lead + j
            has = at < len(data)
            has[has] = (data[at[has]] & 0xC0 == 0x80) if j else True
            has &= (j < 2) | (l0 >= 0xE0) & (j < 3) | (l0 >= 0xF0)
            cls[at[has]] = of[which[has]]
    return cls


def pretoken_starts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over texts laid end to end in UTF-8: start flags of the pre-tokens of byte-level BPE's usual
    pattern, and the texts (numbers) that need the tokenizer's own splitting."""
    n = len(data)
    cls = _byte_classes(data)
    odd = np.unique(np.searchsorted(offs, np.flatnonzero(cls == ODD), "right") - 1)
    first = offs[:-1][np.diff(offs) > 0]
    blank, quote = cls == BLANK, np.flatnonzero(cls == QUOTE)
    cls[quote] = OTHER
    kind = np.where(blank, np.uint8(SPACE), cls)
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 9, kind[:-1]
    prev[first] = 9
    nxt = np.empty(n, np.uint8)
    nxt[-1], nxt[:-1] = 9, kind[1:]
    nxt[first[1:] - 1] = 9
    start = prev != kind
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    start &= ~after_blank  # a blank opens the run that follows it
    start |= (kind == SPACE) & (nxt < SPACE) | (kind == SPACE) & (nxt > SPACE) & (nxt != 9)
    start[first] = True
    if len(quote):  # contractions: an apostrophe that opens a pre-token, then s t m d re ve ll
        q = quote[start[quote]]
        x = np.concatenate([data, np.zeros(2, np.uint8)])
        end = offs[np.searchsorted(offs, q, "right")]
        a, b = np.where(q + 1 < end, x[q + 1], 0), np.where(q + 2 < end, x[q + 2], 0)
        one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
        two = (a == 114) & (b == 101) | (a == 118) & (b == 101) | (a == 108) & (b == 108)
        for at, size, until in ((q[one], 2, end[one]), (q[two], 3, end[two])):
            start[at + 1] = False
            after = (at + size)[at + size < until]
            start[after[cls[after] == LETTER]] = True
    return start, odd


class Encoder:
    """Ids of many texts, as the tokenizer file gives them.

    Texts split into pre-tokens over whole batches; each distinct one (by a 64-bit
    hash and its length) is merged once.  Texts with rare characters, or with the name of a token that was added to
    the vocabulary (an end mark written out is that token, as the tokenizer has it), go to the
    tokenizer as they are.  Tests hold both ways against the tokenizer.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [c for c in range(256) if c not in printable]
        byte_of = {chr(c): c for c in printable} | {chr(256 + k): c for k, c in enumerate(rest)}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model.get("added_tokens", [])}
        self.added = re.compile(b"|".join(re.escape(x.encode()) for x in sorted(special))) if special else None
        ranks = {bytes(byte_of[ch] for ch in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.merge = tiktoken.Encoding("file", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.of_byte = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
        self.pw = np.cumprod(np.concatenate([np.ones(1, U), np.full(1 << 20, BASE, U)]), dtype=U)
        self.ipw = np.cumprod(np.concatenate([np.ones(1, U), np.full(1 << 20, BASE_INV, U)]), dtype=U)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
        n_texts = len(offs) - 1
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * n_texts
        hashes, starts, sizes, odd = [], [], [], []
        for a, b in slices(offs, most_rows=1 << 30):
            x = data[offs[a]: offs[b]]
            if not len(x):
                continue
            start, strange = pretoken_starts(x, offs[a: b + 1] - offs[a])
            odd.append(strange + a)
            at = np.flatnonzero(start)
            end = np.append(at[1:], len(x))
            if len(x) >= len(self.pw):
                self.pw = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(x), BASE, U)]), dtype=U)
                self.ipw = np.cumprod(np.concatenate([np.ones(1, U), np.full(len(x), BASE_INV, U)]), dtype=U)
            acc = np.empty(len(x) + 1, U)
            acc[0] = 0
            np.cumsum(self.of_byte[x] * self.pw[: len(x)], out=acc[1:])
            hashes.append(mix((acc[end] - acc[at]) * self.ipw[at] + (end - at).astype(U)))
            starts.append(at + offs[a])
            sizes.append(end - at)
        if not hashes:
            return out
        at, size = np.concatenate(starts), np.concatenate(sizes)
        _, one, order = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = [self.merge(raw[p: p + k]) for p, k in zip(at[one].tolist(), size[one].tolist())]
        many_of = np.array([len(x) for x in ids])
        pool = np.fromiter(chain.from_iterable(ids), np.uint32, int(many_of.sum()))
        base = np.cumsum(many_of) - many_of
        many = many_of[order]
        ends = np.cumsum(many)
        every = pool[np.repeat(base[order] - (ends - many), many) + np.arange(ends[-1])]
        begin = np.concatenate([[0], ends])
        of_text = begin[np.searchsorted(at, offs)].tolist()
        for k in range(n_texts):
            out[k] = every[of_text[k]: of_text[k + 1]]
        if self.added:
            odd.append(np.searchsorted(offs, [m.start() for m in self.added.finditer(raw)], "right") - 1)
        odd = np.unique(np.concatenate(odd)).astype(np.int64).tolist()
        for k, x in zip(odd, self.whole([raw[offs[k]: offs[k + 1]].decode() for k in odd])):
            out[k] = np.array(x, np.uint32)
        return out


class Packer:
    """Places pieces [row, start, length] into windows; ``done`` holds finished (tier, pieces)."""

    def __init__(self, tiers=TIERS):
        self.tiers = tiers
        self.waiting: list[deque] = [deque() for _ in tiers]
        self.done: list[tuple[int, list]] = []

    def add(self, row, length: int) -> None:
        top, at = self.tiers[0], 0
        while length - at >= top:
            self.done.append((top, [(row, at, top)]))
            at += top
        self._route(row, at, length - at)

    def _route(self, row, start: int, length: int) -> None:
        """To the smallest tier that holds it."""
        if length:
            t = max(k for k, size in enumerate(self.tiers) if size >= length)
            self.waiting[t].append((row, start, length))

    def _filler(self, t: int, gap: int):
        """A piece of at most ``gap`` for a window of tier t: shorter tiers first, whole if possible, else cut."""
        for k in range(t + 1, len(self.tiers)):
            if self.waiting[k] and self.waiting[k][0][2] <= gap:
                return self.waiting[k].popleft()
        for k in [*range(len(self.tiers) - 1, t, -1), t]:
            if self.waiting[k]:
                row, start, length = self.waiting[k].popleft()
                if length > gap:
                    self._route(row, start + gap, length - gap)
                    length = gap
                return row, start, length
        return None

    def pack(self, last: bool) -> None:
        """Closes every window that the waiting pieces can fill; at the end all of them."""
        for t, size in enumerate(self.tiers):
            while self.waiting[t] and (last or self._held(t, size) >= size):
                pieces, room = [], size
                while room and (p := self.waiting[t].popleft() if not pieces else self._filler(t, room)):
                    pieces.append(p)
                    room -= p[2]
                if room:
                    self._split(pieces)
                else:
                    self.done.append((size, pieces))

    def _held(self, t: int, enough: int) -> int:
        total = 0
        for q in self.waiting[t:]:
            for p in q:
                total += p[2]
                if total >= enough:
                    return total
        return total

    def _split(self, pieces: list) -> None:
        """What is left at the end, as windows of exact powers of two."""
        left = sum(p[2] for p in pieces)
        todo = deque(pieces)
        while left:
            size = 1 << (left.bit_length() - 1)
            room, own = size, []
            while room:
                row, start, length = todo.popleft()
                take = min(room, length)
                own.append((row, start, take))
                room -= take
                if take < length:
                    todo.appendleft((row, start + take, length - take))
            self.done.append((size, own))
            left -= size


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers=TIERS, group: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step.

    A sequence's window is its tier (a power of two, at most tiers[0]) and it is full.
    sequence_id is unique over tasks; step numbers groups of ``group`` x tiers[0]
    ids of one task's sequences, so steps weigh the same whatever tiers they mix.
    Null and empty texts are documents of the end id alone; repeated rows are
    packed each; an empty table gives no rows.  A task holds one batch's ids.
    """

    def run(batches):
        from pyspark import TaskContext
        encoder = Encoder(tokenizer)
        packer = Packer(tiers)
        task = TaskContext.get().partitionId()
        state = {"seq": 0, "weight": 0}
        ids_of: dict[int, tuple] = {}
        row_no = 0

        def flush():
            cols: list[list] = [[] for _ in range(9)]
            for size, pieces in packer.done:
                seq = (task << 36) + state["seq"]
                step = (task << 36) + state["weight"] // (group * tiers[0])
                state["seq"] += 1
                state["weight"] += size
                at = 0
                for row, start, length in pieces:
                    doc, ids = ids_of[row]
                    crc = zlib.crc32(ids[start: start + length])
                    for c, v in zip(cols, (doc, start, length, crc, len(ids), seq, at, size, step)):
                        c.append(v)
                    at += length
            packer.done = []
            alive = {p[0] for q in packer.waiting for p in q}
            for r in [r for r in ids_of if r not in alive]:
                del ids_of[r]
            for a in range(0, len(cols[0]), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a: a + 10_000], pa.int64()) for c in cols], NAMES)

        for batch in batches:
            doc = column(batch, "doc_id").to_pylist()
            data, offs = text_buffer(column(batch, "text"))
            for a, b in slices(offs, 1 << 23, 1 << 30):
                for d, ids in zip(doc[a:b], encoder.encode(data[offs[a]: offs[b]], offs[a: b + 1] - offs[a])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    ids_of[row_no] = (d, ids)
                    packer.add(row_no, len(ids))
                    row_no += 1
                packer.pack(False)
                yield from flush()
        packer.pack(True)
        yield from flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"`{c}` long" for c in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "step"]

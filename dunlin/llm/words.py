"""Words, word hashes and shingles of many texts at once, on raw UTF-8 bytes.

Words are maximal runs of word bytes inside one row.  Both word definitions in
use treat all bytes from 0x80 on alike, so working on bytes equals working on
code points.  A word's hash is a polynomial over its bytes, then a mix; hashes
depend on the word alone, not on the batch or the process.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
SHINGLE_BITS = 54


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def space_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (lower-cased text)."""
    t = np.ones(256, bool)
    t[0x00:0x30] = t[0x3A:0x61] = t[0x7B:0x80] = False
    return t


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Hasher:
    """Keeps the powers that the polynomial needs; one per task."""

    def __init__(self, word_bytes: np.ndarray):
        self.word_bytes, self.lower = word_bytes, lower_table()
        self.of_byte = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
        self._grow(1 << 20)

    def _grow(self, n: int) -> None:
        self.pw = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, BASE, U)]), dtype=U)
        self.ipw = np.cumprod(np.concatenate([np.ones(1, U), np.full(n, BASE_INV, U)]), dtype=U)

    def words(self, data: np.ndarray, offs: np.ndarray):
        """Per word: hash, row, start byte, end byte; ``data`` is one slice from byte 0 of its first row."""
        n = len(data)
        if n > len(self.pw) - 1:
            self._grow(n)
        low = self.lower[data]
        is_word = self.word_bytes[low]
        if not is_word.any():
            z = np.zeros(0, np.int64)
            return np.zeros(0, U), z, z, z
        before = np.empty(n, bool)
        before[0], before[1:] = False, is_word[:-1]
        cuts = offs[:-1][offs[:-1] < n]
        before[cuts] = False
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, is_word[1:]
        after[offs[1:][offs[1:] > 0] - 1] = False
        starts = np.flatnonzero(is_word & ~before)
        ends = np.flatnonzero(is_word & ~after) + 1
        acc = np.empty(n + 1, U)
        acc[0] = 0
        np.cumsum(self.of_byte[low] * self.pw[:n], out=acc[1:])
        h = mix((acc[ends] - acc[starts]) * self.ipw[starts] + (ends - starts).astype(U))
        rows = np.searchsorted(offs, starts, "right") - 1
        return h, rows, starts, ends


def counts_of(rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, minlength=n_rows)


def shingles(h: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles by row: (row, 54-bit hash), sorted by both.

    A row of fewer words has its whole sequence as one shingle; a row without
    words has none.  ``n_rows`` is at most 1024, so (row, hash) fits one integer.
    """
    mult = mix(np.arange(11, 11 + k, dtype=U)) | U(1)
    m = len(h)
    out_h, out_r = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    if m >= k:
        s = h[: m - k + 1] * mult[0]
        for j in range(1, k):
            s = s + h[j: m - k + 1 + j] * mult[j]
        same = rows[: m - k + 1] == rows[k - 1:]
        out_h.append(mix(s[same]))
        out_r.append(rows[: m - k + 1][same])
    n_words = counts_of(rows, n_rows)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        first = np.searchsorted(rows, short)
        s = np.zeros(len(short), U)
        for j in range(k - 1):
            has = n_words[short] > j
            s[has] += h[first[has] + j] * mult[j]
        out_h.append(mix(s + n_words[short].astype(U) * U(0xA24BAED4963EE407)))
        out_r.append(short)
    key = (np.concatenate(out_r).astype(U) << U(SHINGLE_BITS)) | (np.concatenate(out_h) >> U(64 - SHINGLE_BITS))
    key.sort()
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U(SHINGLE_BITS)).astype(np.int64), (key & U((1 << SHINGLE_BITS) - 1)).astype(np.int64)

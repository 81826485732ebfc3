"""Words and hashes of many texts at once, as numpy arrays over one Arrow column.

The texts of a slice lie behind each other in one byte buffer. Words are maximal runs of
bytes outside ``20 09-0D``; A-Z is lower-cased. A word's hash is a polynomial over its
bytes modulo 2^64, taken from one running sum over the buffer, so no Python object is made
for a word. Nulls count as empty texts, which have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class _Powers:
    """base^i and base^-i modulo 2^64, grown when a longer slice comes."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 1)
            step = np.full(size, _BASE, np.uint64)
            back = np.full(size, _BASE_INV, np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls become empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each (a longer text stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Words:
    """Words of the rows [a, b): ``start``/``end`` (bytes in the slice), ``row`` (from 0),
    ``hash``, and ``per_row`` counts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACE, lower: bool = True) -> None:
        self.rows = len(offsets) - 1
        self.bytes = _LOWER[raw] if lower else raw
        n = len(raw)
        word = ~breaks[raw]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = word[:-1]
            after[:-1] = word[1:]
            inner = offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            before[inner] = False
            after[inner - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.per_row = np.bincount(self.row, minlength=self.rows)
        up, self._down = _POWERS.upto(n + 1)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + _U(1)) * up[:n], out=self._sum[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sum[end] - self._sum[start]) * self._down[start])

    def first_of_row(self) -> np.ndarray:
        """Index of each row's first word, with the total at the end."""
        out = np.zeros(self.rows + 1, np.int64)
        np.cumsum(self.per_row, out=out[1:])
        return out


def words_of(col: pa.Array, breaks: np.ndarray = _SPACE, limit: int = SLICE_BYTES,
             lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = buffers(col)
    for a, b in slices(offsets, limit):
        o = offsets[a:b + 1]
        yield a, b, Words(raw[o[0]:o[-1]], o - o[0], breaks, lower)


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words per row, sorted by (row, hash).

    A row with fewer words has one shingle, its whole sequence; a row without words has
    none. Returns (row, hash, shingles per row)."""
    n = len(w.hash)
    rows, per, first = w.rows, w.per_row, w.first_of_row()[:-1]
    starts = max(n - size + 1, 0)
    h = np.zeros(starts, np.uint64)
    for j in range(size):
        h = h * _U(0xD1342543DE82EF95) + w.hash[j:j + starts]
    row = w.row[:starts]
    whole = np.ones(starts, bool)
    if starts:
        whole = w.row[size - 1:size - 1 + starts] == row
    hs, rs = [mix(h[whole] + _U(size))], [row[whole]]
    short = np.flatnonzero((per > 0) & (per < size))
    for k in range(1, size):
        some = short[per[short] == k]
        if len(some):
            s = np.zeros(len(some), np.uint64)
            for j in range(k):
                s = s * _U(0xD1342543DE82EF95) + w.hash[first[some] + j]
            hs.append(mix(s + _U(k)))
            rs.append(some)
    h, row = np.concatenate(hs), np.concatenate(rs)
    order = np.argsort(h)
    order = order[np.argsort(row[order].astype(np.uint16 if rows < 65536 else np.int64), kind="stable")]
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return row, h, np.bincount(row, minlength=rows)

"""Fill-in-middle transformation over a wavelet matrix of character classes (operator 13).

The texts of a slice lie behind each other in one byte buffer; every byte has one of eight
classes (letter, digit, blank, newline, sentence mark, other, first byte of a longer
character, further byte of one). A wavelet matrix over the classes answers rank (how many
bytes of a class before a place) and select (the place of the k-th). Ranks combine into
counts of unit boundaries and of code points, so the number of units of a text, both cuts
and the lengths in code points come from a few queries per text, for all texts of a slice
at once. A unit that ends with one class is cut by select, one that ends with any of
several classes by bisection on the sum of their ranks.

A document's cuts and form follow from sha256 of ``seed:doc_id`` alone, so a lost task is
redone alike, and rows may be dealt in any way.

Defined cases: a null or empty text has no units and stays plain; a text holding one of the
markers stays plain, since it could not be rebuilt; a null doc_id counts as the empty
string in the hash; repeated rows are transformed alike; texts of any length are cut whole
(a slice holds at least one text); an empty table gives no rows; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

OTHER, LETTER, DIGIT, BLANK, NEWLINE, MARK, LEAD, FURTHER = range(8)

CLASS_OF = np.zeros(256, np.uint8)
CLASS_OF[65:91] = CLASS_OF[97:123] = LETTER
CLASS_OF[48:58] = DIGIT
CLASS_OF[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
CLASS_OF[0x0A] = NEWLINE
CLASS_OF[[0x21, 0x2E, 0x3F]] = MARK
CLASS_OF[0x80:0xC0] = FURTHER
CLASS_OF[0xC0:] = LEAD

#: A unit runs up to and with the next byte of these classes, or to the end of the text.
UNITS = {"line": (NEWLINE,), "word": (BLANK, NEWLINE), "sentence": (MARK, NEWLINE)}

_W = np.uint64


@dataclass(frozen=True)
class Fim:
    seed: int = 7
    rate: int = 100                     # per cent of the texts that are transformed
    spm: int = 50                       # per cent of those with the suffix first
    unit: str = "line"
    markers: tuple[str, str, str] = ("<P>", "<S>", "<M>")


class WaveletMatrix:
    """Rank and select over a sequence of small symbols; all queries take arrays."""

    def __init__(self, symbols: np.ndarray, levels: int = 3) -> None:
        self.n, self.levels = len(symbols), levels
        self.words, self.ones, self.zeros = [], [], []
        cur = symbols
        for level in reversed(range(levels)):
            bit = (cur >> level) & 1 == 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)            # one word more, so that rank(n) has a place
            by_byte = np.packbits(bit, bitorder="little")
            packed[:len(by_byte)] = by_byte
            words = packed.view(_W)
            upto = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=upto[1:])
            self.words.append(words)
            self.ones.append(upto)
            self.zeros.append(self.n - int(upto[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])                   # a stable partition

    def _ones_before(self, level: int, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        below = (_W(1) << (i & 63).astype(_W)) - _W(1)
        return self.ones[level][w] + np.bitwise_count(self.words[level][w] & below)

    def _step(self, level: int, symbol: int, i: np.ndarray) -> np.ndarray:
        ones = self._ones_before(level, i)
        return self.zeros[level] + ones if symbol >> (self.levels - 1 - level) & 1 else i - ones

    def _start(self, symbol: int) -> np.ndarray:
        """Where the symbol's run begins below the last level."""
        s = np.zeros(1, np.int64)
        for level in range(self.levels):
            s = self._step(level, symbol, s)
        return s

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before place ``i`` (0 ... n)."""
        e = np.asarray(i, np.int64)
        for level in range(self.levels):
            e = self._step(level, symbol, e)
        return e - self._start(symbol)

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Place of occurrence ``k`` (from 0) of ``symbol``; it must exist."""
        p = self._start(symbol) + np.asarray(k, np.int64)
        for level in reversed(range(self.levels)):
            one = symbol >> (self.levels - 1 - level) & 1
            p = self._bit_place(level, p - self.zeros[level] if one else p, bool(one))
        return p

    def _bit_place(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        upto = self.ones[level]
        if not one:
            upto = np.arange(len(upto), dtype=np.int64) * 64 - upto
        w = np.searchsorted(upto, k, "right") - 1
        left = k - upto[w]
        word = self.words[level][w] if one else ~self.words[level][w]
        at = np.zeros(len(w), np.int64)
        for half in (32, 16, 8, 4, 2, 1):                                  # bisection inside the word
            low = np.bitwise_count((word >> at.astype(_W)) & ((_W(1) << _W(half)) - _W(1))).astype(np.int64)
            up = low <= left
            left = left - np.where(up, low, 0)
            at = at + np.where(up, half, 0)
        return w * 64 + at


class Boundaries:
    """Units and code points of the texts of a slice, all from ranks of the matrix."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, unit: str) -> None:
        self.matrix = WaveletMatrix(CLASS_OF[raw])
        self.a, self.b = offsets[:-1], offsets[1:]
        self.ending = UNITS.get(unit)
        if self.ending is None and unit != "char":
            raise ValueError(f"unit must be one of {[*UNITS, 'char']}, not {unit!r}")

    def chars_before(self, i: np.ndarray) -> np.ndarray:
        return np.asarray(i, np.int64) - self.matrix.rank(FURTHER, i)

    def ends_before(self, i: np.ndarray) -> np.ndarray:
        return sum(self.matrix.rank(c, i) for c in self.ending)

    def units(self) -> np.ndarray:
        """Units of each text; a last one without an ending counts."""
        if self.ending is None:
            return self.chars_before(self.b) - self.chars_before(self.a)
        upto = self.ends_before(self.b)
        open_end = (self.b > self.a) & (upto == self.ends_before(np.maximum(self.b - 1, self.a)))
        return upto - self.ends_before(self.a) + open_end

    def after(self, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Place after the first ``k`` of a text's ``n`` units."""
        out = np.where(k == 0, self.a, self.b)
        inner = np.flatnonzero((k > 0) & (k < n))
        if not len(inner):
            return out
        a, b, k = self.a[inner], self.b[inner], k[inner]
        if self.ending is None:
            out[inner] = self._least(self.chars_before, self.chars_before(a) + k + 1, a, b) - 1
        elif len(self.ending) == 1:
            out[inner] = self.matrix.select(self.ending[0], self.ends_before(a) + k - 1) + 1
        else:
            out[inner] = self._least(self.ends_before, self.ends_before(a) + k, a, b)
        return out

    @staticmethod
    def _least(count, wanted: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Least place in [lo, hi] with ``count`` of it at least ``wanted``."""
        lo, hi = lo.copy(), hi.copy()
        for _ in range(int(max(hi - lo)).bit_length()):
            mid = (lo + hi) >> 1
            enough = count(mid) >= wanted
            lo, hi = np.where(enough | (lo == hi), lo, mid + 1), np.where(enough, mid, hi)
        return hi


def draws(seed: int, doc_ids: list) -> np.ndarray:
    """h1 ... h4 of each document: the first four 32-bit numbers of sha256(``seed:doc_id``)."""
    text = [f"{seed}:{'' if i is None else i}".encode() for i in doc_ids]
    raw = b"".join(hashlib.sha256(t).digest()[:16] for t in text)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def _strings(values: list) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())               # bytes as they came, valid or not


def _transformer(p: Fim):
    pre, suf, mid = (m.encode() for m in p.markers)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = spans.buffers(batch.column(1))
            for lo, hi in spans.slices(offsets):
                o = offsets[lo:hi + 1] - offsets[lo]
                piece = raw[offsets[lo]:offsets[hi]]
                part = ids.slice(lo, hi - lo)
                h = draws(p.seed, part.to_pylist())
                units = Boundaries(piece, o, p.unit)
                n = units.units()
                one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
                first, second = units.after(np.minimum(one, two), n), units.after(np.maximum(one, two), n)
                chars = [units.chars_before(x) for x in (o[:-1], first, second)]
                text = piece.tobytes()
                out, form = [], []
                for r, (a, x, y, b) in enumerate(zip(o[:-1].tolist(), first.tolist(), second.tolist(), o[1:].tolist())):
                    t = text[a:b]
                    if not t or pre in t or suf in t or mid in t or h[r, 2] % 100 >= p.rate:
                        form.append("plain")
                        out.append(t)
                        continue
                    parts = text[a:x], text[x:y], text[y:b]
                    form.append("spm" if h[r, 3] % 100 < p.spm else "psm")
                    out.append(suf + parts[2] + pre + parts[0] + mid + parts[1] if form[-1] == "spm"
                               else pre + parts[0] + suf + parts[2] + mid + parts[1])
                plain = np.array([f == "plain" for f in form], bool)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(n), pa.array(form), pa.array(chars[1] - chars[0], mask=plain),
                     pa.array(chars[2] - chars[1], mask=plain), _strings(out)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return run


def _check(p: Fim) -> None:
    if len(set(p.markers)) != 3 or not all(p.markers):
        raise ValueError("three different markers are needed")
    for m in p.markers:                                                   # else text beside a marker could form one
        for o in p.markers:
            if (m in o and m != o) or any(m[:i] == o[-i:] for i in range(1, min(len(m), len(o)))):
                raise ValueError(f"markers {m!r} and {o!r} overlap")


def transform(docs: DataFrame, p: Fim = Fim()) -> DataFrame:
    """Each row of docs(doc_id, text) with its units ``n``, ``form`` (plain, psm, spm), lengths of
    prefix and middle in code points, and the transformed ``output``."""
    _check(p)
    return C.arrow_map(C.only(docs, doc_id="bigint", text="string"), _transformer(p),
                       "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: str | Column, form: str | Column, markers: Sequence[str] = Fim.markers) -> Column:
    """The text that ``output`` of ``form`` was made from. A transformed text holds no marker and
    markers do not overlap, so the first occurrence of each is the one put in. Bytes that are
    not UTF-8 stay as they are in ``output``, but Spark's string functions replace them here."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    pre, suf, mid = (F.lit(m) for m in markers)

    def between(left, right):
        return F.split_part(F.split_part(out, left, F.lit(2)), right, F.lit(1))

    last = F.split_part(out, mid, F.lit(2))
    return (F.when(form == "psm", F.concat(between(pre, suf), last, between(suf, mid)))
            .when(form == "spm", F.concat(between(pre, mid), last, between(suf, pre)))
            .otherwise(out))

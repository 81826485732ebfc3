"""Pattern packing by non-negative least squares (operator 8).

Texts become token ids, each followed by the end id 0, and only documents longer than a
sequence are cut. Packing then needs the histogram of piece lengths alone, at most
``capacity`` counts whatever the corpus: patterns of few lengths that fill a sequence are
enumerated, their repeat counts are fitted to the histogram by non-negative least squares
and rounded down, and what is left over is packed by best fit, again with repeat counts.
Every piece gets a rank among the pieces of its length; pattern and rank give its sequence
and offset, so pieces are placed in one narrow pass.

Defined cases: a null or empty text is the end id alone (one piece of length 1); rows with
null or repeated ids are packed as any other row; texts of any length are whole; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    max_triples: int = 30_000
    nnls_steps: int = 400
    salts: int = 64
    cache_bytes: int = 24 << 20           # ids of words that a worker remembers
    words_at_once: int = 4096             # new words given to the tokenizer in one call


class WordIds:
    """Token ids of words between white space, which this tokenizer never joins. Words seen
    before by this worker come from sorted arrays; the cache starts anew when it is full."""

    def __init__(self, path: str, most: int, at_once: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.most, self.at_once = Tokenizer.from_file(path), most, at_once
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at, self.n, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _encode(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids per word, all ids) of the words at [start, end), some at a time: an encoding holds far
        more than its ids."""
        sizes, flat = [], []
        for k in range(0, len(start), self.at_once):
            words = [raw[a:b].decode("utf-8", "replace") for a, b in
                     zip(start[k:k + self.at_once].tolist(), end[k:k + self.at_once].tolist())]
            got = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in got], np.int32))
            flat.append(np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(sizes), np.concatenate(flat)

    def __call__(self, w: spans.Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids per word)."""
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        uniq, first, back = np.unique(w.span_hash(start, end), return_index=True, return_inverse=True)
        if self.key.nbytes + self.at.nbytes + self.n.nbytes + self.ids.nbytes > self.most:
            self._reset()
        at = np.searchsorted(self.key, uniq)
        new = np.ones(len(uniq), bool)
        inside = at < len(self.key)
        new[inside] = self.key[at[inside]] != uniq[inside]
        if new.any():
            n, flat = self._encode(w.bytes.tobytes(), start[first[new]], end[first[new]])
            key = np.concatenate([self.key, uniq[new]])
            order = np.argsort(key, kind="stable")
            self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])[order]
            self.n = np.concatenate([self.n, n])[order]
            self.key, self.ids = key[order], np.concatenate([self.ids, flat])
            at = np.searchsorted(self.key, uniq)
        at = at[back]
        n = self.n[at].astype(np.int64)
        stop = np.cumsum(n)
        return self.ids[np.repeat(self.at[at] - (stop - n), n) + np.arange(stop[-1])], n


@functools.lru_cache(maxsize=1)
def _word_ids(path: str, most: int, at_once: int) -> WordIds:
    """One per worker: later tasks of the worker find the words of earlier ones."""
    return WordIds(path, most, at_once)


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _split_stops(w: spans.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words per row) with a last ``.`` or ``,`` after an ASCII letter as a word of
    its own: a letter and such a mark are never one token, and the bare words repeat more."""
    last = w.bytes[w.end - 1]
    stop = ((last == 46) | (last == 44)) & (w.end - w.start > 1)
    stop[stop] = _LETTER[w.bytes[w.end[stop] - 2]]
    at = np.arange(len(w.start)) + np.cumsum(stop) - stop
    start, end = np.empty((2, len(w.start) + int(stop.sum())), np.int64)
    start[at], end[at] = w.start, w.end - stop
    start[at[stop] + 1], end[at[stop] + 1] = w.end[stop] - 1, w.end[stop]
    return start, end, w.per_row + np.bincount(w.row[stop], minlength=w.rows)


def _cutter(path: str, p: Packing):
    def run(batches):
        encode = _word_ids(path, p.cache_bytes, p.words_at_once)
        for batch in batches:
            ids = batch.column(0)
            # the tokenizer lowers A-Z itself, except in its special strings
            lower = not pc.any(pc.match_substring(batch.column(1), "<|")).as_py()
            for a, b, w in spans.words_of(batch.column(1), lower=lower):
                start, end, per_row = _split_stops(w)
                flat, n = encode(w, start, end)
                upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per_row)])]
                out: list[tuple[int, int, int, int, int]] = []
                for r in range(w.rows):
                    doc = flat[upto[r]:upto[r + 1]].astype("<u4")
                    total = len(doc) + 1
                    for k, s in enumerate(range(0, total, p.capacity)):
                        part = doc[s:s + p.capacity]
                        crc = zlib.crc32(part.tobytes())
                        if s + p.capacity >= total:                       # the end id belongs to the last piece
                            crc = zlib.crc32(np.array([END_ID], "<u4").tobytes(), crc)
                        out.append((r, k, s, min(p.capacity, total - s), crc))
                r, k, s, m, crc = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(r)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(m), pa.array(crc)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, p: Packing = Packing()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of docs(doc_id, text)."""
    return C.arrow_map(C.only(docs, doc_id="bigint", text="string"), _cutter(tokenizer or default_tokenizer(), p),
                       "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def patterns(count: np.ndarray, p: Packing) -> list[tuple[int, ...]]:
    """Length patterns that fill a sequence exactly: one, two or three pieces of lengths that
    occur, triples in the order of how many their rarest length allows."""
    cap = p.capacity
    have = np.flatnonzero(count)
    out = [(cap,)] if count[cap] else []
    out += [(int(a), int(cap - a)) for a in have if cap - a <= a < cap and count[cap - a] and (2 * a != cap or count[a] > 1)]
    best = np.zeros((0, 4), np.int64)                                     # (rare, a, b, c), in order
    for s in range(0, len(have), 64):                                     # some first lengths at a time: never the square of the lengths
        a, b = np.meshgrid(have[s:s + 64], have, indexing="ij")
        c = cap - a - b
        ok = (a >= b) & (b >= c) & (c > 0)
        a, b, c = a[ok], b[ok], c[ok]
        rare = np.minimum(np.minimum(count[a], count[b]), count[c])
        best = np.concatenate([best, np.stack([rare, a, b, c], axis=1)[rare > 0]])
        best = best[np.lexsort((best[:, 2], best[:, 1], -best[:, 0]))][:p.max_triples]
    return out + [(a, b, c) for _, a, b, c in best.tolist()]


def repeats(count: np.ndarray, pats: list[tuple[int, ...]], p: Packing) -> np.ndarray:
    """Non-negative least squares: repeat counts x >= 0 that bring sum(x * pattern) near the
    histogram (accelerated projected gradient), rounded down so that no length is overdrawn."""
    if not pats:
        return np.zeros(0, np.int64)
    col = np.repeat(np.arange(len(pats)), [len(x) for x in pats])
    row = np.array([n for x in pats for n in x], np.int64)
    size = len(count)

    def times(x):
        return np.bincount(row, x[col], size)

    step = np.ones(len(pats))
    for _ in range(12):                                                   # the largest eigenvalue, by powers
        step = np.bincount(col, times(step)[row], len(pats))
        top = np.linalg.norm(step)
        step /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(p.nnls_steps):
        z = np.maximum(0, y - np.bincount(col, (times(y) - count)[row], len(pats)) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = z + (t - 1) / t2 * (z - x), z, t2
    left = count.copy()
    out = np.zeros(len(pats), np.int64)
    for i in np.argsort(-x, kind="stable"):
        lengths, each = np.unique(pats[i], return_counts=True)
        out[i] = min(int(x[i]), int((left[lengths] // each).min()))
        left[lengths] -= out[i] * each
    return out


def residual(left: np.ndarray, cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit for what the patterns leave, largest piece first. Each step fills one sequence
    and repeats it as often as the counts allow, which uses up a length (or all but a few
    pieces of one), so the steps are bounded by the lengths, not by the pieces."""
    left = left.copy()
    out = []
    for top in range(cap, 0, -1):
        while left[top]:
            left[top] -= 1
            fill, room = [top], cap - top
            while room > 0:
                have = np.flatnonzero(left[:room + 1])
                if not len(have):
                    break
                if left[room]:
                    pick = room
                else:                                                     # two that fill the room, else the largest
                    two = have[(left[room - have] > 0) & ((2 * have != room) | (left[have] > 1))]
                    pick = int(two[-1]) if len(two) else int(have[-1])
                left[pick] -= 1
                fill.append(pick)
                room -= pick
            lengths, each = np.unique(fill, return_counts=True)
            more = int((left[lengths] // each).min())
            left[lengths] -= more * each
            out.append((tuple(fill), 1 + more))
    return out


def plan(histogram: dict[int, int], p: Packing = Packing()) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats): together they hold every piece of the histogram exactly."""
    count = np.zeros(p.capacity + 1, np.int64)
    for n, c in histogram.items():
        count[n] = c
    pats = patterns(count, p)
    x = repeats(count, pats, p)
    used = np.zeros_like(count)
    for pat, k in zip(pats, x):
        for n in pat:
            used[n] += k
    return [(pat, int(k)) for pat, k in zip(pats, x) if k] + residual(count - used, p.capacity)


def _placer(steps: list[tuple[tuple[int, ...], int]]):
    """Ranks of a length, in steps of the plan: the first rank, its sequence, and the offset."""
    taken: dict[int, int] = {}
    table, base = [], 0
    for pattern, k in steps:
        offset = 0
        for n in pattern:
            lo = taken.get(n, 0)
            table.append((n, lo, base - lo, offset))
            taken[n] = lo + k
            offset += n
        base += k
    table.sort()
    n, lo, shift, offset = (np.array(x, np.int64) for x in zip(*table))
    key = (n << 48) + lo

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            i = np.searchsorted(key, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shift[i] + rank), pa.array(offset[i])],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str | None = None, p: Packing = Packing()) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence and offset."""
    cut = C.cut_lineage(pieces(docs, tokenizer, p))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}     # at most `capacity` rows
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    if not histogram:
        return cut.sparkSession.createDataFrame([], schema)
    salts = max(p.salts, sum(histogram.values()) // 500_000)
    # rank in its length: a row number in each salt of it, after the pieces of the salts before
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (salted.groupBy("length", "salt").count()
               .select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (salted.withColumn("i", F.row_number().over(inside)).join(offsets, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("i") - 1).alias("rank")))
    steps = plan(histogram, p)
    C.give_back()
    return C.arrow_map(ranked, _placer(steps), schema)

"""Cross-tokenizer alignment by the byte places where tokens of both end (operator 12).

Each text is encoded by two tokenizers. A token's bytes end at some place of the text; the
places of one tokenizer's tokens are kept in a dictionary from end to token index, and the
keys that both dictionaries hold, sorted, slice both id lists into groups: the shortest
runs of tokens that cover the same bytes. Links are expanded per slice: the pairs of
tokens in it whose byte ranges end together (the last of both), or all pairs of it.

Counts of linked id pairs over the whole corpus come from partial sums per task. To look
them up again per document, all pairs down to a count are sent to every task, where the
count is the least power of two that leaves at most ``sent_pairs`` pairs; pairs below are
rare by construction and joined by shuffle, with no hot key among them. The texts are
encoded once: documents' links are kept as packed id pairs.

Defined cases: a null or empty text, and one whose tokens' joined bytes differ from a space
and the text (a character that the second tokenizer normalises, bytes that are not
UTF-8), has no tokens; strings of special tokens inside a text are plain text; rows with
null or repeated ids are rows of their own; texts of any length are whole; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Align:
    links: str = "end"                    # "end": pairs that end together; "slice": all pairs of a slice
    slice_bytes: int = 128 << 10          # texts encoded at once
    sent_pairs: int = 1 << 21             # pairs sent to every task: at most 24 MB
    held_pairs: int = 1 << 20             # different pairs a task holds before it hands its sums on


# --- the two tokenizers

def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """The byte-level BPE of a tokenizer file. Its merges rank as its ids do, so texts are encoded
    by rank with the library that is quickest at it; runs of white space too long for that
    library's pattern go to the file's own tokenizer (tests compare the two)."""

    _LONG_BLANK = re.compile(r"\s{2000}")

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        byte, special = byte_alphabet(), {t.content for t in self.own.get_added_tokens_decoder().values()}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in self.own.get_vocab().items() if t not in special}
        self.quick = tiktoken.Encoding("by_rank", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes[i] = t

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [self.own.encode(t, add_special_tokens=False).ids if len(t) >= 2000 and self._LONG_BLANK.search(t) else self.quick.encode_ordinary(t)
                for t in texts]

    def joined(self, ids: list[int]) -> bytes:
        return self.quick.decode_bytes(ids)


class Pieces:
    """A sentence-piece model, which itself puts a space before the text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self.model.id_to_piece(i)) for i in ids)]

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(maxsize=1)
def _pair(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    """One per worker."""
    return ByteLevel(a), Pieces(b)


# --- alignment of one text

def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Token counts of both sides after each group, from the ends of both sides' tokens."""
    at_a = dict(zip(ends_a, range(1, len(ends_a) + 1)))          # the last token that ends there
    at_b = dict(zip(ends_b, range(1, len(ends_b) + 1)))
    common = sorted(filter(at_a.__contains__, at_b))             # B's keys that are A's; ends rise, so this is one pass
    return (np.fromiter(map(at_a.__getitem__, common), np.int64, len(common)),
            np.fromiter(map(at_b.__getitem__, common), np.int64, len(common)))


class GroupText:
    """Writes groups as ``a1,a2|b1;a3|b2,b3``: eight bytes for every id with each mark that may
    follow it, zeros behind, so a text is one gather over places computed for all its tokens."""

    def __init__(self, ids_a: int, ids_b: int) -> None:
        names = [f"{i}{mark}".encode() for n, mark in ((ids_a, ","), (ids_a, "|"), (ids_b, ","), (ids_b, ";")) for i in range(n)]
        self.words = np.frombuffer(b"".join(x.ljust(8, b"\0") for x in names), np.uint64)      # at most five digits and a mark
        self.ids_a, self.ids_b = ids_a, ids_b

    def __call__(self, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> str:
        if not len(x):
            return ""
        size_a, size_b = np.diff(x, prepend=0), np.diff(y, prepend=0)
        name_a, name_b = a.copy(), b + 2 * self.ids_a
        name_a[x - 1] += self.ids_a
        name_b[y - 1] += self.ids_b
        out = np.empty(len(a) + len(b), np.int64)
        out[np.arange(len(a)) + np.repeat(y - size_b, size_a)] = name_a     # after all of b's tokens of earlier slices
        out[np.arange(len(b)) + np.repeat(x, size_b)] = name_b
        return self.words[out].tobytes().translate(None, b"\0")[:-1].decode()


def slice_links(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, x: np.ndarray, y: np.ndarray, rule: str) -> np.ndarray:
    """Linked id pairs, as a << 32 | b, slice by slice."""
    if not len(x):
        return np.zeros(0, np.int64)
    if rule == "end" and len_a.all() and len_b.all():                        # no two tokens of a side end together
        return a[x - 1] << 32 | b[y - 1]
    out, i, j = [], 0, 0
    for p, q in zip(x.tolist(), y.tolist()):
        left, right = np.arange(i, p), np.arange(j, q)
        if rule == "end":                                                     # those with nothing but empty tokens behind
            left = left[np.cumsum(len_a[i:p][::-1])[::-1] - len_a[i:p] == 0]
            right = right[np.cumsum(len_b[j:q][::-1])[::-1] - len_b[j:q] == 0]
        out.append((a[left][:, None] << 32 | b[right][None, :]).ravel())
        i, j = p, q
    return np.concatenate(out)


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]


def _aligner(paths: tuple[str, str], p: Align):
    def run(batches):
        enc_a, enc_b = _pair(*paths)
        size_a, size_b = (np.array([len(x) for x in e.bytes], np.int64) for e in (enc_a, enc_b))
        written = GroupText(len(size_a), len(size_b))
        for batch in batches:
            ids = batch.column(0)
            raw, offsets = spans.buffers(batch.column(1))
            for lo, hi in spans.slices(offsets, p.slice_bytes):
                block = raw[offsets[lo]:offsets[hi]].tobytes()
                o = (offsets[lo:hi + 1] - offsets[lo]).tolist()
                texts = [block[s:e] for s, e in zip(o, o[1:])]
                full = [r for r, t in enumerate(texts) if t]
                plain = [texts[r].decode("utf-8", "replace") for r in full]
                found: dict[int, tuple] = {}
                for r, x, y in zip(full, enc_a([" " + t for t in plain]), enc_b(plain)):
                    want = b" " + texts[r]
                    if enc_a.joined(x) != want or enc_b.joined(y) != want:
                        continue
                    a, b = np.array(x, np.int64), np.array(y, np.int64)
                    la, lb = size_a[a], size_b[b]
                    upto_a, upto_b = cuts(np.cumsum(la).tolist(), np.cumsum(lb).tolist())
                    links = slice_links(a, b, la, lb, upto_a, upto_b, p.links)
                    found[r] = (len(x), len(y), len(upto_a), len(links), written(a, b, upto_a, upto_b),
                                (links >> 32 << 16 | links & 0xFFFF).astype("<u4").tobytes())
                rows = [found.get(r, (0, 0, 0, 0, "", b"")) for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), *(pa.array([row[k] for row in rows], t) for k, t in
                                               enumerate([pa.int64()] * 4 + [pa.string(), pa.binary()]))], names=_NAMES)
    return run


def align(docs: DataFrame, tokenizers: tuple[str, str] | None = None, p: Align = Align()) -> DataFrame:
    """docs(doc_id, text) with counts of tokens, groups and links, the ``groups`` written out, and
    ``links``: four bytes a link, the second tokenizer's id below the first one's (both
    vocabularies have at most 65,536 ids; larger ones are refused)."""
    paths = tokenizers or default_tokenizers()
    if p.links not in ("end", "slice"):
        raise ValueError(f"links must be 'end' or 'slice', not {p.links!r}")
    if max(len(t.bytes) for t in _pair(*paths)) > 1 << 16:
        raise ValueError("a vocabulary has more than 65,536 ids")
    return C.arrow_map(C.only(docs, doc_id="bigint", text="string"), _aligner(paths, p),
                       "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary")


# --- counts over the corpus

def _codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(link codes of all rows, row of each)."""
    col = col.cast(pa.large_binary())
    size = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]) // 4 if len(col) else np.zeros(0, np.int64)
    codes = np.frombuffer(b"".join(col.to_pylist()), "<u4").astype(np.int64)
    return codes, np.repeat(np.arange(len(size)), size)


def _row_blocks(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    size = np.array([0, *np.cumsum([len(x) for x in batch.column(column).to_pylist()])], np.int64)
    for a, b in spans.slices(size, limit):
        yield batch.slice(a, b - a)


def _counter(p: Align):
    def run(batches):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["pair", "n"])

        for batch in batches:
            for block in _row_blocks(batch, 0):
                more, n = np.unique(_codes(block.column(0))[0], return_counts=True)
                both, back = np.unique(np.concatenate([keys, more]), return_inverse=True)
                sums = np.bincount(back, np.concatenate([sums, n]), len(both)).astype(np.int64)
                keys = both
                if len(keys) > p.held_pairs:
                    yield out()
                    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield out()
    return run


def pair_counts(aligned: DataFrame, p: Align = Align()) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each linked id pair (first id << 16 |
    second id), and whether no other pair of its second id has more."""
    n = C.stored(C.arrow_map(aligned.select("links"), _counter(p), "pair bigint, n bigint")
                 .groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFF))
    top = n.groupBy(second.alias("b")).agg(F.max("n").alias("top"))           # at most 65,536 rows, whatever the corpus
    return (n.withColumn("b", second).join(F.broadcast(top), "b")
            .select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(pairs, counts, best) of all pairs with at least ``least`` links, and ``least``: the smallest
    power of two that at most ``most`` pairs reach. Only these, at most ``most``, pass the driver."""
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()         # at most 63 rows
    least, kept = 1 << 62, 0
    for k, c in sorted(((r["k"], r["count"]) for r in by_size), reverse=True):
        if kept + c > most:
            break
        least, kept = 1 << k, kept + c
    t = counts.filter(F.col("n") >= least).toArrow()
    pair, n, best = (t.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return pair[order], n[order], best[order].astype(bool), least


def _looker(sent, p: Align):
    def run(batches):
        pair, n, best = sent.value
        for batch in batches:
            for block in _row_blocks(batch, 1):
                codes, row = _codes(block.column(1))
                at = np.searchsorted(pair, codes)
                at[at == len(pair)] = 0
                known = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
                rows = block.num_rows
                total = np.zeros(rows, np.int64)
                np.add.at(total, row[known], n[at[known]])
                good = np.bincount(row[known], best[at[known]], rows).astype(np.int64)
                rid = block.column(0)
                yield pa.RecordBatch.from_arrays([rid, pa.nulls(rows, pa.int64()), pa.array(total), pa.array(good)],
                                                 names=["rid", "pair", "n", "best"])
                if not known.all():                                           # rare pairs: (row, pair, times)
                    rest = np.stack([row[~known], codes[~known]])
                    (r, c), times = np.unique(rest, axis=1, return_counts=True)
                    yield pa.RecordBatch.from_arrays([rid.take(pa.array(r)), pa.array(c), pa.array(times.astype(np.int64)),
                                                      pa.nulls(len(r), pa.int64())], names=["rid", "pair", "n", "best"])
    return run


def with_counts(aligned: DataFrame, p: Align = Align()) -> DataFrame:
    """``aligned`` without its links, and with ``count_sum``, the sum over the row's links of how
    many links of all rows hold the same id pair, and ``n_best``, the links whose pair has
    the highest count of its second id. ``aligned`` is written to the shared folder once."""
    kept = C.stored(aligned.withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = C.stored(pair_counts(kept, p), "paircounts")
    *table, least = _frequent(counts, p.sent_pairs)
    sent = kept.sparkSession.sparkContext.broadcast(tuple(table))
    seen = C.stored(C.arrow_map(kept.select("rid", "links"), _looker(sent, p), "rid bigint, pair bigint, n bigint, best bigint"), "pairsums")
    rare = counts.filter(F.col("n") < least).select("pair", F.col("n").alias("each"), F.col("best").cast("bigint").alias("is_best"))
    sums = (seen.filter("pair is null").select("rid", "n", "best")
            .unionByName(seen.filter("pair is not null").select("rid", "pair", F.col("n").alias("times")).join(rare, "pair")
                         .select("rid", (F.col("times") * F.col("each")).alias("n"), (F.col("times") * F.col("is_best")).alias("best")))
            .groupBy("rid").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best")))
    return kept.drop("links").join(sums, "rid").drop("rid")

"""Katz backoff scores of whole texts (operator 3).

A bigram model over words and an end token per text. Counts up to five are discounted by
Good-Turing ratios of the counts of counts, larger ones by a constant, so every context
keeps mass for what did not follow it; that mass goes to the remaining words in proportion
to their unigram probability, with a weight that makes each context sum to one exactly.
Unigrams are discounted alike, and what they leave is the unknown word's.

    P(w|h) = d(c(h,w)) c(h,w) / c(h)        if (h, w) was seen
           = a(h) P(w)                      otherwise;  P(w) if h was never seen

Tokens travel as sorted, compressed blocks, dealt by the word so that all pairs (h, w) of a
word meet; words that hold more than a share of the corpus are dealt by the pair instead,
their counts being known from the unigram table. A block's tokens are scored where they
are counted: each text gets its sums there, and only sums per text, sums per context and the
unseen pairs go on. The unigrams and these sums are tables in the shared folder.

A worker holds one block, one bucket's blocks or one part of the sums at a time; their sizes
are set by the tokens of all texts, learnt from or not, and a bucket is counted a range of
words after the other.

Defined cases: a null or empty text is the end token alone; rows with null ids are learnt
from; repeated rows count each and score alike; without any training text all words are
unknown and every score is 0; an empty table gives no rows; further columns are ignored.
Words are separated by ``20 09-0D``; A-Z is lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

END, BOS = np.uint64(1), np.uint64(2)
LOW = 5                               # counts up to this are discounted by Good-Turing


@dataclass(frozen=True)
class Katz:
    constant: float = 0.5             # what larger counts lose
    tokens_per_bucket: int = 2_000_000     # of pairs
    tokens_per_part: int = 1_000_000       # of the sums that go on
    buckets: int = 24                 # at least, of either kind
    tokens_per_block: int = 1_250_000
    words_per_table: int = 500_000         # counts that a worker holds before it merges them
    pairs_at_once: int = 400_000           # of a bucket


def discounts(n: list[int], constant: float) -> np.ndarray:
    """d[r] for r = 0..LOW from the counts of counts n[1..LOW+1]: Katz's ratios; where copies
    in the corpus make one of them no ratio between 0 and 1, Good-Turing ratios of counts of
    counts smoothed by a line through their logarithms; if that fails too, the constant."""
    r = np.arange(1, LOW + 1)
    constant_d = np.concatenate([[1.0], (r - constant) / r])
    if not all(n[1:LOW + 2]):
        return constant_d
    n = np.array(n[:LOW + 2], float)
    a = (LOW + 1) * n[LOW + 1] / n[1]
    if a != 1:
        got = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
        if ((got > 0) & (got < 1)).all():
            return np.concatenate([[1.0], got])
    k = np.arange(1, LOW + 2)
    slope = np.polyfit(np.log(k), np.log(n[1:]), 1)[0]
    return np.concatenate([[1.0], (1 + 1 / r) ** (slope + 1)]) if slope < -1 else constant_d


@dataclass(frozen=True)
class Unigrams:
    total: int
    distinct: int
    low: tuple[int, ...]              # counts of counts, 0..LOW+1
    hot: dict[int, int]               # counts of the words dealt by pair
    constant: float

    def prob(self, c: np.ndarray) -> np.ndarray:
        """P(w) by count; 0 is the unknown word."""
        d = discounts(list(self.low), self.constant)
        c = np.asarray(c)
        kept = np.where(c <= LOW, d[np.minimum(c, LOW)] * c, c - self.constant)
        left = sum(self.low[r] * r * (1 - d[r]) for r in range(1, LOW + 1)) + self.constant * (self.distinct - sum(self.low[1:LOW + 1]))
        return np.where(c > 0, kept, left if self.total else 1.0) / max(self.total, 1)


def _tokens(w: spans.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, row) of every token: the words of each row, then its end."""
    at = np.arange(len(w.hash)) + w.row
    end = w.first_of_row()[1:] + np.arange(w.rows)
    word = np.empty(len(w.hash) + w.rows, np.uint64)
    word[at], word[end] = w.hash, END
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[np.concatenate([[0], end[:-1] + 1])] = BOS
    return word, context, np.repeat(np.arange(w.rows, dtype=np.int32), w.per_row + 1)


def _unigram_counter(p: Katz):
    def run(batches):
        keys: list = []
        counts: list = []
        held = 0

        def merge():
            k, c = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k)
            k, c = k[order], c[order]
            first = _runs(k)
            return k[first], np.add.reduceat(c, first)

        def rows(k, c):
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c)], names=["word", "c"])

        for batch in batches:
            for _, _, w in spans.words_of(batch.column(0)):
                u, c = np.unique(_tokens(w)[0], return_counts=True)
                keys.append(u)
                counts.append(c)
                held += len(u)
                if held > p.words_per_table:
                    u, c = merge()
                    keys, counts, held = [u], [c], len(u)
                    if held > p.words_per_table // 2:
                        yield rows(u, c)
                        keys, counts, held = [], [], 0
        if held:
            yield rows(*merge())
    return run


RISING = ("word", "names", "h")         # columns of sorted hashes, packed as differences


def _pack(columns: dict[str, np.ndarray]) -> bytes:
    """Arrays of any lengths as one compressed value: the bytes of all, each padded to eights,
    behind a line of their names, types and lengths; before it, the length of that in all.
    Differences of hashes lie as eight rows of bytes: the upper ones are mostly zero."""
    parts = [" ".join(f"{n} {a.dtype.str} {len(a)}" for n, a in columns.items()).encode() + b"\n"]
    for name, a in columns.items():
        if name in RISING:
            a = np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
        parts.append(a.tobytes())
    raw = b"".join(x + bytes(-len(x) % 8) for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(value: bytes | pa.Buffer) -> dict[str, np.ndarray]:
    value = pa.py_buffer(value)
    raw = pa.decompress(value.slice(8), int.from_bytes(value.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    at = raw.slice(0, min(len(raw), 4096)).to_pybytes().index(b"\n") + 1
    names = raw.slice(0, at - 1).to_pybytes().decode().split(" ")
    out = {}
    for name, kind, n in zip(names[::3], map(np.dtype, names[1::3]), map(int, names[2::3])):
        at += -at % 8
        if name in RISING:
            rows = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n)
            out[name] = np.cumsum(np.ascontiguousarray(rows.T).view(kind).reshape(n), dtype=kind)
        else:
            out[name] = np.frombuffer(raw, kind, n, at)
        at += out[name].nbytes
    return out


def _values(table: pa.Table) -> list[pa.Buffer]:
    """The blocks of a group, not copied."""
    return [x.as_buffer() for x in table["block"]]


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if not len(a) or a.max() < 65536 else np.uint32)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (spans.mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(n)).astype(np.int32)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted arrays."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _blocks(p: Katz, n_buckets: int, hot: np.ndarray):
    """Tokens of a task, dealt to buckets; in a block sorted by (word, context)."""
    kind = np.uint16 if n_buckets < 65536 else np.int32

    def deal(word, context):
        where = _bucket(word, n_buckets)
        if len(hot):
            is_hot = np.isin(word, hot)
            where[is_hot] = _bucket(context[is_hot] * np.uint64(3) + word[is_hot], n_buckets)
        return where.astype(kind)

    def run(batches):
        held: list = [[], [], [], [], []]       # word, bucket and text of each token; key and train of each text
        size = docs = 0

        def flush():
            all_of = []
            for column in held:
                all_of.append(np.concatenate(column))
                column.clear()
            word, where, doc, key, train = all_of
            order = np.argsort(where, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=n_buckets))])
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = order[cuts[b]:cuts[b + 1]]
                # the token before; a text follows the end of another (the first, that of the last)
                w, h = word[part], word[part - 1]
                h[h == END] = BOS
                by = np.lexsort((h, w))
                w, h, d = w[by], h[by], doc[part[by]]
                pair = _runs(w, h)
                names, index = np.unique(h[pair], return_inverse=True)
                first = _runs(w[pair])
                here, local = np.unique(d, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_pack({
                    "word": w[pair][first], "word_n": _small(np.diff(np.append(first, len(pair)))),
                    "names": names, "context": _small(index), "n": _small(np.diff(np.append(pair, len(w)))),
                    "doc": _small(local), "key": key[here], "train": train[here].astype(np.uint8)})], pa.binary())], names=["bucket", "block"])

        for batch in batches:
            keys, train = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, w in spans.words_of(batch.column(2)):
                word, context, row = _tokens(w)
                for column, more in zip(held, (word, deal(word, context), row + np.int32(docs), keys[a:b], train[a:b])):
                    column.append(more)
                size += len(word)
                docs += b - a
                if size >= p.tokens_per_block:
                    yield from flush()
                    size = docs = 0
        if size:
            yield from flush()
    return run


def _starts(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the items ``at`` begin, of items that are ``n`` long."""
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[at]


def _ranges(blocks: list[dict[str, np.ndarray]], pairs: int):
    """Blocks cut at the same words, so that a range has about ``pairs`` pairs or one word:
    for each range, (words, pairs, tokens) of each block as slices."""
    word, n = np.concatenate([x["word"] for x in blocks]), np.concatenate([x["word_n"] for x in blocks])
    order = np.argsort(word)
    word, upto = word[order], np.cumsum(n[order], dtype=np.int64)
    at = np.searchsorted(upto, np.arange(pairs, upto[-1], pairs))
    cuts = np.unique(word[at])
    cuts = cuts[cuts > word[0]]
    ends = []
    for x in blocks:
        w = np.concatenate([[0], np.searchsorted(x["word"], cuts), [len(x["word"])]])
        pair = _starts(x["word_n"], w)
        ends.append((w, pair, _starts(x["n"], pair)))
    for i in range(len(cuts) + 1):
        yield [tuple(slice(int(e[i]), int(e[i + 1])) for e in end) for end in ends]


def _count(n_parts: int, uni: Unigrams, p: Katz):
    """One bucket: counts of its pairs, then sums per text, sums per context, unseen pairs."""
    hot = np.array(sorted(uni.hot), np.uint64)
    hot_count = np.array([uni.hot[int(h)] for h in hot], np.int64)

    def run(table: pa.Table) -> pa.Table:
        blocks = [_unpack(x) for x in _values(table)]
        low = np.zeros(LOW + 2, np.int64)
        docs = [{"base": np.zeros(len(x["key"])), "sum": np.zeros(len(x["key"]))}
                | {c: np.zeros(len(x["key"]), np.uint32) for c in ("tokens", "known", *(f"n{r}" for r in range(1, LOW + 1)))} for x in blocks]
        unseen: list = []                     # (context, key)
        contexts: list = []                   # (context, probability, count up to LOW + 1) of seen pairs
        for cut in _ranges(blocks, p.pairs_at_once):
            word = np.concatenate([np.repeat(x["word"][w], x["word_n"][w]) for x, (w, _, _) in zip(blocks, cut)])
            context = np.concatenate([x["names"][x["context"][c]] for x, (_, c, _) in zip(blocks, cut)])

            def pair_of(x, c):
                return np.repeat(np.arange(c.stop - c.start, dtype=np.int32), x["n"][c])

            train_n = np.concatenate([np.bincount(pair_of(x, c), x["train"][x["doc"][t]], c.stop - c.start).astype(np.int32) for x, (_, c, t) in zip(blocks, cut)])
            order = np.lexsort((context, word)).astype(np.int32)
            word, context = word[order], context[order]
            start = _runs(word, context)
            group = np.zeros(len(word), np.int32)
            group[start[1:]] = 1
            group = np.cumsum(group, dtype=np.int32)
            seen = np.bincount(group, train_n[order]).astype(np.int64)        # c(h, w)
            gw, gh = word[start], context[start]
            back = np.empty(len(word), np.int32)
            back[order] = group                                               # pair of a block -> group
            del word, context, order, group, train_n
            wstart = _runs(gw)
            sums = np.add.reduceat(seen, wstart)
            if len(hot):
                at = np.searchsorted(hot, gw[wstart]).clip(max=len(hot) - 1)
                is_hot = hot[at] == gw[wstart]
                sums[is_hot] = hot_count[at[is_hot]]
            cw = np.repeat(sums, np.diff(np.append(wstart, len(gw))))         # c(w)
            prob = uni.prob(cw)
            low += np.bincount(np.minimum(seen, LOW + 2), minlength=LOW + 3)[:LOW + 2]
            value = np.where(seen > LOW, np.log10(np.maximum(seen, 1) - p.constant), 0.0) + np.where(seen == 0, np.log10(prob), 0.0)
            # a word is the context of the token after it: its count divides there
            value += np.where((gw != END) & (cw > 0), -np.log10(np.maximum(cw, 1)), 0.0)
            known, base = cw > 0, np.log10(cw + 1.0)
            offset = 0
            for x, to, (_, c, t) in zip(blocks, docs, cut):
                if c.start == c.stop:
                    continue
                g = back[offset:offset + c.stop - c.start][pair_of(x, c)]
                offset += c.stop - c.start
                d, n = x["doc"][t], len(x["key"])
                to["tokens"] += np.bincount(d, minlength=n).astype(np.uint32)
                to["known"] += np.bincount(d[known[g]], minlength=n).astype(np.uint32)
                to["base"] += np.bincount(d, base[g], n)
                to["sum"] += np.bincount(d, value[g], n)
                count = seen[g]
                for r in range(1, LOW + 1):
                    to[f"n{r}"] += np.bincount(d[count == r], minlength=n).astype(np.uint32)
                un = np.flatnonzero(count == 0)
                if len(un):
                    unseen.append((gh[g[un]], x["key"][d[un]]))
            s = np.flatnonzero(seen)
            contexts.append((gh[s], prob[s], np.minimum(seen[s], LOW + 1).astype(np.uint8)))
        sums = {"key": np.concatenate([x["key"] for x in blocks])}
        blocks.clear()
        for c in list(docs[0]):
            sums[c] = np.concatenate([x.pop(c) for x in docs])
        found = [_dealt(_bucket(sums["key"].view(np.uint64), n_parts), sums)]
        if unseen:
            h, key = (np.concatenate(c) for c in zip(*unseen))
            unseen.clear()
            found.append(_dealt(_bucket(h, n_parts), {"un_h": h, "un_key": key}))
        # contexts of this bucket's seen pairs
        h, prob, count = (np.concatenate(c) for c in zip(*contexts))
        contexts.clear()
        if len(h):
            names, at = np.unique(h, return_inverse=True)
            of_context = {"h": names, "h_p": np.bincount(at, prob, len(names)), "h_more": np.bincount(at[count > LOW], minlength=len(names))}
            for r in range(1, LOW + 1):
                of_context[f"h{r}"] = np.bincount(at[count == r], minlength=len(names))
            del h, prob, count, at
            found.append(_dealt(_bucket(names, n_parts), of_context))
        rows = [(-1, None, low.tolist())] + [(b, _pack({k: v for f in found for k, v in f.get(b, {}).items()}), None) for b in sorted(set().union(*found))]
        kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "block", "low"])
    return run


def _dealt(to: np.ndarray, columns: dict[str, np.ndarray]) -> dict[int, dict[str, np.ndarray]]:
    """The columns' rows by the part they go to; counts in as few bytes as they need."""
    order = np.argsort(to, kind="stable")
    start = _runs(to[order])
    ends = np.append(start[1:], len(to))
    out: dict[int, dict[str, np.ndarray]] = {int(b): {} for b in to[order[start]]}
    for name in list(columns):
        a = columns.pop(name)
        a = (a if name in ("key", "un_key") or a.dtype not in (np.int64, np.uint32) else _small(a))[order]
        for part, i, j in zip(out.values(), start.tolist(), ends.tolist()):
            part[name] = a[i:j]
    return out


def _finish(d: np.ndarray, p: Katz):
    """Backoff weights of the bucket's contexts, applied to its unseen pairs; sums per text."""
    def run(table: pa.Table) -> pa.Table:
        blocks = [_unpack(x) for x in _values(table)]

        def col(name, kind=None):
            some = [b[name] for b in blocks if name in b]
            a = np.concatenate(some) if some else np.zeros(0, np.int64)
            return a.astype(kind) if kind else a

        rank = np.log10(np.array([d[r] * r for r in range(1, LOW + 1)]))
        score = col("sum", float)
        for r in range(1, LOW + 1):
            score = score + col(f"n{r}", float) * rank[r - 1]
        h, at = np.unique(col("h", np.uint64), return_inverse=True)
        left = np.bincount(at, col("h_more", float) * p.constant, len(h)).astype(float)
        for r in range(1, LOW + 1):
            left += np.bincount(at, col(f"h{r}", float), len(h)) * r * (1 - d[r])
        rest = 1 - np.bincount(at, col("h_p", float), len(h))
        # log10 of a(h) c(h); c(h) makes good for the division that unseen pairs do not have
        weight = np.log10(left) - np.log10(np.maximum(rest, 1e-300))
        un, key = col("un_h", np.uint64), col("un_key", np.int64)
        back = np.zeros(len(un))
        if len(h):
            i = np.searchsorted(h, un).clip(max=len(h) - 1)
            hit = h[i] == un
            back[hit] = weight[i[hit]]
        texts, at = np.unique(np.concatenate([col("key", np.int64), key]), return_inverse=True)
        own, more = at[:len(score)], at[len(score):]
        n = len(texts)
        return pa.table({"key": texts, "tokens": np.bincount(own, col("tokens", float), n).astype(np.int64),
                         "known": np.bincount(own, col("known", float), n).astype(np.int64), "base": np.bincount(own, col("base", float), n).astype(float),
                         "score": np.bincount(own, score, n) + np.bincount(more, back, n).astype(float)})
    return run


def unigrams(train: DataFrame, p: Katz = Katz()) -> DataFrame:
    """(word, c): counts of the tokens of train(text), words by their hash; a stored table."""
    counts = C.arrow_map(train.select("text"), _unigram_counter(p), "word bigint, c bigint")
    return C.stored(counts.groupBy("word").agg(F.sum("c").alias("c")), "unigrams")


def scores(docs: DataFrame, held_out: Column, p: Katz = Katz()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of
    docs(doc_id, text), learning from those that are not held out."""
    d = C.only(docs, doc_id="bigint", text="string").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    keyed = d.withColumn("key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    words, others = (unigrams(d.filter(x), p) for x in (~F.col("held_out"), F.col("held_out")))
    low = [F.count_if(F.col("c") == r) for r in range(LOW + 2)]
    total, distinct, ends, *low = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)),
                                            F.coalesce(F.max(F.when(F.col("word") == int(END), F.col("c"))), F.lit(0)), *low).first()
    n_tokens = total + others.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    n_buckets, n_parts = (max(p.buckets, -(-n_tokens // n)) for n in (p.tokens_per_bucket, p.tokens_per_part))
    # words beyond a share of the corpus, in the texts learnt from or in the others: at most 4 * n_buckets rows each
    beyond = F.col("c") > max(n_tokens / (4 * n_buckets), 1000)
    hot = {r.word: 0 for r in others.filter(beyond).collect()}
    hot |= {r.word: r.c for r in words.filter(beyond | F.col("word").isin(list(hot))).collect()}
    hot = {word % (1 << 64): c for word, c in hot.items()}
    uni = Unigrams(int(total), int(distinct), tuple(int(x) for x in low), hot, p.constant)

    dealt = C.arrow_map(keyed.select("key", (~F.col("held_out")).alias("train"), "text"),
                        _blocks(p, n_buckets, np.array(sorted(hot), np.uint64)), "bucket int, block binary")
    counted = C.stored(C.arrow_groups(dealt, ["bucket"], _count(n_parts, uni, p), "bucket int, block binary, low array<bigint>"), "katz")
    pairs = counted.filter("bucket = -1").agg(*[F.sum(F.get("low", F.lit(r))) for r in range(LOW + 2)]).first()
    disc = discounts([int(x or 0) for x in pairs], p.constant)
    sums = (C.arrow_groups(counted.filter("bucket >= 0").select("bucket", "block"), ["bucket"], _finish(disc, p),
                           "key bigint, tokens bigint, known bigint, base double, score double")
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("tokens", "known", "base", "score")]))
    rows = keyed.select("key", "doc_id", "held_out")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    each = sums.join(copies, "key").select("key", *[(F.col(c) / F.col("m")).alias(c) for c in ("tokens", "known", "base", "score")])
    n = F.col("tokens").cast("bigint")
    # the first token of every text has the beginning as its context
    first = float(np.log10(ends)) if ends else 0.0
    return rows.join(each, "key").select(
        "doc_id", "held_out", n.alias("n_tokens"), F.col("known").cast("bigint").alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"),
        (F.col("base") - n * float(np.log10(total + distinct + 1))).alias("base_score"), (F.col("score") - first).alias("score"))

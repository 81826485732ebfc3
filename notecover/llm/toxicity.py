"""Counterfactual-regularised toxicity classifier (operator 1).

A logistic model over the presence of words and word beginnings, known by their 64-bit
hashes: a word that is not one of the chosen carries no weight, however many a text has. Identity terms
in labelled sentences are swapped for other terms of their list, and the fit penalises the
squared change of the score, so that the mere mention of a group carries no weight.

Features are chosen by one distributed count over the labelled rows; the fit itself runs on
at most ``max_labelled`` labelled rows (a documented bound; rows are picked by a hash of
their id) and at most ``max_features`` features, so neither grows with the corpus. Every
whole text is scored in one narrow pass, without a shuffle.

Defined cases: a null or empty text has no features and scores the model's base rate; a
row with a null id is scored as any other; repeated rows score alike; labels that are null
are ignored, and of several labels of one id the highest counts; without any label, or
with labels of one kind only, every score is 0.5 (nothing is predicted). Further columns
are ignored. Words are runs of letters (A-Z lower-cased; bytes beyond ASCII are letters).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

#: Terms that mention a group without judging it; lists of terms that can stand for one another.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("african", "european", "american", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("deaf", "blind", "disabled"), ("immigrants", "refugees", "foreigners", "natives"),
    ("mujeres", "hombres"), ("femmes", "hommes"), ("frauen", "männer"),
)
_BREAKS = np.zeros(256, bool)
_BREAKS[:128] = True
_BREAKS[65:91] = _BREAKS[97:123] = False


@dataclass(frozen=True)
class Toxicity:
    beginnings: tuple = (5, 6)       # letters; shorter ones occur by chance in texts of many words
    max_features: int = 4096
    positives_per_feature: int = 1
    max_labelled: int = 50_000
    swap_weight: float = 10.0
    l2: float = 5e-5
    steps: int = 400
    threshold: float = 0.7
    identity: tuple = IDENTITY_TERMS


def _keys(hashes: np.ndarray, salt: int) -> np.ndarray:
    return spans.mix(hashes ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


def _features(w: spans.Words, beginnings: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every word and of its beginnings."""
    rows, out = [w.row], [_keys(w.hash, 1)]
    length = w.end - w.start
    for n in beginnings:
        long = np.flatnonzero(length > n)
        s = w.start[long]
        rows.append(w.row[long])
        out.append(_keys(w.span_hash(s, s + n), n))
    return np.concatenate(rows), np.concatenate(out)


def term_keys(term: str, p: Toxicity) -> list[int]:
    return sorted({int(k) for _, _, w in spans.words_of(pa.array([term]), _BREAKS) for k in _features(w, p.beginnings)[1]})


def _distinct(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


class Chosen:
    """Places of the chosen keys, which are sorted. A table over the first 20 bits passes by nearly
    all other keys; what it lets through is compared in full."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place) of those features that are chosen."""
        some = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)])
        row, key = row[some], key[some]
        at = np.searchsorted(self.keys, key)
        same = self.keys[at.clip(max=len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
        return _distinct(row[same], at[same])


def _count(p: Toxicity):
    """Documents per feature and label, summed over a slice before anything is shuffled."""
    def run(batches):
        for batch in batches:
            y = batch.column(1).to_numpy()
            for a, b, w in spans.words_of(batch.column(0), _BREAKS):
                row, key = _distinct(*_features(w, p.beginnings))
                some, at = np.unique(key, return_inverse=True)
                one = np.bincount(at, y[a:b][row], len(some)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(np.bincount(at, minlength=len(some)) - one), pa.array(one)],
                                                 names=["slot", "n0", "n1"])
    return run


def _present(p: Toxicity, chosen: np.ndarray, swaps: dict[int, tuple[list[int], list[int]]]):
    """Labelled rows as lists of chosen features, as they are and with identity terms swapped.

    swaps: by a term's word hash, the features of the term and those of its stand-in."""
    place = {int(k): i for i, k in enumerate(chosen)}
    known = np.array(sorted(swaps), np.uint64)

    def run(batches):
        find = Chosen(chosen)
        for batch in batches:
            y, key = batch.column(1), batch.column(2)
            for a, b, w in spans.words_of(batch.column(0), _BREAKS):
                row, f = find(*_features(w, p.beginnings))
                own = np.split(f, np.searchsorted(row, np.arange(1, w.rows)))
                where = np.searchsorted(known, w.hash).clip(max=max(len(known) - 1, 0))
                hit = known[where] == w.hash if len(known) else np.zeros(len(w.hash), bool)
                other: list[list[int] | None] = [None] * w.rows
                for r in np.unique(w.row[hit]):
                    has = set(own[r].tolist())
                    terms = [swaps[int(h)] for h in np.unique(w.hash[hit & (w.row == r)])]
                    gone = {place.get(s, -1) for t in terms for s in t[0]}
                    come = {place.get(s, -1) for t in terms for s in t[1]}
                    other[r] = sorted((has - gone) | (come - {-1}))
                yield pa.RecordBatch.from_arrays(
                    [y.slice(a, b - a), key.slice(a, b - a), pa.array([x.tolist() for x in own], pa.list_(pa.int64())), pa.array(other, pa.list_(pa.int64()))],
                    names=["y", "key", "own", "other"])
    return run


def _csr(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of a list column."""
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    return np.repeat(np.arange(len(n)), n), pc.list_flatten(lists).to_numpy().astype(np.int64)


def fit(rows: pa.Table, n_features: int, p: Toxicity) -> tuple[np.ndarray, float]:
    """Weights and bias of rows (y, own, other): logistic loss + l2 + swap_weight * mean
    squared score change between ``own`` and, where it is there, ``other``."""
    y = rows["y"].to_numpy().astype(float)
    r, f = _csr(rows["own"])
    swapped = rows.filter(pc.is_valid(rows["other"]))
    pairs = range(len(swapped))
    ra, fa = _csr(swapped["own"])
    rb, fb = _csr(swapped["other"])
    w, b = np.zeros(n_features), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, p.steps + 1):
        z = np.bincount(r, w[f], len(y)) + b
        d = (1 / (1 + np.exp(-z)) - y) / len(y)
        g = np.bincount(f, d[r], n_features) + p.l2 * w
        if len(pairs):
            change = np.bincount(ra, w[fa], len(pairs)) - np.bincount(rb, w[fb], len(pairs))
            k = 2 * p.swap_weight * change / len(pairs)
            g += np.bincount(fa, k[ra], n_features) - np.bincount(fb, k[rb], n_features)
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


@dataclass(frozen=True)
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float


def train(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> Model:
    """docs(doc_id, text), labels(doc_id, toxic): only rows that may be learnt from."""
    known = (C.only(labels, doc_id="bigint", toxic="int").filter("doc_id is not null and toxic in (0, 1)")
             .groupBy("doc_id").agg(F.max("toxic").alias("y")))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not ones or ones == n:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    room = 1 << 20
    some = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(room)) < min(room, room * p.max_labelled // n))
    # at most about max_labelled rows of two numbers: a side of bounded size
    learn = C.only(docs, doc_id="bigint", text="string").join(F.broadcast(some), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("key"))

    terms = {t: term_keys(t, p) for group in p.identity for t in group}
    counts = (C.arrow_map(learn, _count(p), "slot bigint, n0 bigint, n1 bigint")
              .groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    share = ones / n
    seen = F.col("n0") + F.col("n1")
    lift = (F.col("n1") - seen * share) ** 2 / (seen * share * (1 - share))          # chi-squared of the feature
    room_for = min(p.max_features, max(16, ones // p.positives_per_feature))          # few examples carry few weights
    best = [r.slot for r in counts.filter(seen >= 3).orderBy(lift.desc(), "slot").limit(room_for).select("slot").collect()]
    chosen = np.array(sorted({k % (1 << 64) for k in best} | {k for t in terms.values() for k in t}), np.uint64)
    swaps = {}
    for group in p.identity:
        for i, t in enumerate(group):
            h = next(int(w.hash[0]) for _, _, w in spans.words_of(pa.array([t]), _BREAKS))
            swaps[h] = (terms[t], terms[group[(i + 1) % len(group)]])
    rows = C.arrow_map(learn, _present(p, chosen, swaps), "y int, key bigint, own array<bigint>, other array<bigint>").toArrow()
    if len(pc.unique(rows["y"])) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    rows = rows.sort_by("key")                                                       # the same sums whatever the task order
    w, b = fit(rows, len(chosen), p)
    del rows
    C.give_back()
    return Model(chosen, w, b)


def _scores(text: pa.Array, find: Chosen, model: Model, p: Toxicity) -> np.ndarray:
    out = [np.zeros(0)]
    for _, _, w in spans.words_of(text, _BREAKS):
        row, f = find(*_features(w, p.beginnings))
        z = np.bincount(row, model.weights[f], w.rows) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(z, -700, 700))))
    return np.concatenate(out)


def _scorer(model: Model, p: Toxicity):
    def run(batches):
        find = Chosen(model.keys)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1), find, model, p))], names=["doc_id", "score"])
    return run


def _keeper(model: Model, p: Toxicity, at: int):
    def run(batches):
        find = Chosen(model.keys)
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at), find, model, p) < p.threshold))
    return run


def score(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """(doc_id, score) of every row of docs(doc_id, text)."""
    return C.arrow_map(C.only(docs, doc_id="bigint", text="string"), _scorer(model, p), "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model, p: Toxicity = Toxicity()) -> DataFrame:
    """``docs`` without the rows scored at or above the threshold; the columns stay."""
    return C.arrow_map(docs, _keeper(model, p, docs.columns.index("text")), docs.schema)


def held_out():
    """Rows that are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, p: Toxicity = Toxicity()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from the others' labels."""
    model = train(docs, labels.filter(~held_out()), p)
    return (score(docs, model, p)
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted")))

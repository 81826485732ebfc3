"""Scores and models: logits to probabilities (F-15 ... F-18), decisions (F-17, F-22, X-7),
batch scoring with a pluggable model (X-3), pair-classifier training (X-4, X-6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecover.functions import text as TX
from notecover.functions.lcs import with_sorted_ratio
from notecover.operators import curves as C
from notecover.operators import logistic as LG
from notecover.operators.similarity import cosine_tf_expr


def softmax(z) -> Column:
    """F-15: stable softmax of an array<double> column."""
    arr = F.col(z) if isinstance(z, str) else z
    ex = F.transform(arr, lambda x: F.exp(x - F.array_max(arr)))
    total = F.aggregate(ex, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(ex, lambda x: x / total)


def argmax(z) -> Column:
    """F-16: index of the largest logit, first on ties (0-based)."""
    arr = F.col(z) if isinstance(z, str) else z
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def parse_logits(c) -> Column:
    """F-18 parse: text '[a, b]' -> array<double>; anything invalid -> null.

    Materialise the result in its own column (``withColumn``) before applying softmax /
    argmax to it, so the text is parsed once per row."""
    return F.from_json(F.col(c) if isinstance(c, str) else c, "array<double>")


def positive_prob(z) -> Column:
    """F-18 score: softmax[1], or softmax[0] (= 1.0) when there is one class; expects a
    materialised array column."""
    arr = F.col(z) if isinstance(z, str) else z
    n = F.size(arr)
    return F.when(n > 1, F.element_at(softmax(arr), 2)).when(n == 1, F.lit(1.0))


def apply_threshold(score, t: float) -> Column:
    """F-17 / X-7: (score >= t) as 0/1."""
    s = F.col(score) if isinstance(score, str) else score
    return (s >= F.lit(float(t))).cast("int")


def yes_no_label(yes="yes_logit", no="no_logit") -> Column:
    """F-22: 1 if the yes logit is larger, ties -> 0."""
    return (F.col(yes) > F.col(no)).cast("int")


# ------------------------------------------------------------------------------ X-3
ScorerFactory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def batch_score(df: DataFrame, factory: ScorerFactory, out_schema: str,
                keep: Sequence[str] = ("pair_id",), length: str | None = None, token_budget: int | None = None) -> DataFrame:
    """X-3: score rows in Arrow batches with a model built once per Python worker.

    ``factory()`` returns ``score(batch: pandas.DataFrame) -> pandas.DataFrame`` whose
    columns are the output fields (besides ``keep``). Kept columns stay in Arrow, so ids
    come back exactly, also next to nulls; results join back without relying on order.

    With ``token_budget``, each Arrow batch is sorted by the column ``length`` and cut into
    calls whose padded size (rows times the longest) stays within the budget, as a model
    that pads its batches needs; a row longer than the budget is a call of its own."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from notecover.session import ship_package
    ship_package(df.sparkSession)
    keep = list(keep)
    if (length is None) != (token_budget is None):
        raise ValueError("length and token_budget go together")
    out_fields = T.StructType.fromDDL(out_schema) if isinstance(out_schema, str) else out_schema
    schema = T.StructType([df.schema[c] for c in keep] + list(out_fields.fields))
    types = to_arrow_schema(out_fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = factory()
        for b in batches:
            calls = [b] if length is None else (b.take(pa.array(at)) for at in padded_calls(b.column(length).to_numpy(zero_copy_only=False), token_budget))
            for part in calls:
                res = score(part.to_pandas())
                out = [part.column(c) for c in keep] + [pa.Array.from_pandas(res[f.name], type=f.type) for f in types]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def padded_calls(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Row numbers of each call: in order of length, as many as fit ``budget`` when padded to the
    longest of them."""
    size = np.maximum(np.nan_to_num(lengths.astype(float)), 1.0)
    order = np.argsort(size, kind="stable")
    a = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or size[order[i]] * (i - a + 1) > budget:
            yield order[a:i]
            a = i


def overlap_tokens_py(s: str | None) -> frozenset[str]:
    s = (s or "").lower()
    for ch in ".,;":
        s = s.replace(ch, " ")
    return frozenset(s.split())


def overlap_of_sets_py(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a) if a else 0.0


def overlap_py(idea: str | None, note: str | None) -> float:
    """F-9 in Python for the lexical scorer (same token rule as the Spark expression)."""
    return overlap_of_sets_py(overlap_tokens_py(idea), overlap_tokens_py(note))


def lexical_scores(df: DataFrame, idea_col: str = "idea_unit", note_col: str = "note", no_logit: float = 0.2) -> DataFrame:
    """The shipped scorer as column expressions: yes logit = lexical overlap (F-9), no logit = a
    constant. Same values as :func:`lexical_scorer_factory` without leaving the JVM; no text
    is sent to Python."""
    return df.withColumn("yes_logit", TX.lexical_overlap(idea_col, note_col)).withColumn("no_logit", F.lit(float(no_logit)))


def lexical_scorer_factory(idea_col: str = "idea_unit", note_col: str = "note", no_logit: float = 0.2):
    """Deterministic shipped scorer: yes logit = lexical overlap, no logit = a constant. A worker keeps
    the token sets of the ideas and of the few notes it met last: a note's pairs come together."""
    def factory():
        ideas, notes = lru_cache(4096)(overlap_tokens_py), lru_cache(32)(overlap_tokens_py)

        def score(b: pd.DataFrame) -> pd.DataFrame:
            yes = [overlap_of_sets_py(ideas(i), notes(n)) for i, n in zip(b[idea_col], b[note_col])]
            return pd.DataFrame({"yes_logit": yes, "no_logit": [no_logit] * len(yes)})
        return score
    return factory


# ------------------------------------------------------------------------------ X-4, X-6
FEATURES = ("f_jaccard", "f_levenshtein", "f_overlap", "f_number", "f_cover", "f_cosine")


def pair_features(df: DataFrame, idea: str = "idea_unit", note: str = "note_text") -> DataFrame:
    """Features of a pair for the trained classifier: Jaccard, Levenshtein ratio, lexical
    overlap, number match, share of idea words present and term-count cosine (JVM
    expressions, but for the edit distance: see :func:`lcs.with_sorted_ratio`)."""
    cols = df.columns
    df = df.withColumns({"_a": TX.strip_lower(idea), "_b": TX.strip_lower(note)})
    df = df.withColumns({"_wa": TX.ws_tokens("_a"), "_wb": TX.ws_tokens("_b")})        # read by Jaccard and by the edit distance
    a, b, wa, wb = (F.col(c) for c in ("_a", "_b", "_wa", "_wb"))
    f = df.select(*cols, TX.jaccard_of_sets(F.array_distinct(wa), F.array_distinct(wb)).alias("f_jaccard"),
                  TX.lexical_overlap(idea, note).alias("f_overlap"),
                  TX.number_match(a, b).cast("double").alias("f_number"),
                  TX.overlap_of_sets(F.array_distinct(TX.word_tokens(a)), F.array_distinct(TX.word_tokens(b))).alias("f_cover"),
                  cosine_tf_expr(a, b).alias("f_cosine"),
                  F.array_join(F.sort_array(wa), " ").alias("_sorted_a"), F.array_join(F.sort_array(wb), " ").alias("_sorted_b"))
    f = with_sorted_ratio(f, F.col("_sorted_a"), F.col("_sorted_b"), "f_levenshtein")
    return f.select(*cols, *FEATURES)


def train_pair_classifier(train: DataFrame, label: str = "label", reg_param: float = LG.REG, rounds: int = LG.ROUNDS,
                          features: Sequence[str] = FEATURES) -> LG.Path:
    """X-4 (re-aimed): logistic regression on pair features, one aggregate a round."""
    return LG.fit(train.withColumn("_run", F.lit(0)), features, {0: reg_param}, label, "_run", rounds)[0]


def predict_pairs(df: DataFrame, path: LG.Path) -> DataFrame:
    """Probability of class 1 (prob_1) and argmax prediction (ties: class 0) of a fitted classifier."""
    scored = LG.score(df.withColumn("_run", F.lit(0)), {0: path}, "_run").drop("_run")
    return scored.withColumn("pred_argmax", (F.col("prob_1") > 0.5).cast("int"))


def seed_fits(runs: DataFrame, seeds: Sequence[int], label: str = "label", reg_param: float = LG.REG,
              features: Sequence[str] = FEATURES) -> DataFrame:
    """X-5 with fits: rows of :func:`split.seed_runs` (seed, split, label, features); a classifier per
    seed from its 'train' rows, all seeds in the same jobs, and the 'val' rows with ``prob_1``."""
    train = runs.filter(F.col("split") == "train").withColumn("seed", F.col("seed").cast("int"))
    paths = LG.fit(train, features, {int(s): reg_param for s in seeds}, label, "seed")
    return LG.score(runs.filter(F.col("split") == "val"), paths, "seed")


def param_search(train: DataFrame, val: DataFrame, reg_params: Sequence[float] = (0.001, 0.01, 0.1),
                 label: str = "label", features: Sequence[str] = FEATURES) -> DataFrame:
    """X-6: one model per regularisation value, all in the same jobs, with the validation F1 at its
    own best threshold (A-18). One row per candidate: reg_param, threshold, f1, best."""
    regs = [float(r) for r in reg_params]
    each = F.explode(F.array(*[F.lit(r) for r in regs]))
    paths = LG.fit(train.withColumn("reg_param", each), features, {r: r for r in regs}, label, "reg_param")
    scored = LG.score(val.withColumn("reg_param", each), paths, "reg_param").select("reg_param", F.col(label).alias("y"), "prob_1")
    return _with_best(C.best_threshold(scored, "y", "prob_1", by=["reg_param"]), "reg_param")


def epoch_search(train: DataFrame, val: DataFrame, label: str = "label", reg_param: float = LG.REG, rounds: int = LG.ROUNDS,
                 features: Sequence[str] = FEATURES) -> DataFrame:
    """X-6: the best epoch by validation F1. The coefficients after every round of one fit score the
    validation rows in one pass; one row per epoch: epoch, threshold, f1, best (the first
    epoch with the highest F1)."""
    path = train_pair_classifier(train, label, reg_param, rounds, features)
    scored = LG.score_paths(val, path).select("epoch", F.col(label).alias("y"), "prob_1")
    return _with_best(C.best_threshold(scored, "y", "prob_1", by=["epoch"]), "epoch")


def _with_best(rows: DataFrame, key: str) -> DataFrame:
    """Best first: the highest F1, the lowest key on ties. A row per candidate, so one small window."""
    order = (F.round("f1", 6).desc(), F.col(key))
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    return rows.select(key, "threshold", "f1", (first == 1).cast("int").alias("best")).orderBy(*order)

"""Table-level text similarity: term-count cosine (F-3), rule scoring of answers (P-1 core)."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.functions import lcs
from notecover.functions import text as T
from notecover.operators import sweep as SW

# The reference's shipped weights: fuzzy ratio only (the others are commented out there).
SHIPPED_WEIGHTS = {"fuzzy": 1.0}
# Its commented-out alternative weights, fixed values.
ALT_WEIGHTS = {"jaccard": 0.2, "semantic": 0.15, "cosine": 0.15, "number": 0.05}


def _let(value, f) -> Column:
    """``f`` of ``value``, which is worked out once however often ``f`` reads it."""
    return F.transform(F.array(value), f)[0]


def _token_counts(tokens) -> Column:
    """Struct of the distinct tokens ``w`` in order and their counts ``c``: the tokens are sorted,
    and a count is the distance between the starts of two runs."""
    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))
        return _let(starts, lambda at: F.struct(
            F.array_distinct(s).alias("w"),
            F.zip_with(F.slice(at, 2, F.size(at) - 1), F.slice(at, 1, F.size(at) - 1), lambda end, begin: (end - begin).cast("long")).alias("c")))
    return _let(F.sort_array(tokens), runs)


def cosine_tf_expr(a, b) -> Column:
    """F-3 as one column expression: cosine of the term counts of two texts.

    Each token list is sorted and counted by its runs; the dot product visits the common tokens
    only. Per row, no shuffle. Texts without a 2-character token score 0."""
    zero = F.lit(0).cast("long")

    def count(side, w):
        return F.get(side["c"], (F.array_position(side["w"], w) - 1).cast("int"))

    def finish(v):
        x, y = v["x"], v["y"]
        dot = F.aggregate(F.array_intersect(x["w"], y["w"]), zero, lambda acc, w: acc + count(x, w) * count(y, w))
        nn = F.aggregate(x["c"], zero, lambda acc, c: acc + c * c) * F.aggregate(y["c"], zero, lambda acc, c: acc + c * c)
        return F.when(nn > 0, dot / F.sqrt(nn)).otherwise(F.lit(0.0))

    return _let(F.struct(_token_counts(T.tf_tokens(a)).alias("x"), _token_counts(T.tf_tokens(b)).alias("y")), finish)


def cosine_tf(df: DataFrame, id_col: str, a: str, b: str, out: str = "cosine") -> DataFrame:
    """F-3 on a table: adds ``out`` (see :func:`cosine_tf_expr`); ``id_col`` is kept for
    API stability (the computation is per row and needs no key)."""
    del id_col
    return df.withColumn(out, cosine_tf_expr(a, b))


def clean_text(c, lemmas: DataFrame | None = None):
    """PF-16 (re-aimed): lowercase, keep word tokens (punctuation and spaces dropped), join by
    one space. Lemmatisation by a user lemma table is :func:`lemmatise`."""
    return F.array_join(T.word_tokens(F.lower(F.coalesce(T.col(c), F.lit("")))), " ")


#: A lemma table of at most so many rows and bytes is looked up within the row.
LOOKUP_ROWS, LOOKUP_BYTES = 20_000, 1 << 20


def lemmatise(df: DataFrame, id_col: str, text_col: str, lemmas: DataFrame,
              word_col: str = "word", lemma_col: str = "lemma") -> DataFrame:
    """PF-16 with a lemma table (word -> lemma). Words without an entry stay as they are; rows of one
    id count as one text, their words in order of position.

    A lemma table measured small is looked up where the text is, so only ids are shuffled, to find those
    that several rows share. Those rows, and all of them if the table is larger, have their
    words exploded with their position, joined and put together again by id."""
    from notecover.operators.joins import join_small, measured_size
    from notecover.session import cut_lineage

    out = text_col + "_clean"
    lt = cut_lineage(lemmas.select(F.col(word_col).alias("_w"), F.col(lemma_col).alias("_l")).dropDuplicates(["_w"]))
    n, size = measured_size(lt)
    if n > LOOKUP_ROWS or size > LOOKUP_BYTES:
        return _lemmatise_exploded(df, id_col, text_col, lt, out)
    words = F.transform(T.word_tokens(F.lower(F.coalesce(F.col(text_col), F.lit("")))), _lemma_of(lt, max(n, 1)))
    text = F.when(F.col(id_col).isNull(), F.lit("")).otherwise(F.array_join(words, " "))
    shared = cut_lineage(df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > 1) & F.col(id_col).isNotNull()))
    if shared.isEmpty():
        return df.withColumn(out, text)
    marked = join_small(df, shared, [id_col], "left", salt_from=id_col).select(*df.columns, "_n")
    alone = marked.filter(F.col("_n").isNull()).drop("_n").withColumn(out, text)
    return alone.unionByName(_lemmatise_exploded(marked.filter(F.col("_n").isNotNull()).drop("_n"), id_col, text_col, lt, out).select(*alone.columns))


def _lemma_of(lt: DataFrame, buckets: int):
    """A function of a word: its lemma, or itself. The bounded table is a constant of the plan, an
    array of small maps by the word's hash, that tasks get as they get a broadcast."""
    def at(w):
        return F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    maps: list[dict] = [{} for _ in range(buckets)]
    for r in lt.filter(F.col("_w").isNotNull()).select("_w", "_l", at(F.col("_w")).alias("_b")).collect():
        maps[r["_b"]][r["_w"]] = r["_l"]
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,string>>")
    return lambda w: F.coalesce(F.try_element_at(F.get(table, at(w)), w), w)


def _lemmatise_exploded(df: DataFrame, id_col: str, text_col: str, lt: DataFrame, out: str) -> DataFrame:
    from notecover.operators.joins import join_small

    tok = df.select(F.col(id_col).alias("_id"),
                    F.posexplode(T.word_tokens(F.lower(F.coalesce(F.col(text_col), F.lit(""))))).alias("_pos", "_w"))
    joined = join_small(tok, lt, ["_w"], "left", salt_from="_id").select("_id", "_pos", F.coalesce("_l", "_w").alias("_t"))
    regrouped = joined.groupBy("_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_t"))), lambda s: s["_t"]), " ").alias(out))
    return df.join(regrouped.withColumnRenamed("_id", id_col), id_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))


def rule_signals(response, answer, skip_below: float | None = None) -> dict:
    """The five rule signals on cleaned (stripped, lowercased) texts, as lazy columns.
    Only the ones with a non-zero weight end up in the plan."""
    r, a = T.strip_lower(response), T.strip_lower(answer)
    return {
        "fuzzy": lcs.token_sort_ratio(r, a, skip_below),
        "levenshtein": T.levenshtein_ratio(r, a),
        "jaccard": T.jaccard(r, a),
        "number": T.number_match(r, a).cast("double"),
    }


def score_answers(df: DataFrame, response: str = "response", answer: str = "correct_answer",
                  weights: Mapping[str, float] = SHIPPED_WEIGHTS, guard: bool = True,
                  high: float = 0.60, low: float = 0.59, id_col: str = "pair_id",
                  for_labels_only: bool = False) -> DataFrame:
    """P-1 core: F-1 clean -> signals -> F-7 weighted score -> F-8 three-way label.

    ``guard`` applies PF-19 (non-answers -> -1), on by default; off reproduces the final
    scoring script. With ``for_labels_only`` the fuzzy ratio may return its length bound
    for pairs that cannot pass ``low`` (the label is the same, the work is skipped).
    """
    skip = low if for_labels_only else None
    sig = rule_signals(response, answer, skip)
    out = df
    if weights.get("cosine"):
        out = cosine_tf(out, id_col, response, answer, "_cos")
        sig["cosine"] = F.col("_cos")
    if weights.get("semantic"):
        sig["semantic"] = F.col("semantic")
    g = T.non_answer(response) if guard else None
    score = SW.weighted_score(sig, weights)
    out = out.withColumn("score", score)
    out = out.withColumn("guard", g if g is not None else F.lit(False))
    out = out.withColumn("predicted_label", SW.rule_label(F.col("score"), F.col("guard"), high, low))
    return out.drop("_cos") if "_cos" in out.columns else out

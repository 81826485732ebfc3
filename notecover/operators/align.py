"""Temporal alignment of an idea with the part of the notes that should hold it
(W-1 idea order, J-4 lookup, F-10 ... F-14 interval, budget and span)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators.joins import join_derived


def idea_order(train: DataFrame, test: DataFrame | None = None, order_col: str = "pair_id",
               source_col: str | None = None) -> DataFrame:
    """W-1, U-1, A-17: per topic, ideas ranked by first appearance in train then test.

    (topic, idea_unit, j, k, n_idea_tokens): j is 0-based, k the number of distinct ideas of
    the topic, n_idea_tokens the idea's F-14 token count (computed once per idea). Give
    either two frames, or one frame and ``source_col`` (0 = train row, 1 = test row).
    Rows are reduced to one row per (topic, idea) by a hash aggregate (first position in
    train, first position in test), so the window only sees distinct ideas."""
    cols = ["topic", "idea_unit"]
    if source_col is None:
        u = train.select(*cols, F.lit(0).alias("_src"), F.col(order_col).alias("_pos"))
        if test is not None:
            u = u.unionByName(test.select(*cols, F.lit(1).alias("_src"), F.col(order_col).alias("_pos")))
    else:
        u = train.select(*cols, F.col(source_col).alias("_src"), F.col(order_col).alias("_pos"))
    u = u.filter(F.col("topic").isNotNull() & F.col("idea_unit").isNotNull()) \
        .withColumn("topic", T.py_strip(F.col("topic")))
    first = u.groupBy(*cols).agg(F.min(F.when(F.col("_src") == 0, F.col("_pos"))).alias("_f0"),
                                 F.min(F.when(F.col("_src") != 0, F.col("_pos"))).alias("_f1"))
    w = Window.partitionBy("topic").orderBy(F.col("_f0").asc_nulls_last(), F.col("_f1").asc_nulls_last())
    return first.select("topic", "idea_unit", (F.row_number().over(w) - 1).cast("int").alias("j"),
                        F.count(F.lit(1)).over(Window.partitionBy("topic")).cast("int").alias("k"),
                        F.size(T.model_tokens("idea_unit")).alias("n_idea_tokens"))


def idea_position(pairs: DataFrame, order: DataFrame) -> DataFrame:
    """J-4: attach (j, k) of each pair's idea; unknown ideas keep nulls (segment fallback)."""
    salt = "pair_id" if "pair_id" in pairs.columns else None
    return join_derived(pairs, order, ["topic", "idea_unit"], "left", salt_from=salt)


def align_interval(j="j", k="k", segment="segment", margin: float = 0.1) -> tuple[Column, Column]:
    """F-10 / F-11: (alpha, beta) = [max(0, j/K - m), min(1, (j+1)/K + m)], or the segment
    fallback centre (s - 0.5)/4 ± m when j is unknown (segment defaults to 1)."""
    jj, kk = F.col(j).cast("double"), F.col(k).cast("double")
    known = F.col(j).isNotNull() & F.col(k).isNotNull() & (F.col(k) > 0)
    m = F.lit(float(margin))
    seg = F.coalesce(F.col(segment), F.lit(1)).cast("double")
    centre = (seg - 0.5) / 4.0
    alpha = F.when(known, F.greatest(F.lit(0.0), jj / kk - m)).otherwise(F.greatest(F.lit(0.0), centre - m))
    beta = F.when(known, F.least(F.lit(1.0), (jj + 1.0) / kk + m)).otherwise(F.least(F.lit(1.0), centre + m))
    return alpha, beta


def token_budget(idea_tokens: Column, max_length: int = 256) -> Column:
    """F-12: max_length - idea tokens - 3; if that is <= 32, max(max_length div 2, 32)."""
    b = F.lit(max_length) - idea_tokens - 3
    return F.when(b <= 32, F.lit(max(max_length // 2, 32))).otherwise(b)


def span_bounds(alpha: Column, beta: Column, n_tokens: Column, budget: Column) -> tuple[Column, Column, Column]:
    """F-13 arithmetic: start = floor(alpha L), end = floor(beta L); if end <= start,
    end = min(L, start + budget); taken = min(end - start, budget) (>= 0)."""
    L = n_tokens
    start = F.floor(alpha * L).cast("int")
    raw_end = F.floor(beta * L).cast("int")
    end = F.when(raw_end <= start, F.least(L, start + budget)).otherwise(raw_end)
    taken = F.greatest(F.lit(0), F.least(end - start, budget))
    return start, end, taken


def aligned_span(df: DataFrame, notes_col: str = "full_notes", idea_col: str = "idea_unit",
                 margin: float = 0.1, max_length: int = 256, tokens_col: str | None = None,
                 idea_tokens_col: str | None = None) -> DataFrame:
    """F-13 + F-14: the idea-specific chunk of the full notes as text (tokens joined by one
    space; no notes or no tokens -> ''). Adds note_text, span_start, span_end, span_len.

    Pass ``tokens_col`` when the notes were tokenised before the pair fan-out (one
    tokenisation per note instead of one per pair), and ``idea_tokens_col`` when the idea's
    token count came with the idea order (one count per idea)."""
    toks = F.coalesce(F.col(tokens_col), F.array().cast("array<string>")) if tokens_col else T.model_tokens(notes_col)
    out = df.withColumn("_toks", toks).withColumn("_L", F.size("_toks"))
    n_idea = F.col(idea_tokens_col) if idea_tokens_col else F.size(T.model_tokens(idea_col))
    out = out.withColumn("_budget", token_budget(n_idea, max_length))
    alpha, beta = align_interval(margin=margin)
    start, end, taken = span_bounds(alpha, beta, F.col("_L"), F.col("_budget"))
    out = out.withColumn("span_start", start).withColumn("span_end", end).withColumn("span_len", taken)
    text = F.when(F.col("_L") == 0, F.lit("")).otherwise(
        F.array_join(F.slice("_toks", F.col("span_start") + 1, F.col("span_len")), " "))
    drop = ["_toks", "_L", "_budget"] + ([tokens_col] if tokens_col else [])
    return out.withColumn("note_text", text).drop(*drop)

"""Pair assembly: joins of pairs with notes and examples (J-1 ... J-5, J-7), segment choice
(PF-9, PF-10, PF-20), first row per key (W-2) and one-shot example choice (W-3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators.joins import join_derived, join_small
from notecover.sources.tables import wide

SEGMENTS = ("segment1_notes", "segment2_notes", "segment3_notes", "segment4_notes")


def keep_first(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """W-2: the first row per key in ``order_cols`` order.

    A hash aggregate with ``min_by`` (partial per partition, so a hot key costs one row
    per partition before the shuffle), not a sort of whole rows inside a window.
    """
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_cols])
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), order).alias("_r"))
    return agg.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def segment_pick(segment: Column | str, seg_cols: Sequence[str] = SEGMENTS) -> Column:
    """PF-9: the note segment named by the pair's segment number; invalid or null -> ''."""
    s = F.col(segment) if isinstance(segment, str) else segment
    inside = s.isNotNull() & (s >= 1) & (s <= len(seg_cols))
    return F.when(inside, F.coalesce(F.element_at(F.array(*seg_cols), s.cast("int")), F.lit(""))).otherwise(F.lit(""))


def full_text(seg_cols: Sequence[str] = SEGMENTS) -> Column:
    """PF-10: non-null segments joined by one space, stripped."""
    return T.py_strip(F.concat_ws(" ", *[F.col(c) for c in seg_cols]))


def attach_experiment(train: DataFrame, notes: DataFrame, order_cols: Sequence[str] = ("id",)) -> DataFrame:
    """J-1: experiment of the first notes row per (topic, id); unmatched -> 'UNK'.

    Keeping one row per key first makes the join many-to-one by construction."""
    if not {"topic", "id", "experiment"} <= set(notes.columns):
        return train.withColumn("experiment", F.lit("UNK"))
    m = keep_first(notes.select("topic", "id", "experiment", *[c for c in order_cols if c not in ("topic", "id", "experiment")]),
                   ["topic", "id"], order_cols).select("topic", "id", "experiment")
    base = train.drop("experiment") if "experiment" in train.columns else train
    return base.join(m, ["topic", "id"], "left").withColumn("experiment", F.coalesce("experiment", F.lit("UNK")))


def segment_text(pairs: DataFrame, notes: DataFrame, seg_cols: Sequence[str] = SEGMENTS,
                 dedup: bool = False, order_cols: Sequence[str] = ("id",)) -> DataFrame:
    """J-2 + PF-9: left join with notes on (experiment?, topic, id), pick the segment text.

    Notes with several rows per key fan out (the reference's behaviour) unless ``dedup``.
    Clashing note columns get the suffix ``_note``."""
    keys = ["topic", "id"] + (["experiment"] if "experiment" in pairs.columns and "experiment" in notes.columns else [])
    n = keep_first(notes, keys, order_cols) if dedup else notes
    clash = [c for c in n.columns if c in pairs.columns and c not in keys]
    for c in clash:
        n = n.withColumnRenamed(c, c + "_note")
    j = pairs.join(n, keys, "left")
    return j.withColumn("segment_text", segment_pick("segment", seg_cols))


def full_notes(pairs: DataFrame, notes: DataFrame, seg_cols: Sequence[str] = SEGMENTS,
               order_cols: Sequence[str] = ("id",), tokens_col: str | None = None) -> DataFrame:
    """J-3 + PF-10: full note text of (topic, id[, experiment]), first match, '' if none.

    A keep-first aggregate and one equi-join replace the per-pair scan of the notes.
    ``tokens_col`` gives the note's tokens (F-14) instead of its text, tokenised once per
    note, before the pairs fan out. What follows is costly per pair, not per byte, so the pairs
    are dealt to a number of tasks that is not cut down by their size in bytes."""
    keys = ["topic", "id"] + (["experiment"] if "experiment" in pairs.columns and "experiment" in notes.columns else [])
    n = keep_first(notes.select(*keys, *seg_cols, *[c for c in order_cols if c not in keys and c not in seg_cols]),
                   keys, order_cols)
    pairs = pairs.repartition(wide(pairs.sparkSession), *keys)
    if tokens_col:
        return pairs.join(n.select(*keys, T.model_tokens(full_text(seg_cols)).alias(tokens_col)), keys, "left")
    n = n.select(*keys, full_text(seg_cols).alias("full_notes"))
    return pairs.join(n, keys, "left").withColumn("full_notes", F.coalesce("full_notes", F.lit("")))


def construct_pairs(notes: DataFrame, ideas: DataFrame, seg_cols: Sequence[str] = SEGMENTS) -> DataFrame:
    """J-7: every idea of a topic x every non-empty segment of that topic's notes.

    Segments are unpivoted (one row per note segment); the idea table is joined by topic,
    broadcast after a size check. Output grows as segments x ideas-per-topic."""
    seg = notes.select("topic", "id", F.posexplode(F.array(*[F.col(c) for c in seg_cols])).alias("_p", "segment_text")) \
        .filter(F.col("segment_text").isNotNull()) \
        .select("topic", "id", (F.col("_p") + 1).cast("int").alias("segment"), "segment_text")
    return join_small(seg, ideas, ["topic"], salt_from="id")


def one_shot_examples(train: DataFrame, order_col: str = "pair_id", text_col: str = "segment_text") -> DataFrame:
    """W-3: one example row per topic.

    Preference: non-empty text with label 1 (highest lexical overlap), else non-empty text
    (highest overlap), else the first row. One aggregate per topic with ``max_by`` on the
    key (tier, overlap, -position); ties go to the lowest position."""
    has_text = T.non_empty(text_col)
    tier = F.when(has_text & (F.col("label") == 1), 2).when(has_text, 1).otherwise(0)
    ov = T.lexical_overlap("idea_unit", text_col)
    key = F.struct(tier.alias("tier"), F.when(tier > 0, ov).otherwise(F.lit(0.0)).alias("ov"),
                   (-F.col(order_col)).alias("neg_pos"))
    row = F.struct(F.col("idea_unit").alias("ex_idea"), F.coalesce(F.col(text_col), F.lit("")).alias("ex_note"),
                   F.col("label").alias("ex_label"), F.col(order_col).alias("ex_pos"))
    agg = train.groupBy("topic").agg(F.max_by(row, key).alias("_e"))
    return agg.select("topic", "_e.*")


def one_shot_join(pairs: DataFrame, examples: DataFrame, order_col: str = "pair_id") -> DataFrame:
    """J-5: attach the topic's example (broadcast after a size check); a topic without one
    keeps null example columns and falls back to the zero-shot prompt. ``is_self`` marks the
    pair that is its own example (it is kept)."""
    salt = order_col if order_col in pairs.columns else None
    j = join_derived(pairs, examples, ["topic"], "left", salt_from=salt)
    if salt is None:
        return j
    return j.withColumn("is_self", F.coalesce(F.col("ex_pos") == F.col(order_col), F.lit(False)))

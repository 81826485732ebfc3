"""Registered preparation queries: cleaning (PF-*), joins (J-*), ranking (W-*), splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators import align as AL
from notecover.operators import clean as CL
from notecover.operators import pairs as PR
from notecover.operators import split as SP
from notecover.plans import sqlparts as S
from notecover.plans.registry import query, r6
from notecover.sources import fixtures as FX
from notecover.sources.fixtures import with_fixtures as W

WS = T.WS


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"


def num_sql(x: str) -> str:
    v = f"TRY_CAST({strip_sql(x)} AS DOUBLE)"
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def int_sql(x: str, t: str = "BIGINT") -> str:
    return f"CAST(trunc({x}) AS {t})"


RAW_TRAIN_RENAMED = ("experiment_raw AS experiment", "topic_raw AS topic", "id_raw AS id",
                     "segment_raw AS segment", "idea_unit_raw AS idea_unit", "label_raw AS label")


def _raw_train(spark, sf_dir):
    r = FX.raw_train(spark, sf_dir)
    return r.selectExpr("pair_id", *RAW_TRAIN_RENAMED)


def _coerced_sql(labelled: bool) -> str:
    seg = f"(CASE WHEN {num_sql('segment_raw')} IN (1, 2, 3, 4) THEN {num_sql('segment_raw')} END)"
    cond = [f"{strip_sql('topic_raw')} IS NOT NULL", f"{num_sql('id_raw')} IS NOT NULL", f"{seg} IS NOT NULL",
            "idea_unit_raw IS NOT NULL"] + ([f"{num_sql('label_raw')} IS NOT NULL"] if labelled else [])
    return (f"SELECT pair_id, experiment_raw AS experiment, {strip_sql('topic_raw')} AS topic, "
            f"{int_sql(num_sql('id_raw'))} AS id, {int_sql(seg, 'INTEGER')} AS segment, idea_unit_raw AS idea_unit, "
            f"{int_sql(num_sql('label_raw'), 'INTEGER')} AS label FROM raw_train WHERE " + " AND ".join(cond))


# ---------------------------------------------------------------- PF-3
@query("clean_notes", W(f"""
SELECT coalesce({strip_sql('experiment_raw')}, 'UNK') AS experiment, {strip_sql('topic_raw')} AS topic,
       {int_sql(num_sql('id_raw'))} AS id, segment1_notes, segment2_notes, segment3_notes, segment4_notes
FROM raw_notes WHERE {strip_sql('topic_raw')} IS NOT NULL AND {num_sql('id_raw')} IS NOT NULL""", "raw_notes"))
def q_clean_notes(spark, sf_dir):
    raw = FX.raw_notes(spark, sf_dir).withColumnRenamed("experiment_raw", "experiment") \
        .withColumnRenamed("topic_raw", "topic").withColumnRenamed("id_raw", "id")
    c = CL.coerce_notes(raw)
    return c.select("experiment", "topic", "id", *FX.SEGMENTS)


# ---------------------------------------------------------------- PF-4, PF-6
@query("clean_train", W(_coerced_sql(True), "raw_train"))
def q_clean_train(spark, sf_dir):
    return CL.coerce_pairs(_raw_train(spark, sf_dir), labelled=True) \
        .select("pair_id", "experiment", "topic", "id", "segment", "idea_unit", "label")


# ---------------------------------------------------------------- PF-5
@query("clean_test", W(_coerced_sql(False), "raw_train"))
def q_clean_test(spark, sf_dir):
    return CL.coerce_pairs(_raw_train(spark, sf_dir), labelled=False) \
        .select("pair_id", "experiment", "topic", "id", "segment", "idea_unit", "label")


# ---------------------------------------------------------------- PF-7
@query("drop_report", W(f"""
SELECT count(*) AS n_in, count(*) FILTER (WHERE NOT bad) AS n_kept, count(*) FILTER (WHERE bad) AS n_dropped,
  count(*) FILTER (WHERE bt) AS bad_topic, count(*) FILTER (WHERE bi) AS bad_id, count(*) FILTER (WHERE bs) AS bad_segment,
  count(*) FILTER (WHERE bu) AS bad_idea, count(*) FILTER (WHERE bl) AS bad_label
FROM (SELECT *, bt OR bi OR bs OR bu OR bl AS bad FROM (
  SELECT {strip_sql('topic_raw')} IS NULL AS bt, {num_sql('id_raw')} IS NULL AS bi,
         coalesce({num_sql('segment_raw')} NOT IN (1, 2, 3, 4), true) AS bs, idea_unit_raw IS NULL AS bu,
         {num_sql('label_raw')} IS NULL AS bl FROM raw_train) a) b""", "raw_train"))
def q_drop_report(spark, sf_dir):
    return CL.drop_report(_raw_train(spark, sf_dir), labelled=True)


# ---------------------------------------------------------------- PF-8, PF-20
@query("fill_text", W(f"""
SELECT pair_id, segment_text AS note_text,
  CAST(length({strip_sql('segment_text')}) > 0 AS INTEGER) AS has_text FROM pairs""", "pairs"))
def q_fill_text(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False).withColumnRenamed("segment_text", "note_text")
    p = CL.fill_text(p, ("note_text",))
    return p.select("pair_id", "note_text", T.non_empty("note_text").cast("int").alias("has_text"))


# ---------------------------------------------------------------- PF-12, PF-22
LOGIT_ARR = "TRY_CAST(z AS DOUBLE[])"


@query("complete_cases", W(f"""
SELECT count(*) AS n_in, count(*) FILTER (WHERE y IS NULL) AS missing_label,
  count(*) FILTER (WHERE y IS NOT NULL AND pred IS NULL) AS missing_pred,
  count(*) FILTER (WHERE y IS NOT NULL AND pred IS NOT NULL) AS n_kept
FROM (SELECT CASE WHEN id % 13 = 0 THEN NULL ELSE y END AS y,
        CASE WHEN {LOGIT_ARR} IS NULL THEN NULL
             ELSE list_position({LOGIT_ARR}, list_max({LOGIT_ARR})) - 1 END AS pred FROM logits) x""", "logits"))
def q_complete_cases(spark, sf_dir):
    from notecover.operators import score as SC
    lg = FX.logits(spark, sf_dir).withColumn("_a", SC.parse_logits("z"))
    d = lg.select(F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(F.col("y")).alias("y"),
                  F.when(F.col("_a").isNotNull(), SC.argmax("_a")).alias("pred"))
    return CL.completeness_report(d, "y", "pred")


# ---------------------------------------------------------------- PF-14
BIN_IN_SQL = ("CASE pair_id % 11 WHEN 2 THEN 'yes' WHEN 3 THEN ' No' WHEN 4 THEN 'TRUE' WHEN 5 THEN 'f' "
              "WHEN 6 THEN 'maybe' ELSE label_raw END")


@query("binary_coerce", W(f"""
SELECT pair_id, coalesce({num_sql('v')}, CASE WHEN lower({strip_sql('v')}) IN ('yes', 'y', 'true', 't') THEN 1.0
  WHEN lower({strip_sql('v')}) IN ('no', 'n', 'false', 'f') THEN 0.0 END) AS value
FROM (SELECT pair_id, {BIN_IN_SQL} AS v FROM raw_train) x""", "raw_train"))
def q_binary_coerce(spark, sf_dir):
    r = FX.raw_train(spark, sf_dir)
    k = F.col("pair_id") % 11
    v = (F.when(k == 2, "yes").when(k == 3, " No").when(k == 4, "TRUE").when(k == 5, "f").when(k == 6, "maybe")
         .otherwise(F.col("label_raw")))
    return r6(r.select("pair_id", CL.coerce_binary(v).alias("value")))


# ---------------------------------------------------------------- PF-15
@query("percent_rescale", W("""
SELECT id, round(CASE WHEN (SELECT max(score) FILTER (WHERE NOT isnan(score)) FROM scored_fine) > 1.5
  THEN score / 100 ELSE score END, 6) AS score FROM scored_fine""", "scored_fine"))
def q_percent_rescale(spark, sf_dir):
    return r6(CL.percent_rescale(FX.scored_fine(spark, sf_dir), "score").select("id", "score"))


# ---------------------------------------------------------------- J-1, W-2
@query("attach_experiment", W("""
SELECT p.pair_id, coalesce(m.experiment, 'UNK') AS experiment FROM pairs p
LEFT JOIN (SELECT topic, id, arg_min(experiment, id) AS experiment FROM notes GROUP BY topic, id) m
  ON m.topic = p.topic AND m.id = p.id WHERE p.label IS NOT NULL""", "pairs"))
def q_attach_experiment(spark, sf_dir):
    train = FX.pairs(spark, sf_dir).filter(F.col("label").isNotNull()).drop("experiment")
    out = PR.attach_experiment(train, FX.notes(spark, sf_dir), ("id",))
    return out.select("pair_id", "experiment")


# ---------------------------------------------------------------- J-2, PF-9
@query("segment_text", W("""
SELECT p.pair_id, coalesce(CASE WHEN p.segment BETWEEN 1 AND 4 THEN
  [n.segment1_notes, n.segment2_notes, n.segment3_notes, n.segment4_notes][p.segment] END, '') AS segment_text
FROM pairs p LEFT JOIN notes n ON n.experiment = p.experiment AND n.topic = p.topic AND n.id = p.id""", "pairs"))
def q_segment_text(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, labels=False)
    return PR.segment_text(p, FX.notes(spark, sf_dir)).select("pair_id", "segment_text")


# ---------------------------------------------------------------- J-3, PF-10
@query("full_notes", W(f"""
SELECT p.pair_id, coalesce({strip_sql("concat_ws(' ', n.segment1_notes, n.segment2_notes, n.segment3_notes, n.segment4_notes)")}, '')
  AS full_notes
FROM pairs p LEFT JOIN notes n ON n.experiment = p.experiment AND n.topic = p.topic AND n.id = p.id""", "pairs"))
def q_full_notes(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, labels=False)
    return PR.full_notes(p, FX.notes(spark, sf_dir)).select("pair_id", "full_notes")


# ---------------------------------------------------------------- W-1, A-17, U-1
ORDER_CTES = (
    "u AS (SELECT topic, idea_unit, 0 AS src, pair_id AS p FROM pairs WHERE label IS NOT NULL "
    "UNION ALL SELECT topic, idea_unit, 1, pair_id FROM pairs WHERE label IS NULL)",
    f"f AS (SELECT {strip_sql('topic')} AS topic, idea_unit, min(src * 1000000000000000 + p) AS first FROM u "
    "WHERE topic IS NOT NULL AND idea_unit IS NOT NULL GROUP BY 1, 2)",
    "o AS (SELECT topic, idea_unit, CAST(row_number() OVER (PARTITION BY topic ORDER BY first) - 1 AS INTEGER) AS j, "
    "CAST(count(*) OVER (PARTITION BY topic) AS INTEGER) AS k FROM f)",
)


def _order(spark, sf_dir):
    # train rows = labelled pairs, test rows = unlabelled pairs; one pass over the pairs
    p = FX.pairs(spark, sf_dir).withColumn("_src", F.col("label").isNull().cast("int"))
    return AL.idea_order(p, order_col="pair_id", source_col="_src")


@query("idea_order", W("SELECT topic, idea_unit, j, k FROM o", "pairs", extra=ORDER_CTES))
def q_idea_order(spark, sf_dir):
    return _order(spark, sf_dir).drop("n_idea_tokens")


# ---------------------------------------------------------------- J-4
@query("idea_position", W("""
SELECT p.pair_id, o.j, o.k FROM pairs p LEFT JOIN o ON o.topic = p.topic AND o.idea_unit = p.idea_unit""",
                          "pairs", extra=ORDER_CTES))
def q_idea_position(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, labels=False)
    return AL.idea_position(p, _order(spark, sf_dir).drop("n_idea_tokens")).select("pair_id", "j", "k")


# ---------------------------------------------------------------- W-2
@query("first_note", W("""
SELECT topic, arg_min(id, id) AS id, arg_min(experiment, id) AS experiment FROM notes GROUP BY topic""", "notes"))
def q_first_note(spark, sf_dir):
    n = FX.notes(spark, sf_dir).select("topic", "id", "experiment")
    return PR.keep_first(n, ["topic"], ["id"])


# ---------------------------------------------------------------- W-3
EXAMPLE_CTES = (
    f"tr AS (SELECT *, CASE WHEN ht AND label = 1 THEN 2 WHEN ht THEN 1 ELSE 0 END AS tier FROM ("
    f"SELECT pair_id, topic, idea_unit, segment_text, label, length({strip_sql('segment_text')}) > 0 AS ht, "
    f"CASE WHEN len({S.overlap_set('idea_unit')}) = 0 THEN 0.0 ELSE len(list_intersect({S.overlap_set('idea_unit')}, "
    f"{S.overlap_set('segment_text')})) / len({S.overlap_set('idea_unit')}) END AS ov FROM pairs WHERE label IS NOT NULL) a)",
    "ex AS (SELECT topic, idea_unit AS ex_idea, segment_text AS ex_note, label AS ex_label, pair_id AS ex_pos FROM ("
    "SELECT *, row_number() OVER (PARTITION BY topic ORDER BY tier DESC, CASE WHEN tier > 0 THEN ov ELSE 0.0 END DESC, "
    "pair_id ASC) AS rn FROM tr) b WHERE rn = 1)",
)


def _examples(spark, sf_dir):
    train = FX.pairs(spark, sf_dir, with_text=True).filter(F.col("label").isNotNull())
    return PR.one_shot_examples(train, "pair_id", "segment_text")


@query("one_shot_example", W("SELECT topic, ex_idea, ex_note, ex_label, ex_pos FROM ex", "pairs",
                             extra=EXAMPLE_CTES))
def q_one_shot_example(spark, sf_dir):
    return _examples(spark, sf_dir)


# ---------------------------------------------------------------- J-5
@query("one_shot_join", W("""
SELECT p.pair_id, ex.ex_pos, CAST(ex.ex_pos IS NOT NULL AS INTEGER) AS has_example
FROM pairs p LEFT JOIN ex ON ex.topic = p.topic WHERE p.label IS NULL""", "pairs", extra=EXAMPLE_CTES))
def q_one_shot_join(spark, sf_dir):
    test = FX.pairs(spark, sf_dir).filter(F.col("label").isNull())
    j = PR.one_shot_join(test, _examples(spark, sf_dir))
    return j.select("pair_id", "ex_pos", F.col("ex_pos").isNotNull().cast("int").alias("has_example"))


# ---------------------------------------------------------------- J-7
@query("pair_construction", W("""
SELECT s.topic, s.id, s.segment, i.pos, i.idea_unit, s.segment_text FROM (
  SELECT topic, id, 1 AS segment, segment1_notes AS segment_text FROM notes UNION ALL
  SELECT topic, id, 2, segment2_notes FROM notes UNION ALL SELECT topic, id, 3, segment3_notes FROM notes UNION ALL
  SELECT topic, id, 4, segment4_notes FROM notes) s JOIN ideas i ON i.topic = s.topic
WHERE s.segment_text IS NOT NULL""", "notes", "ideas"))
def q_pair_construction(spark, sf_dir):
    p = PR.construct_pairs(FX.notes(spark, sf_dir), FX.ideas(spark, sf_dir))
    return p.select("topic", "id", "segment", "pos", "idea_unit", "segment_text")


# ---------------------------------------------------------------- W-4
ONESHOT_CTE = ("os AS (SELECT pair_id, CASE WHEN row_number() OVER (PARTITION BY experiment, topic "
               "ORDER BY md5('42-' || CAST(pair_id AS VARCHAR)), pair_id) = 1 THEN 'train' ELSE 'heldout' END AS split "
               "FROM pairs WHERE label IS NOT NULL)")


def _oneshot(spark, sf_dir):
    train = FX.pairs(spark, sf_dir).filter(F.col("label").isNotNull())
    return SP.oneshot_split(train, 42, "pair_id")


@query("oneshot_split", W("SELECT pair_id, split FROM os", "pairs", extra=(ONESHOT_CTE,)))
def q_oneshot_split(spark, sf_dir):
    return _oneshot(spark, sf_dir).select("pair_id", "split")


# ---------------------------------------------------------------- J-9
@query("held_out", W("""
SELECT p.pair_id FROM pairs p WHERE p.label IS NOT NULL
  AND p.pair_id NOT IN (SELECT pair_id FROM os WHERE split = 'train')""", "pairs", extra=(ONESHOT_CTE,)))
def q_held_out(spark, sf_dir):
    train = FX.pairs(spark, sf_dir).filter(F.col("label").isNotNull())
    picked = _oneshot(spark, sf_dir).filter(F.col("split") == "train")
    return SP.held_out(train, picked, "pair_id").select("pair_id")


# ---------------------------------------------------------------- W-5
RANDOM_CTE = ("rs AS (SELECT pair_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || CAST(pair_id AS VARCHAR)), "
              "pair_id) <= floor(0.2 * count(*) OVER ()) THEN 'val' ELSE 'train' END AS split "
              "FROM pairs WHERE label IS NOT NULL)")


@query("random_split", W("SELECT pair_id, split FROM rs", "pairs", extra=(RANDOM_CTE,)))
def q_random_split(spark, sf_dir):
    train = FX.pairs(spark, sf_dir).filter(F.col("label").isNotNull())
    return SP.random_split(train, 42, 0.2, "pair_id").select("pair_id", "split")


# ---------------------------------------------------------------- PF-10 on conversation notes (pivoted turns)
@query("conversation_notes", W(f"""
SELECT id, coalesce({strip_sql("concat_ws(' ', segment1_notes, segment2_notes, segment3_notes, segment4_notes)")}, '')
  AS full_notes, CAST((segment1_notes IS NOT NULL) AS INTEGER) + CAST((segment2_notes IS NOT NULL) AS INTEGER)
  + CAST((segment3_notes IS NOT NULL) AS INTEGER) + CAST((segment4_notes IS NOT NULL) AS INTEGER) AS n_segments
FROM conv_notes""", "conv_notes"))
def q_conversation_notes(spark, sf_dir):
    n = FX.conv_notes(spark, sf_dir)
    cnt = sum((F.col(c).isNotNull().cast("int") for c in FX.SEGMENTS), F.lit(0))
    return n.select("id", F.coalesce(PR.full_text(), F.lit("")).alias("full_notes"), cnt.alias("n_segments"))

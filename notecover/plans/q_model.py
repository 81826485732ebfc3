"""Registered alignment, prompt, scoring, error-analysis queries and the model chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators import align as AL
from notecover.operators import curves as C
from notecover.operators import errors as ER
from notecover.operators import metrics as M
from notecover.operators import pairs as PR
from notecover.operators import prompt as PM
from notecover.operators import score as SC
from notecover.operators import split as SP
from notecover.plans import sqlparts as S
from notecover.plans.q_prep import EXAMPLE_CTES, ONESHOT_CTE, ORDER_CTES, _examples, _order, strip_sql
from notecover.plans.q_text import JACC_CTE
from notecover.plans.registry import query, r6
from notecover.sources import fixtures as FX
from notecover.sources.fixtures import with_fixtures as W

TOK = T.TOK


def lit_sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def toks_sql(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOK}')"


# ---------------------------------------------------------------- F-10, F-11 (order from the one-shot picks only)
ORDER2_CTES = (
    ONESHOT_CTE,
    "u2 AS (SELECT p.topic, p.idea_unit, p.pair_id AS p FROM pairs p JOIN os USING (pair_id) WHERE os.split = 'train')",
    f"f2 AS (SELECT {strip_sql('topic')} AS topic, idea_unit, min(p) AS first FROM u2 GROUP BY 1, 2)",
    "o2 AS (SELECT topic, idea_unit, CAST(row_number() OVER (PARTITION BY topic ORDER BY first) - 1 AS INTEGER) AS j, "
    "CAST(count(*) OVER (PARTITION BY topic) AS INTEGER) AS k FROM f2)",
)
ALPHA_SQL = ("CASE WHEN o.j IS NOT NULL AND o.k > 0 THEN greatest(CAST(0 AS DOUBLE), o.j / o.k - CAST(0.1 AS DOUBLE)) "
             "ELSE greatest(CAST(0 AS DOUBLE), (CAST(coalesce(p.segment, 1) AS DOUBLE) - CAST(0.5 AS DOUBLE)) / 4 "
             "- CAST(0.1 AS DOUBLE)) END")
BETA_SQL = ("CASE WHEN o.j IS NOT NULL AND o.k > 0 THEN least(CAST(1 AS DOUBLE), (o.j + CAST(1 AS DOUBLE)) / o.k "
            "+ CAST(0.1 AS DOUBLE)) ELSE least(CAST(1 AS DOUBLE), (CAST(coalesce(p.segment, 1) AS DOUBLE) "
            "- CAST(0.5 AS DOUBLE)) / 4 + CAST(0.1 AS DOUBLE)) END")


@query("align_interval", W(f"""
SELECT p.pair_id, round({ALPHA_SQL}, 6) AS alpha, round({BETA_SQL}, 6) AS beta
FROM pairs p LEFT JOIN o2 o ON o.topic = p.topic AND o.idea_unit = p.idea_unit""", "pairs", extra=ORDER2_CTES))
def q_align_interval(spark, sf_dir):
    p = FX.pairs(spark, sf_dir)
    picked = SP.oneshot_split(p.filter(F.col("label").isNotNull()), 42, "pair_id").filter(F.col("split") == "train")
    order = AL.idea_order(picked, None, "pair_id").drop("n_idea_tokens")
    a, b = AL.align_interval(margin=0.1)
    return r6(AL.idea_position(p, order).select("pair_id", a.alias("alpha"), b.alias("beta")))


# ---------------------------------------------------------------- F-12
@query("token_budget", W(f"""
SELECT pair_id, n, CASE WHEN 256 - n - 3 <= 32 THEN 128 ELSE 256 - n - 3 END AS budget_256,
  CASE WHEN 64 - n - 3 <= 32 THEN 32 ELSE 64 - n - 3 END AS budget_64
FROM (SELECT pair_id, CAST(len({toks_sql('idea_unit')}) AS INTEGER) AS n FROM pairs) x""", "pairs"))
def q_token_budget(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, labels=False)
    n = F.size(T.model_tokens("idea_unit"))
    return p.select("pair_id", n.alias("n"), AL.token_budget(n, 256).alias("budget_256"),
                    AL.token_budget(n, 64).alias("budget_64"))


# ---------------------------------------------------------------- F-13, F-14 (notes tokenised once per note)
FULL_SQL = strip_sql("concat_ws(' ', segment1_notes, segment2_notes, segment3_notes, segment4_notes)")
SPAN_CTES = ORDER_CTES + (
    f"nt AS (SELECT experiment, topic, id, {toks_sql(FULL_SQL)} AS toks FROM notes)",
    f"sp0 AS (SELECT p.pair_id, p.label, p.idea_unit, coalesce(nt.toks, []) AS toks, len(coalesce(nt.toks, [])) AS L, "
    f"{ALPHA_SQL} AS alpha, {BETA_SQL} AS beta, "
    f"CASE WHEN 256 - len({toks_sql('p.idea_unit')}) - 3 <= 32 THEN 128 ELSE 256 - len({toks_sql('p.idea_unit')}) - 3 END AS budget "
    "FROM pairs p LEFT JOIN nt ON nt.experiment = p.experiment AND nt.topic = p.topic AND nt.id = p.id "
    "LEFT JOIN o ON o.topic = p.topic AND o.idea_unit = p.idea_unit)",
    "sp1 AS (SELECT *, CAST(floor(alpha * L) AS INTEGER) AS s0, CAST(floor(beta * L) AS INTEGER) AS e0 FROM sp0)",
    "sp2 AS (SELECT *, CASE WHEN e0 <= s0 THEN least(L, s0 + budget) ELSE e0 END AS e1 FROM sp1)",
    "sp AS (SELECT pair_id, label, idea_unit, s0 AS span_start, CAST(e1 AS INTEGER) AS span_end, "
    "CAST(greatest(0, least(e1 - s0, budget)) AS INTEGER) AS span_len, "
    "CASE WHEN L = 0 THEN '' ELSE array_to_string(toks[s0 + 1 : s0 + greatest(0, least(e1 - s0, budget))], ' ') END "
    "AS note_text FROM sp2)",
)


def _spans(spark, sf_dir, margin=0.1, max_length=256, labels=True):
    # Pairs are notes x ideas here, so each note's token array is computed once and rides
    # along the broadcast fan-out (no shuffle of token arrays). For an external pair table
    # the same spans come from full_notes (J-3, a keyed equi-join) + aligned_span.
    def carry(n):
        return n.withColumn("_note_toks", T.model_tokens(PR.full_text()))
    order = _order(spark, sf_dir)      # J-4 on the ideas: a position belongs to (topic, idea), so the fan-out carries it
    j = FX.pairs(spark, sf_dir, carry=carry, idea_carry=lambda i: AL.idea_position(i, order), labels=labels)
    return AL.aligned_span(j, tokens_col="_note_toks", margin=margin, max_length=max_length,
                           idea_tokens_col="n_idea_tokens")


@query("aligned_span", W("SELECT pair_id, span_start, span_end, span_len, note_text FROM sp", "pairs",
                         extra=SPAN_CTES))
def q_aligned_span(spark, sf_dir):
    return _spans(spark, sf_dir, labels=False).select("pair_id", "span_start", "span_end", "span_len", "note_text")


# ---------------------------------------------------------------- F-19
def _strip(x):
    return f"coalesce({strip_sql(x)}, '')"


def zero_shot_sql(idea: str, note: str) -> str:
    return " || ".join([lit_sql(PM.INSTRUCTIONS + PM.QUERY_HEAD.lstrip("\n")), _strip(idea), lit_sql(PM.QUERY_NOTE),
                        _strip(note), lit_sql(PM.TAIL)])


def one_shot_sql(idea, note, ex_idea, ex_note, ex_label) -> str:
    return " || ".join([lit_sql(PM.INSTRUCTIONS + PM.EXAMPLE_HEAD.lstrip("\n")), _strip(ex_idea),
                        lit_sql(PM.EXAMPLE_NOTE), _strip(ex_note), lit_sql(PM.EXAMPLE_ANSWER),
                        f"CASE WHEN {ex_label} = 1 THEN 'YES' ELSE 'NO' END", lit_sql(PM.QUERY_HEAD), _strip(idea),
                        lit_sql(PM.QUERY_NOTE), _strip(note), lit_sql(PM.TAIL)])


@query("prompt_zero_shot", W(f"SELECT pair_id, {zero_shot_sql('idea_unit', 'segment_text')} AS prompt FROM pairs",
                             "pairs"))
def q_prompt_zero_shot(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False)
    return p.select("pair_id", PM.zero_shot(F.col("idea_unit"), F.col("segment_text")).alias("prompt"))


# ---------------------------------------------------------------- F-20 (+ J-5 fallback to zero-shot)
@query("prompt_one_shot", W(f"""
SELECT p.pair_id, CASE WHEN ex.ex_pos IS NULL THEN {zero_shot_sql('p.idea_unit', 'p.segment_text')}
  ELSE {one_shot_sql('p.idea_unit', 'p.segment_text', 'ex.ex_idea', 'ex.ex_note', 'ex.ex_label')} END AS prompt
FROM pairs p LEFT JOIN ex ON ex.topic = p.topic WHERE p.label IS NULL""", "pairs", extra=EXAMPLE_CTES))
def q_prompt_one_shot(spark, sf_dir):
    test = FX.pairs(spark, sf_dir, with_text=True).filter(F.col("label").isNull())
    j = PR.one_shot_join(test, _examples(spark, sf_dir))
    i, n = F.col("idea_unit"), F.col("segment_text")
    pr = F.when(F.col("ex_pos").isNull(), PM.zero_shot(i, n)).otherwise(
        PM.one_shot(i, n, F.col("ex_idea"), F.col("ex_note"), F.col("ex_label")))
    return j.select("pair_id", pr.alias("prompt"))


# ---------------------------------------------------------------- F-21 (cut the note, keep instructions and cue)
TRUNC_CTES = (
    f"tp0 AS (SELECT pair_id, idea_unit, segment_text, {zero_shot_sql('idea_unit', 'segment_text')} AS full_prompt, "
    f"{toks_sql(_strip('segment_text'))} AS note_toks FROM pairs)",
    f"tp1 AS (SELECT *, len({toks_sql('full_prompt')}) AS total FROM tp0)",
    "tp2 AS (SELECT *, greatest(1024 - (total - len(note_toks)), 0) AS budget, total > 1024 AS over FROM tp1)",
    f"tp AS (SELECT pair_id, over, total, CASE WHEN over THEN "
    f"{zero_shot_sql('idea_unit', 'array_to_string(note_toks[1 : budget], chr(32))')} ELSE full_prompt END AS prompt FROM tp2)",
)


@query("prompt_truncate", W(f"""
SELECT pair_id, prompt, CAST(CASE WHEN over THEN len({toks_sql('prompt')}) ELSE total END AS INTEGER) AS n_tokens,
  CAST(over AS INTEGER) AS truncated FROM tp""", "pairs", extra=TRUNC_CTES))
def q_prompt_truncate(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False)
    pr, n, over = PM.truncate_note(F.col("idea_unit"), F.col("segment_text"), 1024)
    return p.select("pair_id", pr.alias("prompt"), n.cast("int").alias("n_tokens"), over.cast("int").alias("truncated"))


# ---------------------------------------------------------------- F-23
ENC_CTES = (
    f"e0 AS (SELECT pair_id, {toks_sql('idea_unit')} AS ta, {toks_sql('segment_text')} AS tb FROM pairs)",
    "e1 AS (SELECT *, len(ta) AS la, len(tb) AS lb FROM e0)",
    "e2 AS (SELECT *, least(lb, greatest(253 - la, 126)) AS kb0 FROM e1)",
    "e3 AS (SELECT *, CASE WHEN la + lb <= 253 THEN la ELSE least(la, 253 - kb0) END AS ka, "
    "CASE WHEN la + lb <= 253 THEN lb ELSE kb0 END AS kb FROM e2)",
)


@query("pair_encoding", W("""
SELECT pair_id, CAST(ka AS INTEGER) AS n_idea_kept, CAST(kb AS INTEGER) AS n_note_kept, CAST(ka + kb + 3 AS INTEGER) AS n_real,
  array_to_string(['[CLS]'] || ta[1 : ka] || ['[SEP]'] || tb[1 : kb] || ['[SEP]'], ' ') AS tokens_text,
  rpad(repeat('1', CAST(ka + kb + 3 AS INTEGER)), 256, '0') AS mask,
  rpad(repeat('0', CAST(ka + 2 AS INTEGER)) || repeat('1', CAST(kb + 1 AS INTEGER)), 256, '0') AS types, 256 AS n_ids FROM e3""",
                          "pairs", extra=ENC_CTES))
def q_pair_encoding(spark, sf_dir):
    def carry(n):                     # each segment is tokenised once per note, each idea once
        return n.withColumn("_segs", F.array(*[F.struct(*PM.encoding_tokens(c, 256)) for c in FX.SEGMENTS]))
    n, toks = PM.encoding_tokens("idea_unit", 256)
    p = FX.pairs(spark, sf_dir, carry=carry, idea_carry=lambda i: i.withColumns({"_n": n, "_toks": toks}), labels=False)
    seg = F.element_at("_segs", F.col("segment"))
    e = PM.pair_encoding(p, max_length=256, idea_tokens=(F.col("_n"), F.col("_toks")), note_tokens=(seg["col1"], seg["col2"]))
    return e.select("pair_id", F.col("n_idea_kept").cast("int").alias("n_idea_kept"),
                    F.col("n_note_kept").cast("int").alias("n_note_kept"), F.col("n_real").cast("int").alias("n_real"),
                    "tokens_text", F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("mask"),
                    F.array_join(F.col("token_type_ids").cast("array<string>"), "").alias("types"),
                    F.size("input_ids").alias("n_ids"))


# ---------------------------------------------------------------- F-15, F-16
ARR = "TRY_CAST(z AS DOUBLE[])"


@query("softmax_label", W(f"""
SELECT id, round(exp(a[2] - list_max(a)) / (exp(a[1] - list_max(a)) + exp(a[2] - list_max(a))), 6) AS prob_1,
  CAST(list_position(a, list_max(a)) - 1 AS INTEGER) AS pred FROM (SELECT id, {ARR} AS a FROM logits) x""", "logits"))
def q_softmax_label(spark, sf_dir):
    lg = FX.logits(spark, sf_dir).select("id", SC.parse_logits("z").alias("a"))
    return r6(lg.select("id", F.element_at(SC.softmax("a"), 2).alias("prob_1"), SC.argmax("a").alias("pred")))


# ---------------------------------------------------------------- F-18
@query("parse_logits", W(f"""
SELECT id, CAST(len(a) AS INTEGER) AS n_classes,
  round(CASE WHEN len(a) > 1 THEN exp(a[2] - list_max(a)) / (exp(a[1] - list_max(a)) + exp(a[2] - list_max(a)))
             WHEN len(a) = 1 THEN 1.0 END, 6) AS score FROM (SELECT id, {ARR} AS a FROM logits) x""", "logits"))
def q_parse_logits(spark, sf_dir):
    lg = FX.logits(spark, sf_dir).select("id", SC.parse_logits("z").alias("a"))
    return r6(lg.select("id", F.size("a").alias("n_classes"), SC.positive_prob("a").alias("score"))
              .withColumn("n_classes", F.when(F.col("n_classes") >= 0, F.col("n_classes"))))


# ---------------------------------------------------------------- F-17, X-7 (threshold tuned on labelled pairs, applied to unlabelled)
HIST_SC = "h AS (" + S.histogram("scored") + ")"
BEST_SC_CTES = (
    HIST_SC,
    "g AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS score, 0 AS pos, 0 AS neg FROM range(1, 100) t(i))",
    "u AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM h UNION ALL SELECT * FROM g) x GROUP BY score)",
    "c AS (" + S.cumulative("u") + ")",
    "f AS (SELECT score AS threshold, CASE WHEN 2 * cum_pos + cum_neg + (P - cum_pos) > 0 "
    "THEN 2 * cum_pos / (2 * cum_pos + cum_neg + (P - cum_pos)) ELSE 0.0 END AS f1 FROM c)",
    "bt AS (SELECT threshold, f1 FROM (SELECT threshold, f1, 0 AS o FROM (SELECT * FROM f WHERE f1 > 0 "
    "ORDER BY f1 DESC, threshold ASC LIMIT 1) b UNION ALL SELECT 0.5, 0.0, 1) x ORDER BY o LIMIT 1)",
)
TEST_SCORE_CTE = (f"ts AS (SELECT p.pair_id, CASE WHEN len({S.overlap_set('p.idea_unit')}) = 0 THEN 0.0 ELSE "
                  f"len(list_intersect({S.overlap_set('p.idea_unit')}, {S.overlap_set('d.text')})) / "
                  f"len({S.overlap_set('p.idea_unit')}) END AS score FROM pairs p JOIN documents d ON d.doc_id = p.id "
                  "WHERE p.label IS NULL)")


def _test_scores(spark, sf_dir):
    from notecover.sources.tables import table
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.overlap_tokens("text").alias("ns"))
    p = FX.pairs(spark, sf_dir).filter(F.col("label").isNull()).select("pair_id", "id", T.overlap_tokens("idea_unit").alias("iset"))
    return p.join(d, "id").select("pair_id", T.overlap_of_sets(F.col("iset"), F.col("ns")).alias("score"))


@query("apply_threshold", W("""
SELECT ts.pair_id, round(bt.threshold, 6) AS threshold, CAST(ts.score >= bt.threshold AS INTEGER) AS prediction
FROM ts, bt""", "scored", extra=BEST_SC_CTES + (TEST_SCORE_CTE,)))
def q_apply_threshold(spark, sf_dir):
    t = C.best_threshold(FX.scored(spark, sf_dir), "y", "score").first()["threshold"]
    ts = _test_scores(spark, sf_dir)
    return r6(ts.select("pair_id", F.lit(float(t)).alias("threshold"), SC.apply_threshold("score", t).alias("prediction")))


# ---------------------------------------------------------------- X-3, F-22 with the shipped lexical scorer
OV_SQL = (f"CASE WHEN len({S.overlap_set('idea_unit')}) = 0 THEN 0.0 ELSE len(list_intersect({S.overlap_set('idea_unit')}, "
          f"{S.overlap_set('segment_text')})) / len({S.overlap_set('idea_unit')}) END")


def _batch(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False).select("pair_id", "idea_unit", F.col("segment_text").alias("note"))
    return SC.batch_score(p, SC.lexical_scorer_factory("idea_unit", "note", 0.2), "yes_logit double, no_logit double")


@query("batch_score", W(f"SELECT pair_id, round({OV_SQL}, 6) AS yes_logit, CAST(0.2 AS DOUBLE) AS no_logit FROM pairs", "pairs"))
def q_batch_score(spark, sf_dir):
    return r6(_batch(spark, sf_dir).select("pair_id", "yes_logit", "no_logit"))


# whole notes, in calls whose padded tokens stay within a budget
BUDGET = 4096
WHOLE_SQL = OV_SQL.replace("segment_text", "note")


@query("batch_budget", W(f"""
SELECT pair_id, n_tokens, round({WHOLE_SQL}, 6) AS yes_logit FROM (
  SELECT p.pair_id, p.idea_unit, nt.note, CAST(len({toks_sql('nt.note')}) AS INTEGER) AS n_tokens
  FROM pairs p JOIN (SELECT experiment, topic, id, {FULL_SQL} AS note FROM notes) nt USING (experiment, topic, id)) x""", "pairs"))
def q_batch_budget(spark, sf_dir):
    def carry(n):
        whole = n.withColumn("note", PR.full_text())
        return whole.withColumn("n_tokens", F.size(T.model_tokens("note")).cast("int"))
    p = FX.pairs(spark, sf_dir, carry=carry, labels=False).select("pair_id", "idea_unit", "note", "n_tokens")
    return r6(SC.batch_score(p, SC.lexical_scorer_factory("idea_unit", "note"), "yes_logit double, no_logit double",
                             keep=("pair_id", "n_tokens"), length="n_tokens", token_budget=BUDGET).drop("no_logit"))


@query("yes_no_label", W(f"SELECT pair_id, CAST({OV_SQL} > 0.2 AS INTEGER) AS pred_llm FROM pairs", "pairs"))
def q_yes_no_label(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False).select("pair_id", "idea_unit", F.col("segment_text").alias("note"))
    return SC.lexical_scores(p, "idea_unit", "note").select("pair_id", SC.yes_no_label().alias("pred_llm"))


# ---------------------------------------------------------------- A-3 (three-way labels, positive = 1)
@query("metrics_ovr", W(f"""
SELECT n, correct, tp, fp, fn, {S.metric_cols(correct='correct')} FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = pl) AS correct, count(*) FILTER (WHERE label = 1 AND pl = 1) AS tp,
    count(*) FILTER (WHERE label <> 1 AND pl = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pl <> 1) AS fn, 0 AS tn
  FROM (SELECT label, CASE WHEN jaccard > 0.6 THEN 1 WHEN jaccard > 0.59 THEN 0 ELSE -1 END AS pl FROM j) x) c""",
                        "answers", extra=(JACC_CTE,)))
def q_metrics_ovr(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    j = a.withColumn("pl", T.three_way_label(T.jaccard(T.strip_lower("response"), T.strip_lower("correct_answer"))))
    return r6(M.ovr_metrics(j, "label", "pl"))


# ---------------------------------------------------------------- X-5, A-20 (three seeds)
def _seed_cte(seed):
    return (f"SELECT {seed} AS seed, pair_id, y, score, prediction, row_number() OVER (ORDER BY md5('{seed}-' || "
            f"CAST(pair_id AS VARCHAR)), pair_id) <= floor(0.2 * count(*) OVER ()) AS is_val FROM scored")


RUN_METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def run_ctes(src: str, run: str, pred: str = "prediction") -> tuple[str, ...]:
    """The six metrics of every run of table ``src`` (run, y, score, decision): ``pm`` in wide and
    ``lm`` in long form."""
    return (
        f"rh AS (SELECT {run}, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {src} "
        f"WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)",
        f"rc AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, sum(pos) OVER (PARTITION BY {run}) AS P, "
        f"sum(neg) OVER (PARTITION BY {run}) AS N FROM rh WINDOW w AS (PARTITION BY {run} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
        f"rk AS (SELECT {run}, CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) END AS roc_auc, "
        f"CASE WHEN max(P) > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P) END AS pr_auc FROM rc GROUP BY {run})",
        f"pm AS (SELECT c.{run}, {S.metric_cols()}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc "
        f"FROM (SELECT {run}, {S.counters(p=pred)} FROM {src} GROUP BY {run}) c JOIN rk USING ({run}))",
        "lm AS (" + " UNION ALL ".join(f"SELECT {run}, '{m}' AS metric, {m} AS value FROM pm" for m in RUN_METRICS) + ")",
    )


SUMMARY_SQL = """SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min,
  round(max(value), 6) AS max, count(value) AS n FROM lm GROUP BY metric"""
SEED_CTES = ("sd0 AS (" + " UNION ALL ".join(_seed_cte(s) for s in FX.SEEDS) + ")",
             "sd AS (SELECT * FROM sd0 WHERE is_val)") + run_ctes("sd", "seed")


def run_summary(records, run: str = "seed"):
    """A-20 of the runs' six metrics; a run's metrics are reported at 6 digits before they are summarised."""
    return r6(M.seed_summary(M.unpivot_metrics(r6(records), [run], RUN_METRICS)))


@query("seed_summary", W(SUMMARY_SQL, "scored", extra=SEED_CTES))
def q_seed_summary(spark, sf_dir):
    s = FX.scored(spark, sf_dir).select("pair_id", "y", "score", "prediction")
    runs = SP.seed_runs(s, FX.SEEDS, 0.2, "pair_id").filter(F.col("split") == "val")
    from notecover.operators import record as R
    return run_summary(R.run_records(runs, ["seed"], "y", "score", "prediction"))


# ---------------------------------------------------------------- A-22 (threshold decision)
def _record_sql(decision: str, pred: str) -> str:
    return f"""SELECT '{decision}' AS decision, n_eval, {S.metric_cols('n_eval')}, round(roc_auc, 6) AS roc_auc,
  round(pr_auc, 6) AS pr_auc, round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6)
  AS balanced_accuracy, round(threshold, 6) AS threshold FROM (
  SELECT count(*) AS n_eval, count(*) FILTER (WHERE y = 1 AND {pred}) AS tp, count(*) FILTER (WHERE y <> 1 AND {pred}) AS fp,
    count(*) FILTER (WHERE y = 1 AND NOT ({pred})) AS fn, count(*) FILTER (WHERE y <> 1 AND NOT ({pred})) AS tn,
    max(t) AS threshold,
    (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) END FROM c2) AS roc_auc,
    (SELECT CASE WHEN max(P) > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P) END FROM c2) AS pr_auc
  FROM scored, (SELECT threshold AS t FROM bt) tt) a"""


@query("metric_record", W(_record_sql("model", "prediction = 1") + "\nUNION ALL\n" + _record_sql("threshold", "score >= t"),
                          "scored", extra=BEST_SC_CTES + ("c2 AS (" + S.cumulative("h") + ")",)))
def q_metric_record(spark, sf_dir):
    """A-22 with both decisions (B.6): the model's own labels ('model', the argmax analogue)
    and the tuned threshold ('threshold'); ranking metrics are shared."""
    from notecover.operators import record as R
    return r6(R.metric_record(FX.scored(spark, sf_dir), "y", "score", model_pred="prediction"))


# ---------------------------------------------------------------- PF-17, PF-21, S-1 ... S-5
EX_CTE = ("exm AS (SELECT s.pair_id, CAST(s.y AS INTEGER) AS true_label, CAST(s.prediction AS INTEGER) AS pred_label, "
          "s.score AS pred_prob_pos, p.idea_unit AS text_1, p.segment_text AS text_2, s.id AS ID, s.segment AS Segment, "
          "s.y = s.prediction AS correct FROM scored s JOIN pairs p USING (pair_id))")
EX_COLS = "pair_id, true_label, pred_label, round(pred_prob_pos, 6) AS pred_prob_pos, text_1, text_2, ID, Segment, correct"


def _examples_table(spark, sf_dir):
    s = FX.scored(spark, sf_dir)
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False).select("pair_id", "idea_unit", "segment_text")
    return ER.eval_examples(s.join(p, "pair_id"), "y", "prediction", "score", "idea_unit", "segment_text", "id",
                            "segment", keep=("pair_id",))


def _examples_slim(spark, sf_dir):
    """The examples table without its texts: what ranking needs."""
    s = FX.scored(spark, sf_dir).withColumn("_t", F.lit(""))
    return ER.eval_examples(s, "y", "prediction", "score", "_t", "_t", "id", "segment", keep=("pair_id",)).drop("text_1", "text_2")


def _fetch_text(spark, sf_dir, top):
    """Texts for the at most k ranked rows: the few rows are broadcast, the pairs are not shuffled."""
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False).select("pair_id", F.col("idea_unit").alias("text_1"), F.col("segment_text").alias("text_2"))
    return p.join(F.broadcast(top), "pair_id").select("pair_id", "true_label", "pred_label", "pred_prob_pos", "text_1", "text_2",
                                                      "ID", "Segment", "correct")


@query("eval_examples", W(f"SELECT {EX_COLS} FROM exm", "scored", "pairs", extra=(EX_CTE,)))
def q_eval_examples(spark, sf_dir):
    return r6(_examples_table(spark, sf_dir))


@query("top_fp", W(f"""
SELECT {EX_COLS} FROM exm WHERE true_label = 0 AND pred_label = 1 ORDER BY pred_prob_pos DESC, pair_id LIMIT 50""",
                   "scored", "pairs", extra=(EX_CTE,)))
def q_top_fp(spark, sf_dir):
    return r6(_fetch_text(spark, sf_dir, ER.top_false_positives(_examples_slim(spark, sf_dir), 50, "pair_id")))


@query("top_fn", W(f"""
SELECT {EX_COLS} FROM exm WHERE true_label = 1 AND pred_label = 0 ORDER BY pred_prob_pos ASC, pair_id LIMIT 50""",
                   "scored", "pairs", extra=(EX_CTE,)))
def q_top_fn(spark, sf_dir):
    return r6(_fetch_text(spark, sf_dir, ER.top_false_negatives(_examples_slim(spark, sf_dir), 50, "pair_id")))


@query("random_errors", W(f"""
SELECT {EX_COLS} FROM exm WHERE true_label = 1 AND pred_label = 0
ORDER BY md5('42-' || CAST(pair_id AS VARCHAR)), pair_id LIMIT 50""", "scored", "pairs", extra=(EX_CTE,)))
def q_random_errors(spark, sf_dir):
    return r6(_fetch_text(spark, sf_dir, ER.random_errors(_examples_slim(spark, sf_dir), "fn", 50, 42, "pair_id")))


@query("first_examples", W(f"SELECT {EX_COLS} FROM exm ORDER BY pair_id LIMIT 20", "scored", "pairs", extra=(EX_CTE,)))
def q_first_examples(spark, sf_dir):
    return r6(_fetch_text(spark, sf_dir, ER.first_examples(_examples_slim(spark, sf_dir), 20, "pair_id")))

"""Registered evaluation queries: metrics (A-*), curves, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.operators import curves as C
from notecover.operators import metrics as M
from notecover.plans import sqlparts as S
from notecover.plans.registry import query, r6
from notecover.sources import fixtures as FX
from notecover.sources.fixtures import with_fixtures as W

# ---------------------------------------------------------------- A-13, A-14, J-6, S-1
SQL_BY_TOPIC = W(f"""
SELECT experiment, topic, n, {S.metric_cols()}, round(pos_prevalence, 6) AS pos_prevalence
FROM (SELECT experiment, topic, {S.counters()}, avg(CAST(y AS DOUBLE)) AS pos_prevalence
      FROM scored WHERE experiment IS NOT NULL AND topic IS NOT NULL GROUP BY experiment, topic) g
ORDER BY experiment, topic, n DESC""", "scored")


@query("metrics_by_topic", SQL_BY_TOPIC)
def q_metrics_by_topic(spark, sf_dir):
    s = FX.scored(spark, sf_dir)
    out = M.metrics_by_group(s, "y", "prediction", ("experiment", "topic"))
    return r6(out.drop("tp", "fp", "fn", "tn") if "tp" in out.columns else out) \
        .orderBy("experiment", "topic", F.col("n").desc())


# ---------------------------------------------------------------- A-1, A-2
@query("metrics_overall", W(f"""
SELECT n, tp, fp, fn, tn, {S.metric_cols()} FROM (SELECT {S.counters()} FROM scored) c""", "scored"))
def q_metrics_overall(spark, sf_dir):
    return r6(M.binary_metrics(FX.scored(spark, sf_dir)))


# ---------------------------------------------------------------- A-4
@query("confusion", W("""
SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT a.v AS y_true, b.v AS y_pred FROM (VALUES (0), (1)) a(v), (VALUES (0), (1)) b(v)) g
LEFT JOIN (SELECT y AS y_true, prediction AS y_pred, count(*) AS n FROM scored GROUP BY ALL) c
  USING (y_true, y_pred)""", "scored"))
def q_confusion(spark, sf_dir):
    return M.confusion_long(FX.scored(spark, sf_dir), "y", "prediction", labels=(0, 1))


# ---------------------------------------------------------------- A-5 (multi-class)
CR_CTES = (
    "cells AS (SELECT y AS t, y_pred AS p, count(*) AS n FROM multiclass GROUP BY ALL)",
    "ts AS (SELECT t AS cls, sum(n) AS support, sum(CASE WHEN t = p THEN n ELSE 0 END) AS tp FROM cells GROUP BY t)",
    "ps AS (SELECT p AS cls, sum(n) AS pred_n FROM cells GROUP BY p)",
    """per AS (SELECT coalesce(ts.cls, ps.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
               coalesce(pred_n, 0) AS pred_n FROM ts FULL JOIN ps ON ts.cls = ps.cls)""",
    """m AS (SELECT CAST(cls AS VARCHAR) AS class,
        CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
        CASE WHEN support + pred_n > 0 THEN 2 * tp / (support + pred_n) ELSE 0.0 END AS f1, support, tp FROM per)""")


@query("classification_report", W("""
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
                 CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
                 round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
                 CAST(sum(support) AS BIGINT) FROM m""", "multiclass", extra=CR_CTES))
def q_classification_report(spark, sf_dir):
    return r6(M.classification_report(FX.multiclass(spark, sf_dir), "y", "y_pred"))


# ---------------------------------------------------------------- A-6
@query("balanced_accuracy", W(f"""
SELECT n, tp, fp, fn, tn,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy
FROM (SELECT {S.counters()} FROM scored) c""", "scored"))
def q_balanced_accuracy(spark, sf_dir):
    return r6(M.balanced_accuracy(FX.scored(spark, sf_dir)))


# ---------------------------------------------------------------- A-15
@query("class_balance", W("""
SELECT pos, neg, n, round(CASE WHEN n > 0 THEN pos / n ELSE 0.0 END, 6) AS prevalence FROM (
  SELECT count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg, count(*) AS n
  FROM pairs WHERE label IS NOT NULL) c""", "pairs"))
def q_class_balance(spark, sf_dir):
    return r6(M.class_balance(FX.pairs(spark, sf_dir).filter(F.col("label").isNotNull()), "label"))


# ---------------------------------------------------------------- A-16
@query("value_counts", W("""
SELECT label AS value, count(*) AS n FROM pairs GROUP BY label""", "pairs"))
def q_value_counts(spark, sf_dir):
    return M.value_counts(FX.pairs(spark, sf_dir), "label")


# ---------------------------------------------------------------- A-21
@query("text_lengths", W("""
SELECT 'idea_unit' AS "column", round(avg(length(idea_unit)), 6) AS mean_length FROM pairs
UNION ALL SELECT 'segment_text', round(avg(length(segment_text)), 6) FROM pairs""", "pairs"))
def q_text_lengths(spark, sf_dir):
    return r6(M.text_lengths(FX.pairs(spark, sf_dir, with_text=True, labels=False), ["idea_unit", "segment_text"]))


# ---------------------------------------------------------------- A-7
HIST_BIG = "h AS (" + S.histogram("scored_big") + ")"
CUM_BIG = "c AS (" + S.cumulative("h") + ")"


@query("roc_auc", W("""
SELECT round(CASE WHEN max(P) > 0 AND max(N) > 0
  THEN sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) END, 6) AS roc_auc FROM c""",
                    "scored_big", extra=(HIST_BIG, CUM_BIG)))
def q_roc_auc(spark, sf_dir):
    return r6(C.roc_auc(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-8
@query("average_precision", W("""
SELECT round(CASE WHEN max(P) > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P) END, 6)
  AS average_precision FROM c""", "scored_big", extra=(HIST_BIG, CUM_BIG)))
def q_average_precision(spark, sf_dir):
    return r6(C.average_precision(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-9
@query("pr_auc_trapezoid", W("""
SELECT round(CASE WHEN max(P) > 0 THEN sum((cum_pos / P - (cum_pos - pos) / P)
  * (cum_pos / (cum_pos + cum_neg)
     + CASE WHEN cum_pos - pos + cum_neg - neg > 0 THEN (cum_pos - pos) / (cum_pos - pos + cum_neg - neg)
            ELSE 1.0 END) / 2) END, 6) AS pr_auc FROM c""", "scored_big", extra=(HIST_BIG, CUM_BIG)))
def q_pr_auc(spark, sf_dir):
    return r6(C.pr_auc_trapezoid(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-10
@query("pr_curve", W("""
SELECT round(score, 6) AS threshold, round(cum_pos / (cum_pos + cum_neg), 6) AS precision,
       round(CASE WHEN P > 0 THEN cum_pos / P ELSE 1.0 END, 6) AS recall FROM c
UNION ALL SELECT NULL, 1.0, 0.0""", "scored_big", extra=(HIST_BIG, CUM_BIG)))
def q_pr_curve(spark, sf_dir):
    return r6(C.pr_curve(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-11
@query("roc_curve", W("""
SELECT round(score, 6) AS threshold, round(CASE WHEN N > 0 THEN cum_neg / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN cum_pos / P END, 6) AS tpr FROM c
UNION ALL SELECT NULL, 0.0, 0.0""", "scored_big", extra=(HIST_BIG, CUM_BIG)))
def q_roc_curve(spark, sf_dir):
    return r6(C.roc_curve(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-12
@query("score_histogram20", W("""
SELECT g.bin, round(mn + g.bin * ((mx - mn) / 20), 6) AS lo, round(mn + (g.bin + 1) * ((mx - mn) / 20), 6) AS hi,
       CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g
CROSS JOIN m2
LEFT JOIN (SELECT CAST(least(floor((score - mn) * 20 / (mx - mn)), 19) AS INTEGER) AS bin, count(*) AS n
           FROM scored_fine, m2 WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1) cnt USING (bin)""",
                              "scored_fine", extra=(
    "mm AS (SELECT min(score) AS mn0, max(score) AS mx0 FROM scored_fine "
    "WHERE score IS NOT NULL AND NOT isnan(score))",
    "m2 AS (SELECT CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn, "
    "CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx FROM mm)")))
def q_score_histogram(spark, sf_dir):
    return r6(C.score_histogram(FX.scored_fine(spark, sf_dir), "score", 20))


# ---------------------------------------------------------------- A-18, U-2
@query("best_threshold", W("""
SELECT threshold, f1 FROM (
  SELECT round(threshold, 6) AS threshold, round(f1, 6) AS f1, 0 AS o FROM (
    SELECT * FROM f WHERE f1 > 0 ORDER BY f1 DESC, threshold ASC LIMIT 1) b
  UNION ALL SELECT 0.5, 0.0, 1) x ORDER BY o LIMIT 1""", "scored_big", extra=(
    HIST_BIG,
    "g AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS score, 0 AS pos, 0 AS neg FROM range(1, 100) t(i))",
    "u AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM h UNION ALL SELECT * FROM g) x GROUP BY score)",
    "c AS (" + S.cumulative("u") + ")",
    "f AS (SELECT score AS threshold, CASE WHEN 2 * cum_pos + cum_neg + (P - cum_pos) > 0 "
    "THEN 2 * cum_pos / (2 * cum_pos + cum_neg + (P - cum_pos)) ELSE 0.0 END AS f1 FROM c)")))
def q_best_threshold(spark, sf_dir):
    return r6(C.best_threshold(FX.scored_big(spark, sf_dir)))


# ---------------------------------------------------------------- A-13 overall + per group in one pass
@query("metrics_with_overall", W(f"""
SELECT experiment, topic, is_overall, n, {S.metric_cols()}, round(pos_prevalence, 6) AS pos_prevalence
FROM (SELECT experiment, topic, grouping(experiment, topic) <> 0 AS is_overall, {S.counters()},
             avg(CAST(y AS DOUBLE)) AS pos_prevalence
      FROM scored WHERE experiment IS NOT NULL AND topic IS NOT NULL
      GROUP BY GROUPING SETS ((), (experiment, topic))) g""", "scored"))
def q_metrics_with_overall(spark, sf_dir):
    return r6(M.metrics_with_overall(FX.scored(spark, sf_dir), "y", "prediction", ("experiment", "topic")))


# ---------------------------------------------------------------- A-4 with the observed label set (multi-class)
@query("confusion_observed", W("""
SELECT g.y_true, g.y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM (SELECT a.v AS y_true, b.v AS y_pred FROM labs a, labs b) g
LEFT JOIN (SELECT y AS y_true, y_pred, count(*) AS n FROM multiclass GROUP BY ALL) c USING (y_true, y_pred)""",
                               "multiclass", extra=(
    "labs AS (SELECT DISTINCT v FROM (SELECT y AS v FROM multiclass UNION ALL SELECT y_pred FROM multiclass) u "
    "WHERE v IS NOT NULL)",)))
def q_confusion_observed(spark, sf_dir):
    return M.confusion_long(FX.multiclass(spark, sf_dir), "y", "y_pred", labels=None)

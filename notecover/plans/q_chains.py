"""The reference's end-to-end chains (P-3 ... P-6) and the trained pair classifier (X-4, X-6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators import align as AL
from notecover.operators import clean as CL
from notecover.operators import curves as C
from notecover.operators import errors as ER
from notecover.operators import logistic as LG
from notecover.operators import metrics as M
from notecover.operators import pairs as PR
from notecover.operators import prompt as PM
from notecover.operators import record as R
from notecover.operators import score as SC
from notecover.operators import split as SP
from notecover.plans import sqlparts as S
from notecover.plans.q_model import SPAN_CTES, SUMMARY_SQL, _spans, one_shot_sql, run_ctes, run_summary, toks_sql, zero_shot_sql
from notecover.plans.q_prep import EXAMPLE_CTES, RANDOM_CTE, _coerced_sql, _examples, _raw_train, int_sql, num_sql, strip_sql
from notecover.plans.registry import query, r6
from notecover.session import cut_lineage
from notecover.sources import fixtures as FX
from notecover.sources.fixtures import with_fixtures as W


def best_ctes(src: str, px: str) -> tuple[str, ...]:
    """Best-F1 threshold (A-18) over table ``src`` (y, score) as CTEs prefixed ``px``."""
    return (
        f"{px}h AS (" + S.histogram(src) + ")",
        f"{px}g AS (SELECT CAST(i AS DOUBLE) / CAST(100 AS DOUBLE) AS score, 0 AS pos, 0 AS neg FROM range(1, 100) t(i))",
        f"{px}u AS (SELECT score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM {px}h UNION ALL "
        f"SELECT * FROM {px}g) x GROUP BY score)",
        f"{px}c AS (" + S.cumulative(f"{px}u") + ")",
        f"{px}f AS (SELECT score AS threshold, CASE WHEN 2 * cum_pos + cum_neg + (P - cum_pos) > 0 "
        f"THEN 2 * cum_pos / (2 * cum_pos + cum_neg + (P - cum_pos)) ELSE 0.0 END AS f1 FROM {px}c)",
        f"{px}bt AS (SELECT threshold, f1 FROM (SELECT threshold, f1, 0 AS o FROM (SELECT * FROM {px}f WHERE f1 > 0 "
        f"ORDER BY f1 DESC, threshold ASC LIMIT 1) b UNION ALL SELECT 0.5, 0.0, 1) x ORDER BY o LIMIT 1)",
        f"{px}hc AS (" + S.cumulative(f"{px}h") + ")",
    )


def record_sql(src: str, px: str, decision: str = "threshold", pred: str = "score >= t") -> str:
    """A-22 record of table ``src`` (y, score) at the threshold of ``{px}bt``; ``pred`` is the decision."""
    return f"""SELECT '{decision}' AS decision, n_eval, {S.metric_cols('n_eval')}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
  round(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy,
  round(threshold, 6) AS threshold FROM (
  SELECT count(*) AS n_eval, count(*) FILTER (WHERE y = 1 AND {pred}) AS tp, count(*) FILTER (WHERE y <> 1 AND {pred}) AS fp,
    count(*) FILTER (WHERE y = 1 AND NOT ({pred})) AS fn, count(*) FILTER (WHERE y <> 1 AND NOT ({pred})) AS tn, max(t) AS threshold,
    (SELECT CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) END FROM {px}hc) AS roc_auc,
    (SELECT CASE WHEN max(P) > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P) END FROM {px}hc) AS pr_auc
  FROM {src}, (SELECT threshold AS t FROM {px}bt) tt) a"""


def metric_record(df, y="y", score="score", model_pred=None):
    return R.metric_record(df, y, score, model_pred)


# ---------------------------------------------------------------- X-4: features and Newton's method in SQL
def _ratio_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN {num} / {den} ELSE 0.0 END"


PF_CTES = (
    f"pf0 AS (SELECT pair_id, label, split, idea_unit, note_text, {S.strip_lower('idea_unit')} AS a, "
    f"{S.strip_lower('note_text')} AS b FROM sp LEFT JOIN rs USING (pair_id))",
    f"pf1 AS (SELECT *, list_distinct({S.ws_tokens('a')}) AS ja, list_distinct({S.ws_tokens('b')}) AS jb, "
    f"{S.token_sort('a')} AS sa, {S.token_sort('b')} AS sb, {S.overlap_set('idea_unit')} AS oa, {S.overlap_set('note_text')} AS ob, "
    f"regexp_extract_all(a, '\\p{{Nd}}+') AS na, regexp_extract_all(b, '\\p{{Nd}}+') AS nb, "
    f"list_distinct(regexp_extract_all(a, '{T.WORD}')) AS wa, list_distinct(regexp_extract_all(b, '{T.WORD}')) AS wb, "
    f"list_histogram(regexp_extract_all(lower(a), '{T.TOK2}')) AS ha, list_histogram(regexp_extract_all(lower(b), '{T.TOK2}')) AS hb FROM pf0)",
    "pf2 AS (SELECT *, list_sum(list_transform(map_keys(ha), lambda k: ha[k] * coalesce(hb[k], 0))) AS dot, "
    "list_sum(list_transform(map_values(ha), lambda x: x * x)) * list_sum(list_transform(map_values(hb), lambda x: x * x)) AS nn FROM pf1)",
    "pf AS (SELECT pair_id, label, split, "
    "CASE WHEN len(ja) = 0 OR len(jb) = 0 THEN 0.0 ELSE len(list_intersect(ja, jb)) / len(list_distinct(list_concat(ja, jb))) END AS f_jaccard, "
    f"{S.levenshtein_ratio('sa', 'sb')} AS f_levenshtein, {_ratio_sql('len(list_intersect(oa, ob))', 'len(oa)')} AS f_overlap, "
    f"CAST(len(na) > 0 AND na = nb AS DOUBLE) AS f_number, {_ratio_sql('len(list_intersect(wa, wb))', 'len(wa)')} AS f_cover, "
    "CASE WHEN nn > 0 THEN dot / sqrt(nn) ELSE 0.0 END AS f_cosine FROM pf2)",
)
FEATURE_CTES = SPAN_CTES + (RANDOM_CTE,) + PF_CTES


def fit_ctes(src: str, run: str, regs: dict, rounds: int = LG.ROUNDS) -> tuple[str, ...]:
    """Table ``lg`` ({run}, reg, k, w): coefficients of each run after k Newton rounds over ``src``
    ({run}, label, features). A round is an aggregate over the rows; its linear system is
    solved by elimination over the lists of its sums."""
    d = len(SC.FEATURES) + 1
    x = ["CAST(1 AS DOUBLE)", *SC.FEATURES]
    hess = ", ".join("[" + ", ".join([f"h{min(i, j)}_{max(i, j)} / n" + (" + reg" if i == j and i else "") for j in range(d)]
                                     + [f"g{i} / n" + (f" + reg * w[{i + 1}]" if i else "")]) + "]" for i in range(d))
    sums = ", ".join([f"sum((p - label) * {x[i]}) AS g{i}" for i in range(d)]
                     + [f"sum(p * (1 - p) * {x[i]} * {x[j]}) AS h{i}_{j}" for i in range(d) for j in range(i, d)])
    solved = (f"list_reduce({list(range(1, d + 1))}, lambda m, k: list_transform(m, lambda r, i: CASE WHEN i = k "
              f"THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] / m[k][k] * m[k][j]) END), [{hess}])")
    start = ", ".join(f"({k}, CAST({r} AS DOUBLE), 0, CAST({[0.0] * d} AS DOUBLE[]))" for k, r in regs.items())
    return (
        f"lgt AS MATERIALIZED (SELECT {run}, label, {', '.join(SC.FEATURES)} FROM {src})",
        f"lg({run}, reg, k, w) AS (SELECT * FROM (VALUES {start}) v UNION ALL "
        f"SELECT {run}, reg, k + 1, list_transform(w, lambda c, i: c - {solved}[i][{d + 1}]) FROM ("
        f"SELECT {run}, reg, k, w, count(*) AS n, {sums} FROM (SELECT lg.{run}, reg, k, w, lgt.* EXCLUDE ({run}), {prob_sql()} AS p "
        f"FROM lg JOIN lgt ON lgt.{run} = lg.{run} WHERE k < {rounds}) a GROUP BY {run}, reg, k, w) s)",
    )


def prob_sql(w: str = "w") -> str:
    return f"1 / (1 + exp(-({w}[1]" + "".join(f" + {w}[{i + 2}] * {f}" for i, f in enumerate(SC.FEATURES)) + ")))"


def run_best_ctes(src: str, run: str) -> tuple[str, ...]:
    """``rb``: the best-F1 threshold (A-18) of each run of ``src`` ({run}, y, score)."""
    return (
        f"rbh AS (SELECT {run}, score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM {src} GROUP BY ALL)",
        f"rbu AS (SELECT {run}, score, sum(pos) AS pos, sum(neg) AS neg FROM (SELECT * FROM rbh UNION ALL SELECT r.{run}, "
        f"CAST(i AS DOUBLE) / CAST(100 AS DOUBLE), 0, 0 FROM (SELECT DISTINCT {run} FROM rbh) r, range(1, 100) t(i)) x GROUP BY ALL)",
        f"rbc AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {run}) - sum(pos) OVER w AS fn FROM rbu "
        f"WINDOW w AS (PARTITION BY {run} ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
        "rbf AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM rbc)",
        f"rb AS (SELECT {run}, CASE WHEN f1 > 0 THEN score ELSE 0.5 END AS threshold, f1 FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY {run} ORDER BY f1 DESC, score) AS i FROM rbf) x WHERE i = 1)",
    )


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def best_of(key: str) -> str:
    """Rows of ``rb`` with the best one marked."""
    return (f"SELECT {key}, round(threshold, 6) AS threshold, round(f1, 6) AS f1, "
            f"CAST(row_number() OVER (ORDER BY round(f1, 6) DESC, {key}) = 1 AS INTEGER) AS best FROM rb")


# ---------------------------------------------------------------- P-3 aligned chain, from dirty tables to test predictions
RECORD = ("n_eval", "accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "balanced_accuracy", "threshold")


def _on_clean(cte: str) -> str:
    """A CTE over the fixture tables, moved to the cleaned tables of the chain."""
    return cte.replace("FROM pairs", "FROM apairs").replace("FROM notes", "FROM anotes")


ALIGNED_CTES = (
    f"anotes AS (SELECT coalesce({strip_sql('experiment_raw')}, 'UNK') AS experiment, {strip_sql('topic_raw')} AS topic, "
    f"{int_sql(num_sql('id_raw'))} AS id, segment1_notes, segment2_notes, segment3_notes, segment4_notes FROM raw_notes "
    f"WHERE {strip_sql('topic_raw')} IS NOT NULL AND {num_sql('id_raw')} IS NOT NULL)",
    f"atr AS ({_coerced_sql(True)})",
    f"ats AS (SELECT * FROM ({_coerced_sql(False)}) c WHERE label IS NULL)",
    "apairs AS (SELECT t.pair_id, coalesce(m.experiment, 'UNK') AS experiment, t.topic, t.id, t.segment, t.idea_unit, t.label "
    "FROM atr t LEFT JOIN (SELECT topic, id, arg_min(experiment, id) AS experiment FROM anotes GROUP BY topic, id) m "
    "ON m.topic = t.topic AND m.id = t.id UNION ALL SELECT pair_id, experiment, topic, id, segment, idea_unit, label FROM ats)",
) + tuple(_on_clean(c) for c in SPAN_CTES + (RANDOM_CTE,)) + PF_CTES + (
    "lf AS (SELECT 0 AS run, * FROM pf WHERE label IS NOT NULL AND split = 'train')",
) + fit_ctes("lf", "run", {0: LG.REG}) + (
    f"asc0 AS (SELECT pf.pair_id, a.experiment, a.topic, pf.label AS y, pf.split, round({prob_sql()}, 6) AS score FROM pf "
    f"JOIN (SELECT pair_id, experiment, topic FROM apairs) a USING (pair_id), (SELECT w FROM lg WHERE k = {LG.ROUNDS}) l)",
    "aval AS (SELECT * FROM asc0 WHERE y IS NOT NULL AND split = 'val')",
) + best_ctes("aval", "v") + (
    "ath AS (SELECT a.*, CAST(score >= threshold AS INTEGER) AS pred FROM aval a, vbt)",
) + S.report_ctes("ath", "y", "pred", "a")
ALIGNED_SQL = S.long_union(
    [S.long_rows("record", f"({record_sql('aval', 'v', d, c)}) r", {k: k for k in RECORD}, "decision")
     for d, c in (("model", "score > 0.5"), ("threshold", "score >= t"))]
    + S.evaluation_rows("ath", "y", "pred", "a", "ath", ("experiment", "topic"))
    + [S.long_rows("test", "(SELECT count(*) AS n, count(*) FILTER (WHERE score >= threshold) AS n_positive "
                   "FROM asc0, vbt WHERE y IS NULL) t", {"n": "n", "n_positive": "n_positive"})])


def _clean_pairs(spark, sf_dir):
    """Cleaned train (with the experiment of its note) and test pairs, and cleaned notes."""
    raw = _raw_train(spark, sf_dir)
    notes = FX.raw_notes(spark, sf_dir).withColumnsRenamed(
        {"experiment_raw": "experiment", "topic_raw": "topic", "id_raw": "id"})
    notes = CL.coerce_notes(notes)                                       # PF-3
    cols = ("pair_id", "experiment", "topic", "id", "segment", "idea_unit", "label")
    train = CL.coerce_pairs(raw, labelled=True)                          # PF-4, PF-6
    train = PR.attach_experiment(train, notes, ("id",)).select(*cols)    # J-1
    test = CL.coerce_pairs(raw, labelled=False).filter(F.col("label").isNull()).select(*cols)     # PF-5
    return train.unionByName(test), notes


def _span_features(spark, sf_dir):
    """Every pair's aligned span as features; texts end here."""
    pairs, notes = _clean_pairs(spark, sf_dir)
    order = AL.idea_order(pairs.withColumn("_src", F.col("label").isNull().cast("int")),
                          order_col="pair_id", source_col="_src")        # W-1
    j = AL.idea_position(pairs, order)                                   # J-4, before any text is attached
    j = PR.full_notes(j, notes, tokens_col="_toks_note")                 # J-3
    spans = AL.aligned_span(j, tokens_col="_toks_note", idea_tokens_col="n_idea_tokens")     # F-10 ... F-14
    return SC.pair_features(spans, "idea_unit", "note_text").select("pair_id", "experiment", "topic", F.col("label").alias("y"),
                                                                    *SC.FEATURES)


@query("aligned_chain", recursive(W(ALIGNED_SQL, "raw_train", "raw_notes", extra=ALIGNED_CTES)))
def q_aligned_chain(spark, sf_dir):
    f = cut_lineage(_span_features(spark, sf_dir))       # read by the fit, the tuning, the evaluation and the test predictions
    known = SP.random_split(f.filter(F.col("y").isNotNull()), 42, 0.2, "pair_id", cache_keys=False)       # W-5
    path = SC.train_pair_classifier(known.filter(F.col("split") == "train"), "y")                         # X-4
    val = SC.predict_pairs(known.filter(F.col("split") == "val"), path).withColumnRenamed("prob_1", "score")     # X-3
    record = metric_record(val, model_pred="pred_argmax")                # F-16, A-18, A-22
    t = record.filter("decision = 'threshold'").first()["threshold"]
    at_t = val.withColumn("pred", SC.apply_threshold("score", t))        # F-17
    test = SC.predict_pairs(f.filter(F.col("y").isNull()), path)
    test = test.select(SC.apply_threshold("prob_1", t).alias("pred"))    # X-7
    test = test.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == 1).alias("n_positive"))
    return r6(R.long_rows(record, "record", RECORD, F.col("decision"))
              .unionByName(R.evaluation(at_t, "y", "pred", ("experiment", "topic")))        # A-1 ... A-6, A-13, A-14
              .unionByName(R.long_rows(test, "test", ["n", "n_positive"])))


# ---------------------------------------------------------------- P-4 error analysis of a prediction file
def _prediction_file(spark, sf_dir):
    """A prediction table with text-typed columns, like a CSV read: label, prediction, logits."""
    lg = FX.logits(spark, sf_dir).withColumn("_a", SC.parse_logits("z"))
    return lg.select("id", F.col("y").cast("string").alias("label"),
                     F.when(F.col("_a").isNotNull(), SC.argmax("_a").cast("string")).alias("prediction"),
                     F.col("z").alias("logits"))


EA_CTES = (
    "ea0 AS (SELECT id, y, CASE WHEN TRY_CAST(z AS DOUBLE[]) IS NULL THEN NULL ELSE "
    "list_position(TRY_CAST(z AS DOUBLE[]), list_max(TRY_CAST(z AS DOUBLE[]))) - 1 END AS prediction, "
    "TRY_CAST(z AS DOUBLE[]) AS a FROM logits)",
    "ea AS (SELECT id, y, prediction, exp(a[2] - list_max(a)) / (exp(a[1] - list_max(a)) + exp(a[2] - list_max(a))) AS score "
    "FROM ea0 WHERE y IS NOT NULL AND prediction IS NOT NULL)",
    "eah AS (" + S.histogram("ea") + ")",
    "eac AS (" + S.cumulative("eah") + ")",
    "eam AS (SELECT min(score) AS mn, max(score) AS mx FROM ea)",
    "eab AS (SELECT CAST(least(floor((score - mn) * 20 / (mx - mn)), 19) AS INTEGER) AS bin, count(*) AS n FROM ea, eam GROUP BY 1)",
) + S.report_ctes("ea", "y", "prediction", "e")
AT = "CAST(CAST(round(score * 1000000) AS BIGINT) AS VARCHAR)"        # a score as a key


def _top_sql(section: str, cond: str, order: str) -> str:
    return S.long_rows(section, f"(SELECT id, score FROM ea WHERE {cond} ORDER BY score {order}, id LIMIT 50) t",
                       {"score": "score"}, "CAST(id AS VARCHAR)")


ERROR_SQL = S.long_union(
    S.evaluation_rows("ea", "y", "prediction", "e", "ea0")
    + [S.long_rows("ranking", """(SELECT
         CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - cum_neg + neg / 2)) / (max(P) * max(N)) END AS roc_auc,
         CASE WHEN max(P) > 0 THEN sum(pos * (cum_pos / (cum_pos + cum_neg))) / max(P) END AS average_precision,
         CASE WHEN max(P) > 0 THEN sum((cum_pos / P - (cum_pos - pos) / P) * (cum_pos / (cum_pos + cum_neg)
           + CASE WHEN cum_pos - pos + cum_neg - neg > 0 THEN (cum_pos - pos) / (cum_pos - pos + cum_neg - neg)
                  ELSE 1.0 END) / 2) END AS pr_auc FROM eac) r""", {k: k for k in ("roc_auc", "average_precision", "pr_auc")}),
       S.long_rows("pr_curve", "eac", {"precision": "cum_pos / (cum_pos + cum_neg)",
                                       "recall": "CASE WHEN P > 0 THEN cum_pos / P ELSE 1.0 END"}, AT),
       S.long_rows("roc_curve", "eac", {"fpr": "CASE WHEN N > 0 THEN cum_neg / N END", "tpr": "CASE WHEN P > 0 THEN cum_pos / P END"}, AT),
       S.long_rows("histogram", "(SELECT range AS bin, mn + range * ((mx - mn) / 20) AS lo, mn + (range + 1) * ((mx - mn) / 20) AS hi, "
                   "coalesce(n, 0) AS n FROM range(20) CROSS JOIN eam LEFT JOIN eab ON bin = range) h",
                   {k: k for k in ("lo", "hi", "n")}, "CAST(bin AS VARCHAR)"),
       _top_sql("top_fp", "y = 0 AND prediction = 1", "DESC"), _top_sql("top_fn", "y = 1 AND prediction = 0", "ASC")])


@query("error_analysis", W(ERROR_SQL, "logits", extra=EA_CTES))
def q_error_analysis(spark, sf_dir):
    df = _prediction_file(spark, sf_dir)
    found = CL.infer_columns(df)                                        # PF-13
    d = df.select("id", CL.coerce_binary(found["label"]).cast("int").alias("y"),             # PF-14
                  CL.coerce_binary(found["pred"]).cast("int").alias("prediction"),
                  SC.parse_logits(found["logits_col"]).alias("_a")) \
        .withColumn("score", SC.positive_prob("_a")).drop("_a")          # F-18
    every = cut_lineage(CL.percent_rescale(d, "score"))                  # PF-15; parsed once, read by each section
    d = CL.complete_cases(every, "y", "prediction")                      # PF-12
    at = F.round(F.col("threshold") * 1000000).cast("long").cast("string")
    curve = F.col("threshold").isNotNull()                               # without the fixed end points
    ex = d.select(F.col("y").alias("true_label"), F.col("prediction").alias("pred_label"),
                  F.col("score").alias("pred_prob_pos"), F.col("id").alias("ID"), "score")
    cum = cut_lineage(C.cumulative_desc(d, "y", "score"))               # one histogram for all curves
    parts = [
        R.long_rows(C.ranking_summary(d, cum=cum), "ranking", ["roc_auc", "average_precision", "pr_auc"]),   # A-7 ... A-9
        R.long_rows(C.pr_curve(d, cum=cum).filter(curve), "pr_curve", ["precision", "recall"], at),       # A-10
        R.long_rows(C.roc_curve(d, cum=cum).filter(curve), "roc_curve", ["fpr", "tpr"], at),              # A-11
        R.long_rows(C.score_histogram(d, "score", 20), "histogram", ["lo", "hi", "n"], F.col("bin").cast("string")),     # A-12
        R.long_rows(ER.top_false_positives(ex, 50), "top_fp", ["score"], F.col("ID").cast("string")),     # S-2
        R.long_rows(ER.top_false_negatives(ex, 50), "top_fn", ["score"], F.col("ID").cast("string")),     # S-3
    ]
    out = R.evaluation(every, "y", "prediction")                         # A-1 ... A-6
    for p in parts:
        out = out.unionByName(p)
    return r6(out)


# ---------------------------------------------------------------- P-5 prompted chain (one-shot, truncation, scorer)
PROMPT_CTES = EXAMPLE_CTES + (
    f"pp0 AS (SELECT p.pair_id, p.label, p.idea_unit, p.segment_text, ex.ex_pos IS NULL AS zero, ex.ex_pos = p.pair_id AS is_self, "
    f"CASE WHEN ex.ex_pos IS NULL THEN {zero_shot_sql('p.idea_unit', 'p.segment_text')} "
    f"ELSE {one_shot_sql('p.idea_unit', 'p.segment_text', 'ex.ex_idea', 'ex.ex_note', 'ex.ex_label')} END AS prompt "
    "FROM pairs p LEFT JOIN ex ON ex.topic = p.topic)",
    f"pp1 AS (SELECT *, len({toks_sql('prompt')}) AS total, {toks_sql(strip_sql('segment_text'))} AS nt FROM pp0)",
    "pp2 AS (SELECT *, total > 1024 AS over, CASE WHEN total > 1024 THEN "
    "array_to_string(nt[1 : greatest(1024 - (total - len(nt)), 0)], ' ') ELSE segment_text END AS note FROM pp1)",
    f"pp AS (SELECT *, CASE WHEN len({S.overlap_set('idea_unit')}) = 0 THEN 0.0 ELSE len(list_intersect({S.overlap_set('idea_unit')}, "
    f"{S.overlap_set('note')})) / len({S.overlap_set('idea_unit')}) END > 0.2 AS yes FROM pp2)",
)


@query("prompted_chain", W(f"""
SELECT n, n_truncated, n_zero_shot, n_self, tp, fp, fn, tn, {S.metric_cols()} FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE over) AS n_truncated, count(*) FILTER (WHERE zero) AS n_zero_shot,
    count(*) FILTER (WHERE is_self) AS n_self,
    count(*) FILTER (WHERE label = 1 AND yes) AS tp, count(*) FILTER (WHERE label <> 1 AND yes) AS fp,
    count(*) FILTER (WHERE label = 1 AND NOT yes) AS fn, count(*) FILTER (WHERE label <> 1 AND NOT yes) AS tn
  FROM pp WHERE label IS NOT NULL) c""", "pairs", extra=PROMPT_CTES))
def q_prompted_chain(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True)                          # J-2, PF-9
    ex = _examples(spark, sf_dir)                                        # W-3
    ex = ex.withColumn("ex_tokens", PM.example_tokens(F.col("ex_idea"), F.col("ex_note"), F.col("ex_label")))
    return r6(prompted_counts(PR.one_shot_join(p, ex)))                  # J-5


def prompted_counts(j, max_tokens: int = 1024):
    """P-5 from pairs with their examples: the note is cut to the prompt's room (F-19 ... F-21),
    and the scorer sees the cut note, as a model would."""
    i, n = F.col("idea_unit"), F.col("segment_text")
    z_n, _, z_over = PM.cut_note(i, n, max_tokens)                       # F-19, F-21
    example = {"ex_idea": F.col("ex_idea"), "ex_note": F.col("ex_note"), "ex_label": F.col("ex_label")}
    o_n, _, o_over = PM.cut_note(i, n, max_tokens, example, F.col("ex_tokens"))   # F-20, F-21
    zero = F.col("ex_pos").isNull()
    j = j.select("pair_id", "label", "idea_unit", zero.alias("zero"), "is_self", F.when(zero, z_n).otherwise(o_n).alias("note"),
                 F.when(zero, z_over).otherwise(o_over).alias("over"))
    scored = SC.lexical_scores(j.filter(F.col("label").isNotNull()), "idea_unit", "note")   # X-3
    s = scored.withColumn("pred_llm", SC.yes_no_label())                 # F-22
    c = s.agg(F.count(F.lit(1)).alias("n"), F.count_if("over").alias("n_truncated"),
              F.count_if("zero").alias("n_zero_shot"), F.count_if("is_self").alias("n_self"),
              *M.binary_counters("label", "pred_llm")[1:])               # A-1, A-2
    return c.select("n", "n_truncated", "n_zero_shot", "n_self", "tp", "fp", "fn", "tn", *M.metric_columns())


# ---------------------------------------------------------------- P-6 prompted evaluation
PE_CTES = (
    f"""pe0 AS (SELECT label, CAST(CASE WHEN len({S.overlap_set('idea_unit')}) = 0 THEN 0.0
      ELSE len(list_intersect({S.overlap_set('idea_unit')}, {S.overlap_set('segment_text')})) / len({S.overlap_set('idea_unit')})
      END > 0.2 AS INTEGER) AS pred_llm FROM pairs)""",
    "pe AS (SELECT * FROM pe0 WHERE label IS NOT NULL AND pred_llm IS NOT NULL)",
) + S.report_ctes("pe", "label", "pred_llm", "q")


@query("prompted_evaluation", W(S.long_union(S.evaluation_rows("pe", "label", "pred_llm", "q", "pe0")), "pairs", extra=PE_CTES))
def q_prompted_evaluation(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True).select("pair_id", "label", "idea_unit", F.col("segment_text").alias("note"))
    pred = SC.lexical_scores(p, "idea_unit", "note").withColumn("pred_llm", SC.yes_no_label())
    CL.require_columns(pred, ["pair_id", "label", "pred_llm"], "llm predictions")       # PF-2
    return r6(R.evaluation(pred, "label", "pred_llm"))                                  # PF-12, A-1, A-2, A-4 ... A-6


# ---------------------------------------------------------------- X-4 features, and the trained classifier (rows-only check)
def _features(spark, sf_dir):
    spans = _spans(spark, sf_dir).filter(F.col("label").isNotNull())
    f = SC.pair_features(SP.random_split(spans, 42, 0.2, "pair_id"), "idea_unit", "note_text")
    return f.select("pair_id", "experiment", "topic", "label", "split", *SC.FEATURES)      # no texts beyond this point


@query("pair_features", W("SELECT pair_id, label, split, " + ", ".join(f"round({f}, 6) AS {f}" for f in SC.FEATURES)
                          + " FROM pf WHERE label IS NOT NULL", "pairs", extra=FEATURE_CTES))
def q_pair_features(spark, sf_dir):
    return r6(_features(spark, sf_dir).drop("experiment", "topic"))


ONE_RUN = ("lf AS (SELECT 0 AS run, * FROM pf WHERE label IS NOT NULL AND split = 'train')",) + fit_ctes("lf", "run", {0: LG.REG})
CLASSIFIER_CTES = FEATURE_CTES + ONE_RUN + (
    f"cval AS (SELECT label AS y, round({prob_sql()}, 6) AS score FROM pf, (SELECT w FROM lg WHERE k = {LG.ROUNDS}) l "
    "WHERE label IS NOT NULL AND split = 'val')",) + best_ctes("cval", "k")


@query("train_pair_classifier", recursive(W(record_sql("cval", "k", "model", "score > 0.5") + "\nUNION ALL\n"
                                            + record_sql("cval", "k"), "pairs", extra=CLASSIFIER_CTES)))
def q_train_pair_classifier(spark, sf_dir):
    f = cut_lineage(_features(spark, sf_dir))        # reliable checkpoint: the rounds read it again and again
    path = SC.train_pair_classifier(f.filter(F.col("split") == "train"))
    pred = SC.predict_pairs(f.filter(F.col("split") == "val"), path)
    return r6(metric_record(pred.select(F.col("label").alias("y"), F.col("prob_1").alias("score"), "pred_argmax"),
                            model_pred="pred_argmax"))       # both decisions: argmax and tuned threshold


# ---------------------------------------------------------------- X-6 parameter search and best epoch
SEARCH = (0.001, 0.01, 0.1)
SEARCH_CTES = FEATURE_CTES + (
    f"lf AS (SELECT r.reg_param, pf.* FROM pf, (SELECT unnest({list(SEARCH)}) AS reg_param) r WHERE label IS NOT NULL AND split = 'train')",
) + fit_ctes("lf", "reg_param", {f"CAST({r} AS DOUBLE)": r for r in SEARCH}) + (
    f"sval AS (SELECT reg_param, label AS y, round({prob_sql()}, 6) AS score FROM pf, lg WHERE k = {LG.ROUNDS} AND label IS NOT NULL "
    "AND split = 'val')",) + run_best_ctes("sval", "reg_param")


@query("param_search", recursive(W(best_of("reg_param"), "pairs", extra=SEARCH_CTES)))
def q_param_search(spark, sf_dir):
    f = cut_lineage(_features(spark, sf_dir))
    return r6(SC.param_search(f.filter(F.col("split") == "train"), f.filter(F.col("split") == "val"), SEARCH, "label"))


EPOCH_CTES = FEATURE_CTES + ONE_RUN + (
    f"eval_rows AS (SELECT k AS epoch, label AS y, round({prob_sql()}, 6) AS score FROM pf, lg WHERE k > 0 AND label IS NOT NULL AND split = 'val')",
) + run_best_ctes("eval_rows", "epoch")


@query("best_epoch", recursive(W(best_of("epoch"), "pairs", extra=EPOCH_CTES)))
def q_best_epoch(spark, sf_dir):
    f = cut_lineage(_features(spark, sf_dir))
    return r6(SC.epoch_search(f.filter(F.col("split") == "train"), f.filter(F.col("split") == "val")))


# ---------------------------------------------------------------- X-5 with a fit per seed, A-20
SEED_FIT_CTES = FEATURE_CTES + (
    "sf0 AS (" + " UNION ALL ".join(
        f"SELECT {s} AS seed, *, row_number() OVER (ORDER BY md5('{s}-' || CAST(pair_id AS VARCHAR)), pair_id) "
        f"<= floor(0.2 * count(*) OVER ()) AS is_val FROM pf WHERE label IS NOT NULL" for s in FX.SEEDS) + ")",
    "lf AS (SELECT * FROM sf0 WHERE NOT is_val)",
) + fit_ctes("lf", "seed", {s: LG.REG for s in FX.SEEDS}) + (
    f"sfv AS (SELECT seed, label AS y, round({prob_sql()}, 6) AS score FROM sf0 JOIN lg USING (seed) WHERE k = {LG.ROUNDS} AND is_val)",
) + run_best_ctes("sfv", "seed") + ("sft AS (SELECT sfv.*, CAST(score >= threshold AS INTEGER) AS prediction FROM sfv JOIN rb USING (seed))",
                                    ) + run_ctes("sft", "seed")


@query("seed_fits", recursive(W(SUMMARY_SQL, "pairs", extra=SEED_FIT_CTES)))
def q_seed_fits(spark, sf_dir):
    f = _features(spark, sf_dir).select("pair_id", "label", *SC.FEATURES)
    runs = SP.seed_runs(cut_lineage(f), FX.SEEDS, 0.2, "pair_id")
    val = SC.seed_fits(runs, FX.SEEDS)
    return run_summary(R.run_records(val, ["seed"], "label", "prob_1"))

"""Registered text queries: similarity signals (F-1 ... F-9, F-24), cleaning (PF-16, PF-19),
threshold sweep (A-19, W-6) and the rule chains (P-1, P-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from notecover.functions import lcs
from notecover.functions import text as T
from notecover.operators import metrics as M
from notecover.operators import similarity as SIM
from notecover.operators import sweep as SW
from notecover.operators.joins import join_small
from notecover.plans import sqlparts as S
from notecover.plans.registry import query, r6
from notecover.sources import fixtures as FX
from notecover.sources.fixtures import with_fixtures as W
from notecover.sources.tables import table

RESP = S.strip_lower("response")
ANS = S.strip_lower("correct_answer")
JACC_CTE = (f"j AS (SELECT pair_id, label, response, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 "
            f"ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard "
            f"FROM (SELECT pair_id, label, response, list_distinct({S.ws_tokens(RESP)}) AS a, "
            f"list_distinct({S.ws_tokens(ANS)}) AS b FROM answers) x)")


def _answers_jaccard(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    return a.withColumn("jaccard", T.jaccard(T.strip_lower("response"), T.strip_lower("correct_answer")))


# ---------------------------------------------------------------- F-2, U-3
@query("jaccard", W("SELECT pair_id, round(jaccard, 6) AS jaccard FROM j", "answers", extra=(JACC_CTE,)))
def q_jaccard(spark, sf_dir):
    return r6(_answers_jaccard(spark, sf_dir).select("pair_id", "jaccard"))


# ---------------------------------------------------------------- F-3
TOK2 = T.TOK2
COS_CTES = (
    f"toks AS (SELECT pair_id, unnest(regexp_extract_all(lower(coalesce(response, '')), '{TOK2}')) AS tok, 1 AS ia, 0 AS ib FROM answers "
    f"UNION ALL SELECT pair_id, unnest(regexp_extract_all(lower(coalesce(correct_answer, '')), '{TOK2}')), 0, 1 FROM answers)",
    "cnt AS (SELECT pair_id, tok, sum(ia) AS ca, sum(ib) AS cb FROM toks GROUP BY pair_id, tok)",
    "fold AS (SELECT pair_id, sum(ca * cb) AS dot, sum(ca * ca) AS na, sum(cb * cb) AS nb FROM cnt GROUP BY pair_id)",
    "cosq AS (SELECT a.pair_id, a.label, a.response, a.correct_answer, coalesce(CASE WHEN f.na * f.nb > 0 "
    "THEN f.dot / sqrt(f.na * f.nb) END, 0.0) AS cosine FROM answers a LEFT JOIN fold f USING (pair_id))",
)


@query("cosine_tf", W("SELECT pair_id, round(cosine, 6) AS cosine FROM cosq", "answers", extra=COS_CTES))
def q_cosine_tf(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    return r6(SIM.cosine_tf(a, "pair_id", "response", "correct_answer").select("pair_id", "cosine"))


# ---------------------------------------------------------------- F-4 (whole texts)
SORTED_CTE = f"st AS (SELECT pair_id, {S.token_sort(RESP)} AS a, {S.token_sort(ANS)} AS b FROM answers)"


@query("fuzzy_indel", W(f"SELECT pair_id, round({S.indel_ratio('x')}, 6) AS fuzzy FROM xq", "answers",
                        extra=(SORTED_CTE,) + S.lcs_ctes("st", "x")))
def q_fuzzy_indel(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    f = lcs.token_sort_ratio(T.strip_lower("response"), T.strip_lower("correct_answer"))
    return r6(a.select("pair_id", f.alias("fuzzy")))


# ---------------------------------------------------------------- F-5 (whole texts)
@query("fuzzy_levenshtein", W(f"SELECT pair_id, round({S.levenshtein_ratio('a', 'b')}, 6) AS levenshtein_ratio FROM st",
                              "answers", extra=(SORTED_CTE,)))
def q_fuzzy_levenshtein(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    a = a.select("pair_id", "response", "correct_answer")
    f = lcs.with_levenshtein_ratio(a, T.strip_lower("response"), T.strip_lower("correct_answer"), "levenshtein_ratio")
    return r6(f.select("pair_id", "levenshtein_ratio"))


# ---------------------------------------------------------------- F-6
@query("number_match", W(f"""
SELECT pair_id, CAST(len(ra) > 0 AND ra = rb AS INTEGER) AS num_match FROM (
  SELECT pair_id, regexp_extract_all({S.strip_lower('idea_unit')}, '\\p{{Nd}}+') AS ra,
         regexp_extract_all({S.strip_lower('segment_text')}, '\\p{{Nd}}+') AS rb FROM pairs) x""", "pairs"))
def q_number_match(spark, sf_dir):
    p = FX.pairs(spark, sf_dir, with_text=True, labels=False)
    return p.select("pair_id", T.number_match(T.strip_lower("idea_unit"), T.strip_lower("segment_text")).alias("num_match"))


# ---------------------------------------------------------------- F-7 (alternative weights, SQL-computable signals)
WEIGHTS_SQL = {"jaccard": 0.2, "cosine": 0.15, "number": 0.05}
NUM_SQL = (f"CAST(len(regexp_extract_all({RESP}, '\\p{{Nd}}+')) > 0 AND regexp_extract_all({RESP}, '\\p{{Nd}}+') "
           f"= regexp_extract_all({ANS}, '\\p{{Nd}}+') AS INTEGER)")


@query("weighted_score", W(f"""
SELECT pair_id, round(CAST(0.2 AS DOUBLE) * jaccard + CAST(0.15 AS DOUBLE) * cosine
                      + CAST(0.05 AS DOUBLE) * CAST(num AS DOUBLE), 6) AS score
FROM (SELECT c.pair_id, j.jaccard, c.cosine, {NUM_SQL.replace('response', 'c.response').replace('correct_answer', 'c.correct_answer')} AS num
      FROM cosq c JOIN j USING (pair_id)) x""", "answers", extra=(JACC_CTE,) + COS_CTES))
def q_weighted_score(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    a = SIM.cosine_tf(a, "pair_id", "response", "correct_answer", "cosine")
    r, c = T.strip_lower("response"), T.strip_lower("correct_answer")
    sig = {"jaccard": T.jaccard(r, c), "cosine": F.col("cosine"), "number": T.number_match(r, c).cast("double")}
    return r6(a.select("pair_id", SW.weighted_score(sig, WEIGHTS_SQL).alias("score")))


# ---------------------------------------------------------------- F-8, F-1
@query("three_way_label", W("""
SELECT pair_id, round(jaccard, 6) AS score,
  CASE WHEN jaccard > 0.6 THEN 1 WHEN jaccard > 0.59 THEN 0 ELSE -1 END AS predicted_label FROM j""",
                            "answers", extra=(JACC_CTE,)))
def q_three_way_label(spark, sf_dir):
    a = _answers_jaccard(spark, sf_dir)
    return r6(a.select("pair_id", F.col("jaccard").alias("score"),
                       T.three_way_label("jaccard", 0.60, 0.59).alias("predicted_label")))


# ---------------------------------------------------------------- F-9 (note segments tokenised once per note)
@query("lexical_overlap", W(f"""
SELECT pair_id, round(CASE WHEN len(ia) = 0 THEN 0.0 ELSE len(list_intersect(ia, na)) / len(ia) END, 6) AS overlap
FROM (SELECT pair_id, {S.overlap_set('idea_unit')} AS ia, {S.overlap_set('segment_text')} AS na FROM pairs) x""",
                            "pairs"))
def q_lexical_overlap(spark, sf_dir):
    n = FX.notes(spark, sf_dir).select("topic", "id", T.once(F.array(*[T.overlap_tokens(s) for s in FX.SEGMENTS])).alias("sets"))
    i = FX.ideas(spark, sf_dir).select("topic", "pos", T.overlap_tokens("idea_unit").alias("iset"))
    seg = ((F.col("id") + F.col("pos")) % 4 + 1).cast("int")
    p = join_small(n, i, ["topic"], salt_from="id")
    return r6(p.select((F.col("id") * 100000 + F.col("pos")).alias("pair_id"),
                       T.overlap_of_sets(F.col("iset"), F.element_at("sets", seg)).alias("overlap")))


# ---------------------------------------------------------------- F-24 (consecutive embeddings)
@query("embedding_cosine", """
SELECT a.vec_id AS pair_id, round(CASE WHEN sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y)) = 0 THEN 0.0
  ELSE list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))) END, 6) AS cosine
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) a
JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS y FROM embeddings) b ON b.vec_id = a.vec_id + 1""")
def q_embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.select("vec_id", F.col("embedding").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return r6(a.join(b, "vec_id").select(F.col("vec_id").alias("pair_id"), T.embedding_cosine("x", "y").alias("cosine")))


# ---------------------------------------------------------------- PF-16 (without lemma table)
def _clean_sql(c):
    return f"array_to_string(regexp_extract_all(lower(coalesce({c}, '')), '{T.WORD}'), ' ')"


@query("clean_text", W(f"""
SELECT pair_id, {_clean_sql('question')} AS question, {_clean_sql('response')} AS response,
       {_clean_sql('correct_answer')} AS correct_answer FROM answers""", "answers"))
def q_clean_text(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    return a.select("pair_id", *[SIM.clean_text(c).alias(c) for c in ("question", "response", "correct_answer")])


# ---------------------------------------------------------------- PF-16 with a lemma table (words of the ideas, plural s cut)
LEMMA_CTES = (
    f"lemma AS (SELECT DISTINCT w AS word, substring(w, 1, length(w) - 1) AS lemma FROM (SELECT unnest(regexp_extract_all("
    f"lower(coalesce(idea_unit, '')), '{T.WORD}')) AS w FROM ideas) x WHERE length(w) > 3 AND ends_with(w, 's'))",
    f"lw AS (SELECT pair_id, generate_subscripts(t, 1) AS i, unnest(t) AS w FROM (SELECT pair_id, "
    f"regexp_extract_all(lower(coalesce(response, '')), '{T.WORD}') AS t FROM answers) x)",
    "lj AS (SELECT pair_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS c FROM lw LEFT JOIN lemma ON word = w GROUP BY pair_id)",
)


@query("lemmatise", W("SELECT pair_id, coalesce(c, '') AS response_clean FROM answers LEFT JOIN lj USING (pair_id)",
                      "answers", extra=LEMMA_CTES))
def q_lemmatise(spark, sf_dir):
    words = FX.ideas(spark, sf_dir).select(F.explode(T.word_tokens(F.lower(F.coalesce("idea_unit", F.lit(""))))).alias("word"))
    lemmas = words.filter((F.length("word") > 3) & F.endswith("word", F.lit("s"))).distinct() \
        .withColumn("lemma", F.expr("substring(word, 1, length(word) - 1)"))
    a = FX.answers(spark, sf_dir).select("pair_id", "response")
    return SIM.lemmatise(a, "pair_id", "response", lemmas).select("pair_id", "response_clean")


# ---------------------------------------------------------------- PF-19
@query("non_answer_guard", W(f"""
SELECT pair_id, CAST({RESP} IN ('', 'idk', 'i don''t know', 'i dunno') AS INTEGER) AS non_answer FROM answers""",
                             "answers"))
def q_non_answer_guard(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    return a.select("pair_id", T.non_answer("response").cast("int").alias("non_answer"))


# ---------------------------------------------------------------- A-19, J-8, W-6 on the Jaccard score
SWEEP_GRID = SW.sweep_grid()
GRID_SQL = ("grid AS (SELECT CAST(h AS DOUBLE) / CAST(100 AS DOUBLE) AS result_1_limit, "
            "CAST(l AS DOUBLE) / CAST(100 AS DOUBLE) AS result_0_limit "
            "FROM range(60, 66) a(h), range(55, 65) b(l) WHERE l < h)")
GUARD_SQL = f"({RESP} IN ('', 'idk', 'i don''t know', 'i dunno'))"
SWEEP_SQL_CTES = (
    JACC_CTE, GRID_SQL,
    f"sj AS (SELECT label, jaccard, {GUARD_SQL} AS guard FROM j)",
    "sw AS (SELECT g.result_1_limit, g.result_0_limit, "
    "count(*) FILTER (WHERE label = CASE WHEN guard THEN -1 WHEN jaccard > g.result_1_limit THEN 1 "
    "WHEN jaccard > g.result_0_limit THEN 0 ELSE -1 END) AS n_correct, count(*) AS n "
    "FROM grid g, sj GROUP BY ALL)",
)


def _sweep_input(spark, sf_dir):
    a = _answers_jaccard(spark, sf_dir)
    return a.select("label", F.col("jaccard").alias("score"), T.non_answer("response").alias("guard"))


@query("threshold_sweep", W("""
SELECT result_1_limit, result_0_limit, round(n_correct / n, 6) AS accuracy, n_correct, n FROM sw""",
                            "answers", extra=SWEEP_SQL_CTES))
def q_threshold_sweep(spark, sf_dir):
    return r6(SW.threshold_sweep(_sweep_input(spark, sf_dir), "score", "label", "guard", SWEEP_GRID))


@query("best_sweep", W("""
SELECT result_1_limit, result_0_limit, round(n_correct / n, 6) AS accuracy, n_correct, n FROM sw
ORDER BY n_correct / n DESC, result_1_limit, result_0_limit LIMIT 1""", "answers", extra=SWEEP_SQL_CTES))
def q_best_sweep(spark, sf_dir):
    return r6(SW.best_sweep(SW.threshold_sweep(_sweep_input(spark, sf_dir), "score", "label", "guard", SWEEP_GRID)))


# ---------------------------------------------------------------- P-1 rule chain (fuzzy score)
CR, CA = S.strip_lower("response"), S.strip_lower("correct_answer")
RULE_CTES = (
    f"cl AS (SELECT pair_id, label, {_clean_sql('response')} AS response, {_clean_sql('correct_answer')} AS correct_answer FROM answers)",
    f"cs AS (SELECT pair_id, label, {GUARD_SQL} AS guard, {S.token_sort(CR)} AS a, {S.token_sort(CA)} AS b FROM cl)",
) + S.lcs_ctes("cs", "r") + (
    f"rf AS (SELECT c.label, c.guard, {S.indel_ratio('r')} AS score FROM cs c JOIN rq USING (pair_id))",)


@query("rule_chain", W(f"""
SELECT n, correct, tp, fp, fn, {S.metric_cols(correct='correct')} FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE label = pl) AS correct, count(*) FILTER (WHERE label = 1 AND pl = 1) AS tp,
    count(*) FILTER (WHERE label <> 1 AND pl = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pl <> 1) AS fn, 0 AS tn
  FROM (SELECT label, CASE WHEN guard THEN -1 WHEN score > 0.6 THEN 1 WHEN score > 0.59 THEN 0 ELSE -1 END AS pl
        FROM rf) x) c""", "answers", extra=RULE_CTES))
def q_rule_chain(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    cleaned = a.select("pair_id", "label", *[SIM.clean_text(c).alias(c) for c in ("response", "correct_answer")])
    scored = SIM.score_answers(cleaned, weights=SIM.SHIPPED_WEIGHTS, guard=True, for_labels_only=True)
    return r6(M.ovr_metrics(scored, "label", "predicted_label"))


# ---------------------------------------------------------------- P-2 rule tuning (fuzzy score once, sweep)
@query("rule_tuning", W("""
SELECT result_1_limit, result_0_limit, round(n_correct / n, 6) AS accuracy, n_correct, n FROM (
  SELECT g.result_1_limit, g.result_0_limit, count(*) AS n, count(*) FILTER (WHERE label = CASE WHEN guard THEN -1
    WHEN score > g.result_1_limit THEN 1 WHEN score > g.result_0_limit THEN 0 ELSE -1 END) AS n_correct
  FROM grid g, rf GROUP BY ALL) x
ORDER BY n_correct / n DESC, result_1_limit, result_0_limit LIMIT 1""", "answers", extra=RULE_CTES + (GRID_SQL,)))
def q_rule_tuning(spark, sf_dir):
    a = FX.answers(spark, sf_dir)
    cleaned = a.select("pair_id", "label", *[SIM.clean_text(c).alias(c) for c in ("response", "correct_answer")])
    low = min(lo for _, lo in SWEEP_GRID)
    f = lcs.token_sort_ratio(T.strip_lower("response"), T.strip_lower("correct_answer"), skip_below=low)
    s = cleaned.select("label", f.alias("score"), T.non_answer("response").alias("guard"))
    return r6(SW.best_sweep(SW.threshold_sweep(s, "score", "label", "guard", SWEEP_GRID)))

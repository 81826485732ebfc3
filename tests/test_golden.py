"""Golden values from FIXTURES.md §3 (computed from the published definitions)."""

import pytest
from pyspark.sql import functions as F

from notecover.functions import lcs
from notecover.functions import text as T
from notecover.operators import align as AL
from notecover.operators import curves as C
from notecover.operators import metrics as M
from notecover.operators import sweep as SW
from notecover.operators.similarity import cosine_tf

PAIRS = [
    ("the cat sat", "sat cat the", 1.0, 1.0, 1.0, 1.0, 1.0),
    ("energy quanta", "quantum energy", 0.888889, 0.857143, 0.333333, 0.5, 0.5),
    ("a laser is light", "light, a laser", 0.866667, 0.75, 0.4, 0.816497, 0.75),
    ("12 birds", "21 birds", 0.875, 0.75, 0.333333, 0.5, 0.5),
]


def test_similarity_golden(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(PAIRS)], "id long, a string, b string")
    df = cosine_tf(df, "id", "a", "b", "cos")
    out = df.select("id", lcs.token_sort_ratio(T.strip_lower("a"), T.strip_lower("b")).alias("indel"),
                    T.levenshtein_ratio(T.strip_lower("a"), T.strip_lower("b")).alias("lev"),
                    T.jaccard(T.strip_lower("a"), T.strip_lower("b")).alias("jac"), "cos",
                    T.lexical_overlap("a", "b").alias("ov"), T.number_match("a", "b").alias("num")).orderBy("id").collect()
    for r, (_, _, indel, lev, jac, cos, ov) in zip(out, PAIRS):
        assert r["indel"] == pytest.approx(indel, abs=1e-6)
        assert r["lev"] == pytest.approx(lev, abs=1e-6)
        assert r["jac"] == pytest.approx(jac, abs=1e-6)
        assert r["cos"] == pytest.approx(cos, abs=1e-6)
        assert r["ov"] == pytest.approx(ov, abs=1e-6)
    assert out[3]["num"] == 0


def test_empty_inputs(spark):
    df = spark.createDataFrame([(0, "", "abc"), (1, "abc", "")], "id long, a string, b string")
    df = cosine_tf(df, "id", "a", "b", "cos")
    rows = df.select("id", T.jaccard("a", "b").alias("j"), "cos", T.lexical_overlap("a", "b").alias("ov")) \
        .orderBy("id").collect()
    assert [r["j"] for r in rows] == [0.0, 0.0]
    assert [r["cos"] for r in rows] == [0.0, 0.0]
    assert rows[0]["ov"] == 0.0


SPANS = [  # K, j, margin, L, max_length, idea tokens, budget, start, end, taken
    (4, 2, 0.1, 20, 256, 5, 248, 8, 17, 9),
    (4, 0, 0.1, 20, 256, 5, 248, 0, 7, 7),
    (4, 3, 0.1, 20, 256, 5, 248, 13, 20, 7),
    (7, 3, 0.0, 5, 256, 5, 248, 2, 5, 3),
    (9, 4, 0.0, 4, 256, 5, 248, 1, 2, 1),
    (3, 1, 0.3, 1000, 256, 20, 233, 33, 966, 233),
    (2, 0, 0.1, 100, 64, 40, 32, 0, 60, 32),
]


@pytest.mark.parametrize("case", SPANS)
def test_aligned_span_golden(spark, case):
    k, j, m, L, ml, nt, budget, start, end, taken = case
    df = spark.createDataFrame([(j, k, 1, L, nt)], "j int, k int, segment int, L int, nt int")
    a, b = AL.align_interval(margin=m)
    bud = AL.token_budget(F.col("nt"), ml)
    s, e, t = AL.span_bounds(a, b, F.col("L"), bud)
    r = df.select(bud.alias("budget"), s.alias("s"), e.alias("e"), t.alias("t")).first()
    assert (r["budget"], r["s"], r["e"], r["t"]) == (budget, start, end, taken)


def _ranking_df(spark):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [.9, .8, .8, .6, .55, .4, .3, .1]
    return spark.createDataFrame(list(zip(y, s)), "y int, score double")


def test_ranking_golden(spark):
    df = _ranking_df(spark)
    assert C.roc_auc(df).first()[0] == pytest.approx(0.71875)
    assert C.average_precision(df).first()[0] == pytest.approx(0.7470238095)
    assert C.pr_auc_trapezoid(df).first()[0] == pytest.approx(0.7693452381)
    rk = C.ranking_summary(df).first()
    assert rk["roc_auc"] == pytest.approx(0.71875) and rk["pr_auc"] == pytest.approx(0.7693452381)
    bt = C.best_threshold(df).first()
    assert bt["threshold"] == pytest.approx(0.56) and bt["f1"] == pytest.approx(0.75)
    d = df.withColumn("prediction", (F.col("score") >= 0.5).cast("int"))
    r = M.balanced_accuracy(d).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (3, 2, 1, 2)
    assert r["balanced_accuracy"] == pytest.approx(0.625)


def test_saved_run_golden(spark):
    rows = [(1, 1)] * 34 + [(0, 1)] * 20 + [(1, 0)] * 1 + [(0, 0)] * 21
    df = spark.createDataFrame(rows, "y int, prediction int")
    r = M.binary_metrics(df).first()
    assert r["n"] == 76
    assert r["accuracy"] == pytest.approx(0.7236842105)
    assert r["precision"] == pytest.approx(0.6296296296)
    assert r["recall"] == pytest.approx(0.9714285714)
    assert r["f1"] == pytest.approx(0.7640449438)


def test_sweep_grid():
    g = SW.sweep_grid()
    assert len(g) == 45 and g[0] == (0.60, 0.55) and g[-1] == (0.65, 0.64)


def test_saved_error_order(spark):
    from notecover.operators import errors as ER
    fp_scores = [0.5990759, 0.5987495, 0.5978715, 0.44425756]
    rows = [(0, 1, s, i) for i, s in enumerate(fp_scores)] + [(1, 0, 0.3811341, 9)]
    ex = spark.createDataFrame(rows, "true_label int, pred_label int, pred_prob_pos double, ID int")
    top = [r["pred_prob_pos"] for r in ER.top_false_positives(ex).collect()]
    assert top == fp_scores
    assert [r["pred_prob_pos"] for r in ER.top_false_negatives(ex).collect()] == [0.3811341]

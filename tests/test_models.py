"""Rows-only queries (trained classifier, parameter search) and the scorer plumbing."""

import __spark_entry__ as E
from notecover.operators import score as SC
from conftest import SF_SMALL


def test_train_pair_classifier(spark):
    r = E.queries()["train_pair_classifier"](spark, SF_SMALL).first()
    assert r["n_eval"] > 0 and 0.0 <= r["accuracy"] <= 1.0
    assert sorted(x["decision"] for x in E.queries()["train_pair_classifier"](spark, SF_SMALL).collect()) == ["model", "threshold"]
    assert r["roc_auc"] is None or 0.0 <= r["roc_auc"] <= 1.0


def test_param_search(spark):
    rows = E.queries()["param_search"](spark, SF_SMALL).collect()
    assert len(rows) == 3
    assert rows == sorted(rows, key=lambda r: (-r["f1"], r["reg_param"]))


def test_batch_score_keeps_ids(spark):
    df = spark.createDataFrame([(i, "a b c", "a x" if i % 2 else "z") for i in range(50)],
                               "pair_id long, idea_unit string, note string").repartition(4)
    out = SC.batch_score(df, SC.lexical_scorer_factory(), "yes_logit double, no_logit double")
    got = {r["pair_id"]: r["yes_logit"] for r in out.collect()}
    assert all(abs(got[i] - (1 / 3 if i % 2 else 0.0)) < 1e-12 for i in range(50))


def test_overlap_python_equals_spark(spark):
    from notecover.functions import text as T
    texts = [("The cat; sat.", "cat  sat on mat"), ("", "x"), ("a,b", "B")]
    df = spark.createDataFrame(texts, "a string, b string")
    got = [r[0] for r in df.select(T.lexical_overlap("a", "b")).collect()]
    assert got == [SC.overlap_py(a, b) for a, b in texts]


def test_a_cut_note_flips_the_prediction(spark):
    """P-5: the scorer sees the note as it fits into the prompt; words beyond the cut do not count."""
    from notecover.operators import pairs as PR
    from notecover.operators import prompt as PM
    from notecover.plans.q_chains import prompted_counts
    from pyspark.sql import functions as F
    filler = " ".join(["word"] * 300)
    p = spark.createDataFrame([(1, "t", 1, "blue whale", filler + " blue whale"), (2, "t", 1, "blue whale", "blue whale " + filler)],
                              "pair_id long, topic string, label int, idea_unit string, segment_text string")
    ex = spark.createDataFrame([("t", "red fox", "a red fox", 1, 2)],
                               "topic string, ex_idea string, ex_note string, ex_label int, ex_pos long")
    ex = ex.withColumn("ex_tokens", PM.example_tokens(F.col("ex_idea"), F.col("ex_note"), F.col("ex_label")))
    j = PR.one_shot_join(p, ex)
    assert {r["pair_id"]: r["is_self"] for r in j.collect()} == {1: False, 2: True}
    cut, whole = prompted_counts(j, 100).first(), prompted_counts(j, 1024).first()
    assert (cut["n_truncated"], cut["tp"], cut["fn"], cut["n_self"]) == (2, 1, 1, 1)
    assert (whole["n_truncated"], whole["tp"], whole["fn"]) == (0, 2, 0)


def test_evaluation_counts_dropped_rows_and_groups(spark):
    from notecover.operators import record as R
    rows = [(1, 1, "a"), (0, 1, "a"), (1, 0, "b"), (0, 0, None), (None, 1, "a"), (1, None, "b")]
    df = spark.createDataFrame(rows, "y int, p int, g string")
    got = {(r["section"], r["key"]): r["value"] for r in R.evaluation(df, "y", "p", ["g"]).collect()}
    assert (got["input", "n_in"], got["input", "n_dropped"], got["metrics", "n"]) == (6, 2, 4)
    assert [got["confusion", k] for k in ("0->0", "0->1", "1->0", "1->1")] == [1, 1, 1, 1]
    assert (got["group", "a:n"], got["group", "b:recall"], got["group", "a:pos_prevalence"]) == (2, 0.0, 0.5)
    assert got["report", "accuracy:f1"] == 0.5 and ("report", "accuracy:precision") not in got
    empty = {(r["section"], r["key"]): r["value"] for r in R.evaluation(df.limit(0), "y", "p", ["g"]).collect()}
    assert empty["input", "n_in"] == 0 and empty["metrics", "accuracy"] == 0.0


def test_batch_score_carries_ids_exactly_next_to_nulls(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, "a b", "a"), (None, "a", "a"), (1, "c", "d")], "pair_id long, idea_unit string, note string").coalesce(1)
    out = SC.batch_score(df, SC.lexical_scorer_factory("idea_unit", "note"), "yes_logit double, no_logit double")
    assert [(r.pair_id, r.yes_logit) for r in out.collect()] == [(big, 0.5), (None, 1.0), (1, 0.0)]


def test_calls_stay_within_the_token_budget(spark):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F
    sizes = [int(x) for x in np.random.default_rng(0).integers(0, 90, 500)] + [700, 0, 0, 400]
    calls = list(SC.padded_calls(np.array(sizes), 300))
    assert sorted(i for c in calls for i in c) == list(range(len(sizes)))
    assert all(max(max(sizes[i] for i in c), 1) * len(c) <= 300 or len(c) == 1 for c in calls)

    def factory():
        def score(b):
            padded = max(int(b["n"].max()), 1) * len(b)
            return pd.DataFrame({"padded": [padded] * len(b), "rows": [len(b)] * len(b)})
        return score
    df = spark.createDataFrame(list(enumerate(sizes)), "pair_id long, n int").withColumn("extra", F.lit("x")).repartition(3)
    out = SC.batch_score(df, factory, "padded long, rows int", keep=("pair_id", "n"), length="n", token_budget=300).collect()
    assert {r.pair_id: r.n for r in out} == dict(enumerate(sizes))
    assert all(r.padded <= 300 or r.rows == 1 for r in out) and max(r.rows for r in out) > 3

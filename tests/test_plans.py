"""Plan tests: the physical plans have the shape the design promises."""

from notecover.operators import errors as ER
from notecover.operators import pairs as PR
from notecover.operators import similarity as SIM
from notecover.sources import fixtures as FX
from conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_udf_without_fuzzy_weight(spark):
    a = FX.answers(spark, SF_SMALL)
    s = SIM.score_answers(a, weights={"jaccard": 0.2, "number": 0.05}, guard=True)
    p = plan(s)
    assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    s2 = SIM.score_answers(a, weights=SIM.SHIPPED_WEIGHTS, guard=True)
    assert "ArrowEvalPython" in plan(s2)


def test_full_notes_is_an_equi_join(spark):
    p = FX.pairs(spark, SF_SMALL)
    out = PR.full_notes(p, FX.notes(spark, SF_SMALL))
    txt = plan(out)
    assert "CartesianProduct" not in txt and "NestedLoopJoin" not in txt
    assert "HashJoin" in txt or "SortMergeJoin" in txt


def test_top_k_is_take_ordered(spark):
    from notecover.plans.q_model import _examples_table
    ex = _examples_table(spark, SF_SMALL)
    out = ER.top_false_negatives(ex, 50, "pair_id")
    out._jdf.queryExecution().executedPlan()
    txt = out._jdf.queryExecution().optimizedPlan().toString()
    assert "GlobalLimit 50" in txt
    # AQE wraps the physical plan; the final plan chooses TakeOrderedAndProject.
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().sparkPlan().toString()


def test_ideas_broadcast_and_scan_pruned(spark):
    p = FX.pairs(spark, SF_SMALL)
    txt = p._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in txt
    # the notes scan reads only the columns the pairs need
    scan = [ln for ln in txt.splitlines() if "documents.parquet" in ln]
    assert scan and all("n_chars" not in ln for ln in scan)


def test_sweep_has_no_cross_join(spark):
    from notecover.plans.q_text import q_threshold_sweep
    txt = q_threshold_sweep(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" not in txt and "NestedLoopJoin" not in txt


def test_filters_reach_the_scan(spark):
    from pyspark.sql import functions as F
    df = FX.table(spark, SF_SMALL, "lineitem").filter(F.col("l_returnflag") == "R").select("l_quantity")
    txt = df._jdf.queryExecution().sparkPlan().toString()
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in txt


PYTHON_OK = {"fuzzy_indel", "rule_chain", "rule_tuning", "batch_score", "batch_budget"}


def test_no_cross_products_and_python_only_where_needed(spark):
    """No registered query multiplies rows by a cross product (Cartesian or nested-loop join),
    and Python runs only in the queries built on the Indel UDF or a batch scorer."""
    import __spark_entry__ as E
    cross, python = [], []
    for name, q in sorted(E.queries().items()):
        if name in ("train_pair_classifier", "param_search"):
            continue                                   # results built from driver-side scalars
        txt = q(spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
        if "CartesianProduct" in txt or "NestedLoopJoin" in txt:
            cross.append(name)
        if ("ArrowEvalPython" in txt or "BatchEvalPython" in txt or "MapInPandas" in txt) and name not in PYTHON_OK:
            python.append(name)
    assert (cross, python) == ([], [])


def test_chains_score_without_python(spark):
    """The frames inside the chains, before they are materialised: no Python, no cross product."""
    from notecover.plans import q_chains as Q
    for df in (Q._span_features(spark, SF_SMALL), Q._prediction_file(spark, SF_SMALL), Q._features(spark, SF_SMALL)):
        txt = df._jdf.queryExecution().sparkPlan().toString()
        for word in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
            assert word not in txt


def test_labels_are_joined_only_where_they_are_read(spark):
    import __spark_entry__ as E
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("fill_text", "aligned_span", "fuzzy_indel", "number_match", "jaccard", "cosine_tf", "prompt_truncate", "pair_encoding",
                     "text_lengths", "batch_score", "weighted_score", "three_way_label"):
            txt = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().sparkPlan().toString()
            assert "labels" not in txt and "quality" not in txt, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

"""Property tests: invariances and exactness of the distributed formulations."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notecover.functions.lcs import lcs_length
from notecover.operators import curves as C
from notecover.operators import split as SP
from conftest import SF_SMALL


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0]
        for j, d in enumerate(b):
            cur.append(prev[j] + 1 if ch == d else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcé ñ", max_size=40), st.text(alphabet="abcé ñ", max_size=40))
def test_bit_parallel_lcs_equals_dp(a, b):
    assert lcs_length(a, b) == _lcs_dp(a, b)


def _random_scores(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = [(int(rnd.random() < 0.4), round(rnd.random(), 3)) for _ in range(n)]
    return spark.createDataFrame(rows, "y int, score double"), rows


def test_auc_invariant_under_monotone_rescale(spark):
    df, _ = _random_scores(spark)
    a = C.roc_auc(df).first()[0]
    b = C.roc_auc(df.withColumn("score", F.col("score") * 7.0 + 3.0)).first()[0]
    assert a == pytest.approx(b, abs=1e-12)


def test_auc_matches_pairwise_definition(spark):
    df, rows = _random_scores(spark, 400)
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y != 1]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert C.roc_auc(df).first()[0] == pytest.approx(want, abs=1e-12)


def test_pr_trapezoid_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    df, _ = _random_scores(spark, 2000, 3)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName="areaUnderPR", numBins=0)
    want = ev.evaluate(df.select(F.col("y").cast("double").alias("label"), "score"))
    assert C.pr_auc_trapezoid(df).first()[0] == pytest.approx(want, abs=1e-9)


def test_running_totals_two_level_equals_single_window(spark):
    df, _ = _random_scores(spark)
    h = C.histogram(df)
    one = {r["score"]: (r["cum_pos"], r["cum_neg"]) for r in C.running_totals(h, "score", ["pos", "neg"], True, buckets=1).collect()}
    many = {r["score"]: (r["cum_pos"], r["cum_neg"]) for r in C.running_totals(h, "score", ["pos", "neg"], True, buckets=13).collect()}
    assert one == many


def test_best_threshold_beats_every_grid_value(spark):
    df, rows = _random_scores(spark, 1500, 11)
    best = C.best_threshold(df).first()["f1"]
    for t in [i / 100 for i in range(1, 100)]:
        tp = sum(1 for y, s in rows if y == 1 and s >= t)
        fp = sum(1 for y, s in rows if y != 1 and s >= t)
        fn = sum(1 for y, s in rows if y == 1 and s < t)
        f1 = 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
        assert best >= f1 - 1e-12


@pytest.mark.parametrize("frac", [0.0, 0.2, 0.37, 1.0])
def test_random_split_exact_size(spark, frac):
    df = spark.range(5000).withColumnRenamed("id", "pair_id")
    out = SP.random_split(df, 42, frac, "pair_id", bucket_hex=2, max_bucket_rows=50)
    n_val = out.filter(F.col("split") == "val").count()
    assert n_val == int(frac * 5000 // 1)
    assert out.count() == 5000 and out.select("pair_id").distinct().count() == 5000


def test_random_split_matches_global_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "pair_id")
    out = {r["pair_id"] for r in SP.random_split(df, 7, 0.25, "pair_id").filter("split = 'val'").collect()}
    import hashlib
    order = sorted(range(3000), key=lambda i: (hashlib.md5(f"7-{i}".encode()).hexdigest(), i))
    assert out == set(order[:750])


def test_oneshot_split_one_per_group(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}", None if i % 5 == 0 else "e") for i in range(200)],
                               "pair_id long, topic string, experiment string")
    out = SP.oneshot_split(df, 42, "pair_id")
    picked = out.filter("split = 'train'").groupBy("experiment", "topic").count().collect()
    assert all(r["count"] == 1 for r in picked)
    assert len(picked) == df.select("experiment", "topic").distinct().count()


def test_span_never_exceeds_budget(spark):
    from notecover.functions import text as T
    from notecover.operators import align as AL
    from notecover.plans.q_model import _spans
    for ml in (64, 256):
        sp = _spans(spark, SF_SMALL, margin=0.3, max_length=ml)
        rows = sp.select("span_len", "span_start", AL.token_budget(F.size(T.model_tokens("idea_unit")), ml).alias("b"),
                         F.size(F.split("note_text", " ")).alias("w"), "note_text").collect()
        assert all(r["span_len"] <= r["b"] for r in rows)
        assert all(r["note_text"] == "" or r["w"] == r["span_len"] for r in rows)


@pytest.mark.parametrize("name", ["metrics_by_topic", "roc_auc", "best_threshold", "pr_curve", "random_split",
                                  "idea_order", "one_shot_example", "aligned_span"])
def test_results_equal_under_shuffle_partitions(spark, name):
    import __spark_entry__ as E
    q = E.queries()[name]
    results = []
    try:
        for n in (1, 4, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            results.append(sorted((tuple(r) for r in q(spark, SF_SMALL).collect()), key=repr))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_salted_join_equals_plain_join(spark):
    from notecover.operators.joins import join_small, salted_join
    big = spark.range(2000).selectExpr("id", "concat('t', id % 3) AS topic")
    small = spark.createDataFrame([("t0", 1), ("t0", 2), ("t1", 3)], "topic string, v int")
    want = sorted(tuple(r) for r in big.join(small, "topic", "left").collect())
    got = sorted(tuple(r) for r in salted_join(big, small, ["topic"], "left", buckets=5, salt_from="id").collect())
    assert got == want
    forced = join_small(big, small, ["topic"], "left", buckets=7, salt_from="id", max_rows=1)
    assert sorted(tuple(r) for r in forced.collect()) == want
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(tuple(r) for r in big.join(small, "topic", how).collect())
        for bound in (1, 10_000):                                           # salted, broadcast
            assert sorted(tuple(r) for r in join_small(big, small, ["topic"], how, salt_from="id", max_rows=bound).collect()) == plain
    for how in ("right", "full", "outer"):
        with pytest.raises(ValueError):
            join_small(big, small, ["topic"], how)
        with pytest.raises(ValueError):
            salted_join(big, small, ["topic"], how)


def test_nested_columns_are_never_broadcast(spark):
    from notecover.operators.joins import BROADCAST_MAX_BYTES, measured_size
    nested = spark.range(2).selectExpr("id", "struct(repeat('x', 1000) AS t) AS s")
    assert measured_size(nested)[1] > BROADCAST_MAX_BYTES
    assert measured_size(spark.range(2).selectExpr("cast(repeat('x', 1000) AS binary) AS b"))[1] >= 2000


def test_metrics_with_overall_equals_separate(spark):
    from notecover.operators import metrics as M
    from notecover.sources import fixtures as FX
    s = FX.scored(spark, SF_SMALL)
    both = M.metrics_with_overall(s)
    per = sorted(tuple(r) for r in M.metrics_by_group(s).collect())
    got = sorted(tuple(r[:2]) + tuple(r[3:]) for r in both.filter("NOT is_overall").collect())
    assert got == per
    o = both.filter("is_overall").first()
    m = M.binary_metrics(s).first()
    assert o["n"] == m["n"] and o["f1"] == m["f1"]


def test_seed_runs_equal_single_seed_splits(spark):
    df = spark.range(4000).withColumnRenamed("id", "pair_id")
    multi = {(r["seed"], r["pair_id"]): r["split"] for r in SP.seed_runs(df, [42, 43, 44], 0.2).collect()}
    for s in (42, 43, 44):
        one = {r["pair_id"]: r["split"] for r in SP.random_split(df, s, 0.2).collect()}
        assert all(multi[(s, i)] == one[i] for i in one)
    tiny = SP.seed_runs(df, [1, 2], 0.2, max_bucket_rows=2)        # forces the fallback path
    assert tiny.filter("split = 'val'").groupBy("seed").count().collect()[0]["count"] == 800


def test_bit_parallel_lcs_long_texts_numpy_path():
    rnd = random.Random(4)
    for _ in range(5):
        a = "".join(rnd.choice("ab cdé") for _ in range(rnd.randint(513, 700)))
        b = "".join(rnd.choice("abc dñ") for _ in range(rnd.randint(50, 600)))
        assert lcs_length(a, b) == _lcs_dp(a, b)


def _runs(spark, n=900, seed=5):
    import random
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randint(0, 1), round(rng.random(), 2)) for _ in range(n)]
    rows += [("only_pos", 1, 0.4), ("only_neg", 0, 0.2), ("a", 1, float("nan")), ("a", 0, None)]
    return rows, spark.createDataFrame(rows, "run string, y int, score double")


@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_grouped_totals_equal_each_group_alone(spark, buckets):
    rows, df = _runs(spark)
    h = C.histogram(df, by=["run"])
    got = {(r.run, r.score): (r.cum_pos, r.cum_neg, r.tot_pos, r.tot_neg)
           for r in C.running_totals(h, "score", ["pos", "neg"], True, buckets=buckets, by=["run"]).collect()}
    ok = [(g, y, s) for g, y, s in rows if s is not None and s == s]
    want = {(g, s): (sum(y for h, y, x in ok if h == g and x >= s), sum(1 - y for h, y, x in ok if h == g and x >= s),
                     sum(y for h, y, _ in ok if h == g), sum(1 - y for h, y, _ in ok if h == g)) for g, _, s in ok}
    assert got == want


def test_grouped_metrics_equal_each_run_alone(spark):
    from notecover.operators import record as R
    _, df = _runs(spark)
    df = df.filter("run IS NOT NULL")
    rank = {r.run: r for r in C.ranking_summary(df, by=["run"]).collect()}
    best = {r.run: (r.threshold, r.f1) for r in C.best_threshold(df, by=["run"]).collect()}
    recs = {r.run: r for r in R.run_records(df, ["run"]).collect()}
    assert set(rank) == set(best) == set(recs) == {"a", "b", "c", "only_pos", "only_neg"}
    for run in rank:
        alone = df.filter(F.col("run") == run)
        one = C.ranking_summary(alone).first()
        assert (rank[run].roc_auc, rank[run].average_precision, rank[run].pr_auc) == (one.roc_auc, one.average_precision, one.pr_auc)
        t = C.best_threshold(alone).first()
        assert best[run] == (t.threshold, t.f1)
        rec = next(r for r in R.metric_record(alone).collect())
        assert (recs[run].threshold, recs[run].f1, recs[run].accuracy, recs[run].pr_auc) == (rec.threshold, rec.f1, rec.accuracy, rec.pr_auc)
    assert best["only_neg"] == (0.5, 0.0) and rank["only_pos"].roc_auc is None


def test_totals_do_not_depend_on_partition_settings(spark, monkeypatch):
    _, df = _runs(spark, 3000)
    monkeypatch.setattr(C, "RANGE_ROWS", 10)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("1", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(tuple(r) for r in C.pr_curve(df).collect() if r.threshold is not None) + [tuple(C.ranking_summary(df).first())])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert out[0] == out[1]

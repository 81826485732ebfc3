"""Operators against direct re-computations of the published definitions (numpy / plain Python)."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from notecover.operators import curves as C
from notecover.operators import metrics as M
from notecover.operators import sweep as SW


def _data(spark, n=1500, seed=5, levels=40):
    rnd = random.Random(seed)
    rows = [(int(rnd.random() < 0.35), rnd.randint(0, levels) / levels) for _ in range(n)]
    return spark.createDataFrame(rows, "y int, score double"), rows


def test_histogram_matches_numpy(spark):
    df, rows = _data(spark, 2000, 9, 997)
    want, edges = np.histogram([s for _, s in rows], bins=20)
    got = df.transform(lambda d: C.score_histogram(d, "score", 20)).orderBy("bin").collect()
    assert [r["n"] for r in got] == list(want)
    assert [r["lo"] for r in got] == pytest.approx(list(edges[:-1]))


def test_average_precision_matches_step_definition(spark):
    df, rows = _data(spark)
    P = sum(y for y, _ in rows)
    ap = 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp = sum(1 for y, s in rows if s >= t and y == 1)
        fp = sum(1 for y, s in rows if s >= t and y != 1)
        pos_here = sum(1 for y, s in rows if s == t and y == 1)
        ap += pos_here / P * tp / (tp + fp)
    assert C.average_precision(df).first()[0] == pytest.approx(ap, abs=1e-12)


def test_sweep_matches_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([-1, 0, 1]), round(rnd.random() * 0.2 + 0.5, 3), rnd.random() < 0.1) for _ in range(800)]
    df = spark.createDataFrame(rows, "label int, score double, guard boolean")
    got = {(r["result_1_limit"], r["result_0_limit"]): r["n_correct"] for r in SW.threshold_sweep(df).collect()}
    for h, lo in SW.sweep_grid():
        want = sum((-1 if g else (1 if s > h else 0 if s > lo else -1)) == y for y, s, g in rows)
        assert got[(h, lo)] == want


def test_classification_report_matches_definition(spark):
    rnd = random.Random(1)
    rows = [(rnd.randint(0, 3), rnd.randint(0, 4)) for _ in range(600)]
    df = spark.createDataFrame(rows, "y int, prediction int")
    rep = {r["class"]: r for r in M.classification_report(df).collect()}
    classes = sorted({c for pair in rows for c in pair})
    f1s, sup = [], []
    for c in classes:
        tp = sum(1 for y, p in rows if y == c and p == c)
        pn = sum(1 for _, p in rows if p == c)
        tn = sum(1 for y, _ in rows if y == c)
        prec, rec = (tp / pn if pn else 0.0), (tp / tn if tn else 0.0)
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        assert rep[str(c)]["precision"] == pytest.approx(prec) and rep[str(c)]["f1"] == pytest.approx(f1)
        f1s.append(f1)
        sup.append(tn)
    assert rep["macro avg"]["f1"] == pytest.approx(sum(f1s) / len(f1s))
    assert rep["weighted avg"]["f1"] == pytest.approx(sum(f * s for f, s in zip(f1s, sup)) / sum(sup))
    assert rep["accuracy"]["f1"] == pytest.approx(sum(y == p for y, p in rows) / len(rows))


def _longest_first(la, lb, room):
    while la + lb > room:
        if la > lb:
            la -= 1
        else:
            lb -= 1
    return la, lb


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(1, 260)), min_size=1, max_size=30))
def test_keep_lengths_matches_loop(spark, cases):
    from notecover.operators.prompt import keep_lengths
    df = spark.createDataFrame(cases, "la int, lb int, room int")
    ka, kb = keep_lengths(F.col("la"), F.col("lb"), F.col("room"))
    got = [(r[0], r[1]) for r in df.select(ka, kb).collect()]
    assert got == [_longest_first(*c) for c in cases]


def test_span_bounds_match_formula(spark):
    import math
    from notecover.operators import align as AL
    rnd = random.Random(2)
    cases = [(rnd.randint(1, 12), rnd.randint(0, 11), rnd.choice([0.0, 0.1, 0.3]), rnd.randint(0, 3000),
              rnd.randint(0, 80)) for _ in range(300)]
    cases = [(k, j % k, m, L, nt) for k, j, m, L, nt in cases]
    df = spark.createDataFrame(cases, "k int, j int, m double, L int, nt int")
    out = []
    for m in (0.0, 0.1, 0.3):
        a, b = AL.align_interval(margin=m)
        s, e, t = AL.span_bounds(a, b, F.col("L"), AL.token_budget(F.col("nt"), 256))
        out += [(r["k"], r["j"], m, r["L"], r["nt"], r["s"], r["t"])
                for r in df.filter(F.col("m") == m).withColumn("segment", F.lit(1))
                .select("k", "j", "L", "nt", s.alias("s"), t.alias("t")).collect()]
    for k, j, m, L, nt, s, t in out:
        budget = 256 - nt - 3
        budget = max(256 // 2, 32) if budget <= 32 else budget
        alpha, beta = max(0.0, j / k - m), min(1.0, (j + 1) / k + m)
        start, end = int(math.floor(alpha * L)), int(math.floor(beta * L))
        if end <= start:
            end = min(L, start + budget)
        assert (s, t) == (start, min(len(range(start, end)), budget))

"""Newton's method over Spark aggregates against numpy, and the searches built on it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notecover.operators import curves as C
from notecover.operators import logistic as LG
from notecover.operators import score as SC
from notecover.operators import split as SP

FEATS = ("a", "b")


def _data(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)).round(3)
    y = (rng.random(n) < 1 / (1 + np.exp(-(4 * x[:, 0] - 3 * x[:, 1])))).astype(int)
    return x, y


def _newton(x, y, reg, rounds):
    x = np.c_[np.ones(len(x)), x]
    w, path = np.zeros(x.shape[1]), []
    ridge = np.diag([0.0] + [reg] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
        path.append(w)
    return path


def _frame(spark, x, y, **more):
    rows = [(i, int(t), float(a), float(b)) for i, (t, (a, b)) in enumerate(zip(y, x))]
    df = spark.createDataFrame(rows, "pair_id long, label int, a double, b double").repartition(5)
    for k, v in more.items():
        df = df.withColumn(k, v)
    return df


def test_path_equals_newton_in_numpy_for_every_run(spark):
    x, y = _data()
    df = _frame(spark, x, y, run=F.explode(F.array(F.lit("p"), F.lit("q"), F.lit("half"))))
    df = df.filter("run <> 'half' OR pair_id % 2 = 0")
    extra = spark.createDataFrame([(-1, None, 0.5, 0.5, "p"), (-2, 1, None, 0.5, "p")], df.schema)         # no part in the fit
    paths = LG.fit(df.unionByName(extra), FEATS, {"p": 0.001, "q": 0.5, "half": 0.01, "nobody": 0.1}, rounds=5)
    for run, reg, rows in (("p", 0.001, slice(None)), ("q", 0.5, slice(None)), ("half", 0.01, slice(None, None, 2))):
        assert np.allclose(paths[run].rounds, _newton(x[rows], y[rows], reg, 5), rtol=1e-9, atol=1e-12)
    assert paths["nobody"].last == (0.0, 0.0, 0.0)
    one = LG.fit(df.filter("run = 'q'").repartition(1), FEATS, {"q": 0.5}, rounds=5)["q"]
    assert np.allclose(one.last, paths["q"].last, rtol=1e-10)


def test_perfect_separation_and_one_class_stay_finite(spark):
    x = np.array([[0.0, 0.0], [0.1, 0.0], [0.9, 0.0], [1.0, 0.0]])
    assert np.isfinite(LG.fit(_frame(spark, x, [0, 0, 1, 1], run=F.lit(0)), FEATS, {0: 0.01})[0].last).all()
    assert np.isfinite(LG.fit(_frame(spark, x, [1, 1, 1, 1], run=F.lit(0)), FEATS, {0: 0.01})[0].last).all()


def test_prediction_and_epochs(spark):
    x, y = _data()
    df = _frame(spark, x, y)
    path = SC.train_pair_classifier(df, features=FEATS, rounds=4)
    got = {r.pair_id: (r.prob_1, r.pred_argmax) for r in SC.predict_pairs(df, path).collect()}
    p = 1 / (1 + np.exp(-np.c_[np.ones(len(x)), x] @ np.array(path.last)))
    assert all(abs(got[i][0] - p[i]) < 1e-6 and got[i][1] == int(round(p[i], 6) > 0.5) for i in range(len(x)))
    rows = SC.epoch_search(df, df, rounds=4, features=FEATS).collect()
    assert sorted(r.epoch for r in rows) == [1, 2, 3, 4] and sum(r.best for r in rows) == 1
    assert max(rows, key=lambda r: (round(r.f1, 6), -r.epoch)).best == 1
    for r in rows:                                                          # each epoch as if it were the only one
        alone = LG.score(df.withColumn("run", F.lit(0)), {0: LG.Path(FEATS, path.rounds[:r.epoch])})
        best = C.best_threshold(alone.withColumnRenamed("label", "y"), "y", "prob_1").first()
        assert (r.threshold, r.f1) == (best.threshold, best.f1)


def test_searches_share_their_jobs(spark):
    x, y = _data()
    df = _frame(spark, x, y)
    rows = SC.param_search(df, df, (0.5, 0.001), features=FEATS).collect()
    assert [r.best for r in rows] == [1, 0] and {r.reg_param for r in rows} == {0.5, 0.001}
    for r in rows:
        path = SC.train_pair_classifier(df, reg_param=r.reg_param, features=FEATS)
        best = C.best_threshold(SC.predict_pairs(df, path), "label", "prob_1").first()
        assert (r.threshold, r.f1) == pytest.approx((best.threshold, best.f1))


def test_a_fit_per_seed_sees_only_its_own_rows(spark):
    x, y = _data(300)
    df = _frame(spark, x, y)
    runs = SP.seed_runs(df, (1, 2), 0.2, "pair_id")
    val = SC.seed_fits(runs, (1, 2), features=FEATS)
    for s in (1, 2):
        split = SP.random_split(df, s, 0.2, "pair_id")
        path = SC.train_pair_classifier(split.filter("split = 'train'"), features=FEATS)
        want = {r.pair_id: r.prob_1 for r in SC.predict_pairs(split.filter("split = 'val'"), path).collect()}
        got = {r.pair_id: r.prob_1 for r in val.filter(F.col("seed") == s).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)

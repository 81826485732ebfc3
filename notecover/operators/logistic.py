"""Logistic regression as Spark aggregates (X-4, X-5, X-6).

The objective is the mean log loss plus ``reg / 2`` times the squared coefficients (not the
intercept). A round of Newton's method needs the mean gradient and the mean of the second
derivatives, which for d features are (d + 1)(d + 4) / 2 sums: one aggregate over
the rows with partial sums per task, whatever the number of rows. Several runs (seeds,
regularisation values) share each round's aggregate, grouped by run; the driver holds one
row of sums per run and solves a small linear system. Rounds are fixed, start at zero and
draw nothing at random, so a fit is the same on every cluster, and SQL can follow it.

The coefficients after every round are kept: a round plays the part of an epoch, and all
epochs can be scored in one pass (:func:`score_paths`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
REG = 0.01


@dataclass(frozen=True)
class Path:
    """Coefficients after each round, the intercept first, of one run."""

    features: tuple[str, ...]
    rounds: tuple[tuple[float, ...], ...]

    @property
    def last(self) -> tuple[float, ...]:
        return self.rounds[-1]


def margin(features: Sequence[str], w: Column) -> Column:
    z = w[0]
    for i, f in enumerate(features):
        z = z + w[i + 1] * F.col(f)
    return z


def probability(features: Sequence[str], w: Column | Sequence[float]) -> Column:
    """P(label = 1) under coefficients ``w`` (an array column, or numbers)."""
    if not isinstance(w, Column):
        w = F.array(*[F.lit(float(x)) for x in w])
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(features, w)))


def _weights(df: DataFrame, coef: Mapping, run: str) -> DataFrame:
    """One row per run with its coefficients, small enough to broadcast: runs are a parameter."""
    return df.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in coef.items()],
                                           f"{run} {df.schema[run].dataType.simpleString()}, _w array<double>")


def _with_probability(df: DataFrame, coef: Mapping, features: Sequence[str], run: str, out: str) -> DataFrame:
    """Rows of the runs in ``coef`` with their probability; one run needs no join."""
    if len(coef) == 1:
        (k, w), = coef.items()
        return df.filter(F.col(run) == F.lit(k)).withColumn(out, probability(features, w))
    return df.join(F.broadcast(_weights(df, coef, run)), run).withColumn(out, probability(features, F.col("_w"))).drop("_w")


def fit(df: DataFrame, features: Sequence[str], regs: Mapping, label: str = "label", run: str = "run",
        rounds: int = ROUNDS) -> dict[object, Path]:
    """A path for each run in ``regs`` (run value -> regularisation), from the rows of ``df`` with that
    value in column ``run``. Rows with a null label or feature take no part; a run without
    rows stays at zero."""
    feats = tuple(features)
    d = len(feats) + 1
    rows = df.select(run, F.col(label).cast("double").alias("_y"), *feats).dropna()
    x = [F.lit(1.0)] + [F.col(f) for f in feats]
    r, v = F.col("_p") - F.col("_y"), F.col("_p") * (F.lit(1.0) - F.col("_p"))
    upper = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(r * x[i]).alias(f"g{i}") for i in range(d)],
            *[F.sum(v * x[i] * x[j]).alias(f"h{i}_{j}") for i, j in upper]]
    coef = {k: np.zeros(d) for k in regs}
    paths: dict = {k: [] for k in regs}
    for _ in range(rounds):
        at = _with_probability(rows, {k: w.tolist() for k, w in coef.items()}, feats, run, "_p")
        for s in at.groupBy(run).agg(*sums).collect():                       # one row per run
            k = s[run]
            ridge = np.full(d, float(regs[k]))
            ridge[0] = 0.0
            hess = np.zeros((d, d))
            for i, j in upper:
                hess[i, j] = hess[j, i] = s[f"h{i}_{j}"] / s["n"]
            grad = np.array([s[f"g{i}"] / s["n"] for i in range(d)]) + ridge * coef[k]
            coef[k] = coef[k] - np.linalg.solve(hess + np.diag(ridge), grad)
        for k in regs:
            paths[k].append(tuple(float(c) for c in coef[k]))
    return {k: Path(feats, tuple(p)) for k, p in paths.items()}


def score(df: DataFrame, paths: Mapping[object, Path], run: str = "run", digits: int = 6) -> DataFrame:
    """``df`` with ``prob_1`` of its run's last round, to ``digits`` digits (so that ties in the
    features are ties of the score on every engine)."""
    feats = next(iter(paths.values())).features
    out = _with_probability(df, {k: p.last for k, p in paths.items()}, feats, run, "prob_1")
    return out.withColumn("prob_1", F.round("prob_1", digits))


def score_paths(df: DataFrame, path: Path, digits: int = 6) -> DataFrame:
    """``df`` once per round, with columns ``epoch`` (from 1) and ``prob_1``: all epochs in one pass."""
    epochs = F.array(*[F.struct(F.lit(k + 1).alias("epoch"), F.array(*[F.lit(float(c)) for c in w]).alias("w"))
                       for k, w in enumerate(path.rounds)])
    out = df.withColumn("_e", F.explode(epochs))
    return out.select(*df.columns, F.col("_e.epoch").alias("epoch"),
                      F.round(probability(path.features, F.col("_e.w")), digits).alias("prob_1"))

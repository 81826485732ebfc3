"""Rule scoring: weighted score (F-7), three-way label (F-8), threshold sweep (A-19), best sweep row (W-6).

The sweep never multiplies rows by the grid: every threshold pair's accuracy is a sum of
a few counts of the form #(label = k, not guarded, score > t), so one aggregate over the
scored rows with one ``count_if`` per (label, distinct threshold) yields all of them.
The grid (45 pairs) is then expanded from that single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.functions import text as T


def sweep_grid(high_from: int = 60, high_to: int = 65, low_from: int = 55) -> list[tuple[float, float]]:
    """(high, low) pairs in percent steps: high in [high_from, high_to], low in [low_from, high).

    Built from integers so both engines see identical doubles. Default: 45 pairs.
    """
    return [(h / 100.0, lo / 100.0) for h in range(high_from, high_to + 1) for lo in range(low_from, h)]


def weighted_score(signals: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """F-7: Σ w_i · s_i over the signals with a non-zero weight (zero weights are not planned,
    so an expensive signal such as the UDF-based fuzzy ratio is never computed)."""
    total = None
    for name, w in weights.items():
        if not w:
            continue
        term = F.lit(float(w)) * signals[name] if w != 1 else signals[name]
        total = term if total is None else total + term
    return total if total is not None else F.lit(0.0)


def rule_label(score: Column, guard: Column | None, high: float = 0.60, low: float = 0.59) -> Column:
    """F-8 with the PF-19 guard: guarded rows are -1, else > high -> 1, > low -> 0, else -1."""
    lab = T.three_way_label(score, high, low)
    return lab if guard is None else F.when(guard, F.lit(-1)).otherwise(lab)


def threshold_sweep(df: DataFrame, score: str = "score", label: str = "label", guard: str | None = "guard",
                    grid: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """A-19: accuracy of the three-way label for every (high, low) pair of ``grid``.

    Output columns follow the reference's result table: result_1_limit (high),
    result_0_limit (low), accuracy; plus the counts behind it.
    """
    grid = list(grid or sweep_grid())
    ts = sorted({t for pair in grid for t in pair})
    s, y = F.col(score), F.col(label)
    open_ = ~F.col(guard) if guard else F.lit(True)
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(y == -1).alias("m_all")]
    for i, t in enumerate(ts):
        above = open_ & (s > F.lit(t))
        aggs += [F.count_if((y == 1) & above).alias(f"p{i}"), F.count_if((y == 0) & above).alias(f"z{i}"),
                 F.count_if((y == -1) & above).alias(f"m{i}")]
    one = df.agg(*aggs)
    idx = {t: i for i, t in enumerate(ts)}
    rows = []
    for h, lo in grid:
        hi_i, lo_i = idx[h], idx[lo]
        correct = (F.col(f"p{hi_i}") + (F.col(f"z{lo_i}") - F.col(f"z{hi_i}")) + (F.col("m_all") - F.col(f"m{lo_i}")))
        rows.append(F.struct(F.lit(h).alias("result_1_limit"), F.lit(lo).alias("result_0_limit"),
                             correct.alias("n_correct"), F.col("n").alias("n")))
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    acc = F.when(F.col("n") > 0, F.col("n_correct") / F.col("n")).otherwise(F.lit(0.0))
    return out.select("result_1_limit", "result_0_limit", acc.alias("accuracy"), "n_correct", "n")


def best_sweep(sweep: DataFrame) -> DataFrame:
    """W-6: the first row with the highest accuracy in (high, low) ascending order."""
    return sweep.orderBy(F.col("accuracy").desc(), F.col("result_1_limit").asc(),
                         F.col("result_0_limit").asc()).limit(1)

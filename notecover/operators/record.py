"""A-22: the combined metric record, one row per decision rule (B.6).

'model' uses the model's own labels (argmax of logits, or the fixed cut of a lexical
scorer); 'threshold' uses score >= the best-F1 threshold tuned on the same rows (A-18).
Ranking metrics (ROC AUC, average precision) are shared by both rows. Counters of both
decisions come from one aggregate; the rows are assembled from driver-side scalars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.operators import curves as C
from notecover.operators import metrics as M
from notecover.session import cut_lineage

SCHEMA = ("decision string, n_eval long, accuracy double, precision double, recall double, f1 double, "
          "roc_auc double, pr_auc double, balanced_accuracy double, threshold double")


def _row(name: str, c: dict, auc, ap, t: float):
    n, tp, fp, fn, tn = (c[f"{name}_{k}"] for k in ("n", "tp", "fp", "fn", "tn"))
    acc = (tp + tn) / n if n else 0.0
    prec = tp / (tp + fp) if tp + fp else 0.0
    rec = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
    ba = (tp / (tp + fn) + tn / (tn + fp)) / 2 if (tp + fn) and (tn + fp) else None
    return (name, n, acc, prec, rec, f1, auc, ap, ba, t)


def metric_record(df: DataFrame, y: str = "y", score: str = "score", model_pred: str | None = None) -> DataFrame:
    spark = df.sparkSession
    df = df.persist()            # several one-row aggregates read it; recomputable from lineage
    try:
        t = float(C.best_threshold(df, y, score).first()["threshold"])
        rk = C.ranking_summary(df, y, score).first()
        d = df.withColumn("_pt", (F.col(score) >= F.lit(t)).cast("int"))
        decisions = ([("model", model_pred)] if model_pred else []) + [("threshold", "_pt")]
        cnt = d.agg(*[c for name, p in decisions for c in M.binary_counters(y, p, prefix=f"{name}_")]).first().asDict()
        rows = [_row(name, cnt, rk["roc_auc"], rk["average_precision"], t) for name, _ in decisions]
    finally:
        df.unpersist()
    return spark.createDataFrame(rows, SCHEMA)


METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def run_records(df: DataFrame, by: Sequence[str], y: str = "y", score: str = "score", y_pred: str | None = None) -> DataFrame:
    """The record of every run (``by`` names a seed, an epoch, a setting) in the same jobs:
    (by..., threshold, n, tp, fp, fn, tn, accuracy, precision, recall, f1, roc_auc, pr_auc).

    ``y_pred`` is the runs' own decision (threshold null); without it each run's best-F1
    threshold decides (A-18). pr_auc is the average precision (A-8), as in A-22. The scored
    rows are read from the checkpoint folder; thresholds and ranking metrics are one row a
    run and are joined by broadcast."""
    df = cut_lineage(df.select(*by, F.col(y).alias("y"), F.col(score).alias("score"),
                               *([F.col(y_pred).alias("pred")] if y_pred else [])))
    rank = C.ranking_summary(df, by=by).select(*by, "roc_auc", F.col("average_precision").alias("pr_auc"))
    if y_pred:
        best = df.select(*by).distinct().withColumn("threshold", F.lit(None).cast("double"))
        decided = df
    else:
        best = cut_lineage(C.best_threshold(df, by=by).drop("f1"))
        decided = df.join(F.broadcast(best), list(by)).withColumn("pred", (F.col("score") >= F.col("threshold")).cast("int"))
    counts = decided.groupBy(*by).agg(*M.binary_counters("y", "pred")).select(*by, *M.COUNTER_COLS, *M.metric_columns())
    return best.join(counts, list(by)).join(rank, list(by))


def long_rows(df: DataFrame, section: str, cols: Sequence[str], key: Column | None = None) -> DataFrame:
    """(section, key, value): one row per non-null value of ``cols``; the key is the column's
    name, after ``key`` and a colon where a key is given."""
    name = (lambda c: F.concat(key, F.lit(f":{c}"))) if key is not None else F.lit
    rows = F.array(*[F.struct(name(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.lit(section).alias("section"), F.explode(rows).alias("r")) \
        .select("section", "r.key", "r.value").filter(F.col("value").isNotNull())


def evaluation(df: DataFrame, y: str, y_pred: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Everything that follows from the counts of (label, prediction) per group, in long form:
    input and dropped rows (PF-12), A-1, A-2, A-6, confusion (A-4), report (A-5) and, with
    ``group_cols``, the metrics of each group (A-13, A-14; null groups skipped).

    The rows are read once: the counts (at most four per group, plus those with a missing
    side) are written to the checkpoint folder, and every section is computed from them."""
    counts = cut_lineage(df.groupBy(*group_cols, F.col(y).alias("t"), F.col(y_pred).alias("p"))
                         .agg(F.count(F.lit(1)).alias("n")))
    both = F.col("t").isNotNull() & F.col("p").isNotNull()
    cells = counts.filter(both)

    def total(cond=None):
        return F.coalesce(F.sum(F.when(cond, F.col("n")) if cond is not None else F.col("n")), F.lit(0))

    t, p = F.col("t") == 1, F.col("p") == 1
    counters = [total().alias("n"), total(t & p).alias("tp"), total(~t & p).alias("fp"), total(t & ~p).alias("fn"),
                total(~t & ~p).alias("tn")]
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    balanced = F.when((pos > 0) & (neg > 0), (F.col("tp") / pos + F.col("tn") / neg) / 2).alias("balanced_accuracy")
    names = ["accuracy", "precision", "recall", "f1"]
    overall = cells.agg(*counters).select("*", *M.metric_columns(), balanced)
    report = M.report_of_cells(cells.select("t", "p", "n"))
    parts = [
        long_rows(counts.agg(total().alias("n_in"), total(~both).alias("n_dropped")), "input", ["n_in", "n_dropped"]),
        long_rows(overall, "metrics", ["n", *names, "balanced_accuracy"]),
        long_rows(overall.select(F.col("tn").alias("0->0"), F.col("fp").alias("0->1"), F.col("fn").alias("1->0"),
                                 F.col("tp").alias("1->1")), "confusion", ["0->0", "0->1", "1->0", "1->1"]),
        long_rows(report, "report", ["precision", "recall", "f1", "support"], F.col("class")),
    ]
    if group_cols:
        keep = cells
        for g in group_cols:
            keep = keep.filter(F.col(g).isNotNull())
        groups = keep.groupBy(*group_cols).agg(*counters).select(
            "*", *M.metric_columns(), M.ratio(F.col("tp") + F.col("fn"), "n").alias("pos_prevalence"))
        parts.append(long_rows(groups, "group", ["n", *names, "pos_prevalence"], F.concat_ws("|", *group_cols)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

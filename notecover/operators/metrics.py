"""Classification metrics from integer counters (A-1 ... A-6, A-13 ... A-17, A-20 ... A-22).

Every metric is a ratio of counts produced by one grouped aggregate, so results do not
depend on row order and aggregation is partial (map-side) before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTER_COLS = ("n", "tp", "fp", "fn", "tn")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den, 0 when den is 0 (scikit-learn's zero_division=0)."""
    return F.when(_c(den) > 0, _c(num) / _c(den)).otherwise(F.lit(0.0))


def binary_counters(y="y", y_pred="prediction", positive: int = 1, prefix: str = "") -> list[Column]:
    """n, TP, FP, FN, TN for class ``positive``: positive = (value == positive), one-vs-rest."""
    t, p = _c(y) == positive, _c(y_pred) == positive
    return [F.count(F.lit(1)).alias(prefix + "n"),
            F.count_if(t & p).alias(prefix + "tp"), F.count_if(~t & p).alias(prefix + "fp"),
            F.count_if(t & ~p).alias(prefix + "fn"), F.count_if(~t & ~p).alias(prefix + "tn")]


def metric_columns(correct: Column | None = None) -> list[Column]:
    """accuracy, precision, recall, f1 from counter columns (n, tp, fp, fn, tn).

    ``correct`` overrides the numerator of accuracy (multi-valued labels, A-3)."""
    corr = correct if correct is not None else F.col("tp") + F.col("tn")
    return [ratio(corr, "n").alias("accuracy"),
            ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
            ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
            ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1")]


def binary_metrics(df: DataFrame, y="y", y_pred="prediction", group_cols: Sequence[str] = ()) -> DataFrame:
    """A-1, A-2: accuracy and binary precision / recall / F1 of class 1 (0 when undefined)."""
    agg = df.groupBy(*group_cols).agg(*binary_counters(y, y_pred))
    return agg.select(*group_cols, *COUNTER_COLS, *metric_columns())


def ovr_metrics(df: DataFrame, y="label", y_pred="prediction") -> DataFrame:
    """A-3: labels 1/0/-1; accuracy over all labels, P/R/F1 with positive = 1, rest negative."""
    agg = df.agg(*binary_counters(y, y_pred),
                 F.count_if(_c(y) == _c(y_pred)).alias("correct"))
    return agg.select("n", "correct", "tp", "fp", "fn", *metric_columns(F.col("correct")))


def confusion_long(df: DataFrame, y="y", y_pred="prediction", labels: Sequence[int] | None = (0, 1)) -> DataFrame:
    """A-4: (y_true, y_pred, n) with every cell of the label grid, zero cells included.

    ``labels`` fixes the grid (the classifier's [0, 1]); ``None`` uses the labels observed
    in either column. The observed label set is gathered by one aggregate (its size is the
    number of classes) and expanded with ``explode``, so no cross join is planned.
    """
    counts = df.groupBy(_c(y).alias("y_true"), _c(y_pred).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))
    if labels is not None:
        grid_arr = F.array(*[F.lit(int(v)) for v in labels])
        one = df.sparkSession.range(1).select(grid_arr.alias("cs"))
    else:
        one = df.select(F.array_union(F.array(_c(y)), F.array(_c(y_pred))).alias("a")) \
            .agg(F.array_sort(F.array_compact(F.array_distinct(F.flatten(F.collect_set("a"))))).alias("cs"))
    grid = one.select(F.explode("cs").alias("y_true"), "cs") \
        .select("y_true", F.explode("cs").alias("y_pred"))
    # both sides hold at most (number of classes)^2 rows; Spark's own size estimate picks the join
    out = grid.join(counts, ["y_true", "y_pred"], "left")
    return out.select("y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, y="y", y_pred="prediction") -> DataFrame:
    """A-5: per class precision / recall / f1 / support, then accuracy, macro avg, weighted avg.

    Long form: (class, precision, recall, f1, support). The accuracy row carries the
    accuracy in ``f1`` (as in the text report) and null precision / recall.
    """
    return report_of_cells(df.groupBy(_c(y).alias("t"), _c(y_pred).alias("p")).agg(F.count(F.lit(1)).alias("n")))


def report_of_cells(cells: DataFrame) -> DataFrame:
    """A-5 from a table of counts (t, p, n); several rows per (t, p) add up."""
    true_side = cells.groupBy(F.col("t").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = cells.groupBy(F.col("p").alias("cls")).agg(F.sum("n").alias("pred_n"))
    per = true_side.join(pred_side, "cls", "full").select(
        "cls", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("tp", F.lit(0)).alias("tp"),
        F.coalesce("pred_n", F.lit(0)).alias("pred_n"))
    per = per.select(
        F.col("cls").cast("string").alias("class"),
        ratio("tp", "pred_n").alias("precision"), ratio("tp", "support").alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("pred_n")).alias("f1"),
        F.col("support").cast("long").alias("support"), F.col("tp"))
    summary = per.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        F.sum("support").alias("tot"), F.sum("tp").alias("correct"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("recall") * F.col("support")).alias("wr"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"))
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), ratio("correct", "tot").alias("f1"),
                 F.col("tot").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("tot").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), ratio("wp", "tot").alias("precision"),
                 ratio("wr", "tot").alias("recall"), ratio("wf", "tot").alias("f1"),
                 F.col("tot").cast("long").alias("support")),
    )).alias("r")).select("r.*")
    return per.drop("tp").unionByName(rows)


def balanced_accuracy(df: DataFrame, y="y", y_pred="prediction") -> DataFrame:
    """A-6 (binary): mean of TPR and TNR; null when a class is absent from y."""
    c = df.agg(*binary_counters(y, y_pred))
    pos, neg = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    ba = F.when((pos > 0) & (neg > 0), (F.col("tp") / pos + F.col("tn") / neg) / 2)
    return c.select("n", "tp", "fp", "fn", "tn", ba.alias("balanced_accuracy"))


def metrics_by_group(df: DataFrame, y="y", y_pred="prediction",
                     group_cols: Sequence[str] = ("experiment", "topic")) -> DataFrame:
    """A-13, A-14, J-6: per group n, accuracy, P, R, F1 and positive prevalence.

    Groups with a null key are skipped (pandas groupby). A missing experiment column is
    reported as 'UNK'. Partial aggregation runs before the shuffle, so a hot group costs
    one partial row per input partition.
    """
    gcols = list(group_cols)
    if "experiment" in gcols and "experiment" not in df.columns:
        df = df.withColumn("experiment", F.lit("UNK"))
    keep = df
    for g in gcols:
        keep = keep.filter(F.col(g).isNotNull())
    agg = keep.groupBy(*gcols).agg(*binary_counters(y, y_pred), F.avg(_c(y).cast("double")).alias("pos_prevalence"))
    return agg.select(*gcols, "n", *metric_columns(), "pos_prevalence")


def metrics_with_overall(df: DataFrame, y="y", y_pred="prediction",
                         group_cols: Sequence[str] = ("experiment", "topic")) -> DataFrame:
    """Overall and per-group metrics in one pass: GROUPING SETS ((), (groups)).

    ``is_overall`` marks the overall row (its group columns are null); null group keys
    are skipped as in :func:`metrics_by_group`."""
    gcols = list(group_cols)
    keep = df
    for g in gcols:
        keep = keep.filter(F.col(g).isNotNull())
    agg = keep.groupingSets([[], gcols], *gcols).agg(
        *binary_counters(y, y_pred), F.avg(_c(y).cast("double")).alias("pos_prevalence"),
        F.grouping_id().alias("_gid"))
    return agg.select(*gcols, (F.col("_gid") != 0).alias("is_overall"), "n", *metric_columns(), "pos_prevalence")


def class_balance(df: DataFrame, y="label") -> DataFrame:
    """A-15: positives, negatives and prevalence of a labelled table."""
    return df.agg(F.count_if(_c(y) == 1).alias("pos"), F.count_if(_c(y) == 0).alias("neg"),
                  F.count(F.lit(1)).alias("n")) \
        .select("pos", "neg", "n", ratio("pos", "n").alias("prevalence"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """A-16: counts per value, null kept as its own group."""
    return df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def text_lengths(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-21: mean length per text column (nulls skipped), long form."""
    agg = df.agg(*[F.avg(F.length(c)).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mean_length"))
                                          for c in cols])).alias("r")).select("r.*")


def seed_summary(long_metrics: DataFrame, metric_col="metric", value_col="value") -> DataFrame:
    """A-20: mean, population std, min, max and n per metric over runs; NaN skipped."""
    v = F.nanvl(F.col(value_col).cast("double"), F.lit(None).cast("double"))
    x = long_metrics.select(F.col(metric_col).alias("metric"), v.alias("v"))
    return x.groupBy("metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                   F.min("v").alias("min"), F.max("v").alias("max"),
                                   F.count("v").alias("n"))


def unpivot_metrics(df: DataFrame, id_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(id_cols), list(metric_cols), "metric", "value")

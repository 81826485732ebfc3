"""Score-ranking metrics on a score histogram (A-7 ... A-12, A-18, U-2, W-7).

All curve metrics first reduce the scored rows to one row per distinct score
(score, pos, neg) with a partial aggregate, and then need running totals over the scores
in order (:func:`running_totals`). A histogram counted small is one window. A larger one is
cut into score ranges at the quantiles of a mergeable sketch: each range is summed in its
own task and offset by the totals of the ranges before it, so no task sees all scores.

Every function takes ``by``, columns that name a group (a seed, an epoch, a run): the
histogram, the totals and the result are then per group, for all groups in the same jobs.
The number of ranges follows from the number of distinct scores alone, and counts are
integers, so results do not depend on the session's partition settings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notecover.session import cut_lineage

GRID = tuple(i / 100.0 for i in range(1, 100))   # 0.01 ... 0.99, built from integers

RANGE_ROWS = 200_000          # distinct scores summed by one window
MAX_RANGES = 4096             # bounds held by the driver


def valid_scores(df: DataFrame, score="score") -> DataFrame:
    """PF-22: rows that carry a score (not null, not NaN)."""
    s = F.col(score)
    return df.filter(s.isNotNull() & ~F.isnan(s))


def histogram(df: DataFrame, y="y", score="score", by: Sequence[str] = ()) -> DataFrame:
    """(by..., score, pos, neg): one row per distinct valid score; y = 1 is positive.

    Rows without a valid score are dropped after the aggregate (by an aggregated flag),
    not by a filter before it: a filter on a computed score would be pushed below the
    projection and re-evaluate the score expression inside the filter."""
    s = F.col(score)
    ok = s.isNotNull() & ~F.isnan(s)
    h = df.groupBy(*by, s.alias("score")).agg(
        F.count_if(ok & (F.col(y) == 1)).alias("pos"), F.count_if(ok & (F.col(y) != 1)).alias("neg"),
        F.max(ok.cast("int")).alias("_ok"))
    return h.filter(F.col("_ok") == 1).drop("_ok")


def _with_bucket(df: DataFrame, key: str, bounds: list[float], out: str) -> DataFrame:
    """Range bucket of ``key`` by sorted ``bounds`` (binary search in the JVM via Bucketizer)."""
    if not bounds:
        return df.withColumn(out, F.lit(0))
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf")] + bounds + [float("inf")]
    b = Bucketizer(splits=splits, inputCol=key, outputCol=out, handleInvalid="keep")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def _bounds(h: DataFrame, buckets: int | None) -> list[float]:
    """Quantiles of the ordering key that cut ``h`` into ranges: at most MAX_RANGES - 1 numbers."""
    if buckets == 1:
        return []
    n, sketch = h.agg(F.count("_ok"), F.kll_sketch_agg_double("_ok")).first()
    buckets = buckets or min(MAX_RANGES, -(-n // RANGE_ROWS))
    if buckets <= 1 or not n:
        return []
    ranks = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    at = h.sparkSession.range(1).select(F.kll_sketch_get_quantile_double(F.lit(bytearray(sketch)), ranks)).first()[0]
    return sorted(set(at))


def running_totals(h: DataFrame, key: str, cols: Sequence[str], descending: bool = False,
                   buckets: int | None = None, inclusive: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over all rows of the group ordered before (and, if inclusive,
    at) ``key``, and ``tot_<c>`` = the group's total of ``c``.

    ``key`` must be unique per group (a histogram). The histogram is written to the
    checkpoint folder once: its size and sketch, the offsets and the totals read it there,
    so the bounds of the ranges are constants of the plan and a recomputed task sums the
    same ranges. Groups share the bounds; a group's rows in a range are one window."""
    okey = (-F.col(key)) if descending else F.col(key)
    h = cut_lineage(h.withColumn("_ok", okey.cast("double")))
    end = Window.currentRow if inclusive else -1
    bounds = _bounds(h, buckets)
    if not bounds:                                       # counted small
        ordered = Window.partitionBy(*by).orderBy("_ok").rowsBetween(Window.unboundedPreceding, end)
        whole = Window.partitionBy(*by)
        return h.select("*", *[F.coalesce(F.sum(c).over(ordered), F.lit(0)).alias(f"cum_{c}") for c in cols],
                        *[F.sum(c).over(whole).alias(f"tot_{c}") for c in cols]).drop("_ok")
    hb = _with_bucket(h, "_ok", bounds, "_b")
    totals = hb.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols],
                            *[F.sum(f"_t_{c}").over(Window.partitionBy(*by)).alias(f"tot_{c}") for c in cols])
    if by:                                               # null-safe: a group may be null
        offsets = offsets.withColumnsRenamed({c: f"_g_{c}" for c in (*by, "_b")})
        same = F.col("_b") == F.col("_g__b")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        out = hb.join(offsets, same).drop(*[f"_g_{c}" for c in (*by, "_b")])
    else:
        out = hb.join(F.broadcast(offsets), "_b")        # a row per range
    win = Window.partitionBy(*by, "_b").orderBy("_ok").rowsBetween(Window.unboundedPreceding, end)
    for c in cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(win), F.lit(0)))
    return out.drop("_b", "_ok", *[f"_o_{c}" for c in cols])


def cumulative_desc(df: DataFrame, y="y", score="score", extra_thresholds: Sequence[float] = (), by: Sequence[str] = ()) -> DataFrame:
    """Histogram with cum_pos / cum_neg = counts with score >= this score (threshold view), and the
    totals P and N.

    ``extra_thresholds`` adds zero-count candidate rows (U-2: grid and distinct scores)."""
    h = histogram(df, y, score, by)
    if extra_thresholds:
        h = cut_lineage(h) if by else h                  # read for its groups and its rows
        groups = h.select(*by).distinct() if by else h.sparkSession.range(1).select()
        grid = groups.select(*by, F.explode(F.array(*[F.lit(float(t)) for t in extra_thresholds])).alias("score"),
                             F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
        h = h.unionByName(grid).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_totals(h, "score", ["pos", "neg"], descending=True, by=by) \
        .withColumnRenamed("tot_pos", "P").withColumnRenamed("tot_neg", "N")


def _ranking(cum: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A-7, A-8 and A-9 of each group from its running totals, with P and N."""
    cp, cn, pos, neg = (F.col(c) for c in ("cum_pos", "cum_neg", "pos", "neg"))
    prec = cp / (cp + cn)
    pp, pn = cp - pos, cn - neg                          # the point before: the next higher score
    prev_prec = F.when(pp + pn > 0, pp / (pp + pn)).otherwise(F.lit(1.0))
    agg = cum.groupBy(*by).agg(F.sum(pos * (F.col("N") - cn + neg / 2.0)).alias("s_auc"), F.sum(pos * prec).alias("s_ap"),
                               F.sum(pos * (prec + prev_prec) / 2.0).alias("s_pr"),
                               F.first("P").alias("P"), F.first("N").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return agg.select(*by, F.when(both, F.col("s_auc") / (F.col("P") * F.col("N"))).alias("roc_auc"),
                      F.when(F.col("P") > 0, F.col("s_ap") / F.col("P")).alias("average_precision"),
                      F.when(F.col("P") > 0, F.col("s_pr") / F.col("P")).alias("pr_auc"), "P", "N")


def ranking_summary(df: DataFrame, y="y", score="score", by: Sequence[str] = (), cum: DataFrame | None = None) -> DataFrame:
    """A-7, A-8, A-9 from one histogram and one running total: roc_auc, average_precision,
    pr_auc (trapezoid), P, N in one row (a row per group). Like the curves below it takes
    ``cum``, totals of :func:`cumulative_desc` that several results share."""
    return _ranking(cum if cum is not None else cumulative_desc(df, y, score, by=by), by)


def roc_auc(df: DataFrame, y="y", score="score", by: Sequence[str] = (), cum: DataFrame | None = None) -> DataFrame:
    """A-7: Σ pos·(neg strictly below + neg/2) / (P·N); null if a class is missing."""
    return ranking_summary(df, y, score, by, cum).select(*by, "roc_auc")


def average_precision(df: DataFrame, y="y", score="score", by: Sequence[str] = (), cum: DataFrame | None = None) -> DataFrame:
    """A-8: Σ (R_n - R_{n-1}) P_n over distinct scores in decreasing order."""
    return ranking_summary(df, y, score, by, cum).select(*by, "average_precision")


def pr_auc_trapezoid(df: DataFrame, y="y", score="score", by: Sequence[str] = (), cum: DataFrame | None = None) -> DataFrame:
    """A-9: trapezoid area under the PR points, starting at (R=0, P=1). Each point's left
    neighbour (the next higher score) is its own running total without its counts, so no
    global ``lag`` over all scores is needed."""
    return ranking_summary(df, y, score, by, cum).select(*by, "pr_auc")


def pr_curve(df: DataFrame, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """A-10: (threshold, precision, recall) per distinct score, plus the end point (P=1, R=0)."""
    c = cum if cum is not None else cumulative_desc(df, y, score)
    pts = c.select(F.col("score").alias("threshold"),
                   (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                   F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def roc_curve(df: DataFrame, y="y", score="score", cum: DataFrame | None = None) -> DataFrame:
    """A-11: (threshold, fpr, tpr) per distinct score, plus the origin (threshold null)."""
    c = cum if cum is not None else cumulative_desc(df, y, score)
    pts = c.select(F.col("score").alias("threshold"),
                   F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
                   F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def score_histogram(df: DataFrame, score="score", bins: int = 20) -> DataFrame:
    """A-12: ``bins`` equal-width bins over [min, max], last bin closed, empty bins kept.

    min and max are two driver-side scalars from one aggregate. Constant scores use the
    range [v - 0.5, v + 0.5] like numpy.
    """
    s = F.col(score)
    ok = s.isNotNull() & ~F.isnan(s)
    mm = df.agg(F.min(F.when(ok, s)).alias("mn"), F.max(F.when(ok, s)).alias("mx")).first()
    spark = df.sparkSession
    if mm["mn"] is None:
        return spark.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(None).cast("double").alias("lo"),
                                        F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("n"))
    mn, mx = float(mm["mn"]), float(mm["mx"])
    if mn == mx:
        mn, mx = mn - 0.5, mx + 0.5
    b = F.when(ok, F.least(F.floor((s - F.lit(mn)) * F.lit(float(bins)) / F.lit(mx - mn)),
                           F.lit(bins - 1)).cast("int"))
    counts = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))   # invalid rows: null bin, dropped below
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = F.broadcast(all_bins).join(counts, "bin", "left")
    w = F.lit(mx - mn) / F.lit(float(bins))
    return out.select("bin", (F.lit(mn) + F.col("bin") * w).alias("lo"),
                      (F.lit(mn) + (F.col("bin") + 1) * w).alias("hi"),
                      F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def threshold_table(df: DataFrame, y="y", score="score", grid: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """U-2 + A-18 inputs: every candidate threshold with TP, FP, FN and F1 of (score >= t)."""
    c = cumulative_desc(df, y, score, extra_thresholds=grid, by=by)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    fn = F.col("P") - tp
    den = 2 * tp + fp + fn
    f1 = F.when(den > 0, 2 * tp / den).otherwise(F.lit(0.0))
    return c.select(*by, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), f1.alias("f1"))


def best_threshold(df: DataFrame, y="y", score="score", grid: Sequence[float] = GRID, by: Sequence[str] = ()) -> DataFrame:
    """A-18: the lowest candidate t with the highest F1 of (score >= t); (0.5, 0.0) if no F1 > 0.
    One aggregate, no sort; with ``by`` a row per group."""
    t = threshold_table(df, y, score, grid, by)
    best = t.groupBy(*by).agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("b"))
    some = F.col("b.f1") > 0
    return best.select(*by, F.when(some, -F.col("b.t")).otherwise(F.lit(0.5)).alias("threshold"),
                       F.when(some, F.col("b.f1")).otherwise(F.lit(0.0)).alias("f1"))

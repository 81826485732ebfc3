"""Reproducible splits (W-4 one-shot, W-5 exact random, J-9 held-out, X-5 seed runs).

Randomness is a hash: the order of a row is md5(seed || '-' || id), then id. The same
order is available to SQL engines, and it does not depend on partitioning or task order,
so a recomputed partition after an executor loss lands in the same split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecover.operators.joins import broadcast_if_bounded
from notecover.session import cut_lineage


def hash_order(seed: int, id_col: str = "id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def pick_group_cols(df: DataFrame) -> list[str]:
    if "experiment" in df.columns and "topic" in df.columns:
        return ["experiment", "topic"]
    if "topic" in df.columns:
        return ["topic"]
    raise ValueError(f"no grouping columns in {df.columns}")


def oneshot_split(df: DataFrame, seed: int = 42, id_col: str = "pair_id",
                  group_cols: Sequence[str] | None = None) -> DataFrame:
    """W-4 + J-9: one pseudo-random row per group goes to 'train', the rest to 'heldout'.

    One ``min_by`` aggregate per group (skew-safe partial aggregation) picks the row;
    the picked ids (one per group, materialised once in the checkpoint folder) are joined
    back; null keys form their own group."""
    g = list(group_cols or pick_group_cols(df))
    picked = df.groupBy(*g).agg(F.min_by(F.col(id_col), F.struct(hash_order(seed, id_col), F.col(id_col)))
                                .alias("_pick"))
    picked = broadcast_if_bounded(cut_lineage(picked.select(F.col("_pick").alias(id_col), F.lit(True).alias("_is_pick"))))
    out = df.join(picked, id_col, "left")
    return out.withColumn("split", F.when(F.col("_is_pick"), F.lit("train")).otherwise(F.lit("heldout"))) \
        .drop("_is_pick")


def random_split(df: DataFrame, seed: int = 42, val_frac: float = 0.2, id_col: str = "pair_id",
                 bucket_hex: int = 4, max_bucket_rows: int = 1_000_000, cache_keys: bool = True) -> DataFrame:
    """W-5: exactly floor(val_frac * n) rows, the first in (md5(seed-id), id) order, are 'val'.

    No global sort: :func:`_cut_keys` finds the last 'val' row, and the split is then a
    pure expression of (hash, id), so the input is not joined back. ``id_col`` must
    identify rows uniquely.

    The counting passes read only (id, hash): with ``cache_keys`` these ~40-byte keys are
    cached once (worth it when ``df`` is derived by joins); without it each pass recomputes
    the column-pruned lineage of the id (cheaper when ``df`` is a plain scan).
    """
    h = hash_order(seed, id_col)
    keys = df.select(F.lit(seed).alias("seed"), F.col(id_col).alias("_id"), h.alias("_h"))
    if cache_keys:
        keys = keys.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        hk, ik = _cut_keys(keys, [seed], val_frac, bucket_hex, max_bucket_rows)[seed]
    finally:
        if cache_keys:
            keys.unpersist()
    if ik is None:
        return df.withColumn("split", F.lit("val" if hk else "train"))
    is_val = (h < F.lit(hk)) | ((h == F.lit(hk)) & (F.col(id_col) <= F.lit(ik)))
    return df.withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("train")))


def _cut_keys(keys: DataFrame, seeds: Sequence[int], val_frac: float, width: int, max_rows: int) -> dict:
    """(hash, id) of the last 'val' row per seed; ("", None): no row is 'val', ("~", None): all are.

    ``keys`` has (seed, _id, _h). Rows are counted per hash prefix of ``width`` characters;
    a running count per seed (a window over at most 16**width prefixes) gives n and the
    prefix that holds the cut. While some seed's prefix holds more than ``max_rows`` rows,
    the prefixes of all such seeds grow by two characters in one further job. Only the
    rows below the final prefixes are ranked. The driver holds one row per seed."""
    out, cut, open_seeds = {}, {}, {s: ("", 0, None) for s in seeds}       # prefix, rows before it, k
    ws = Window.partitionBy("seed")
    while open_seeds:
        scope = keys.filter(_any_prefix({s: p for s, (p, _, _) in open_seeds.items()}))
        counts = scope.groupBy("seed", F.substring("_h", 1, width).alias("_b")).agg(F.count(F.lit(1)).alias("c"))
        total = F.sum("c").over(ws)
        known = {s: k for s, (_, _, k) in open_seeds.items() if k is not None}
        k = (_per_seed({s: v - open_seeds[s][1] for s, v in known.items()}) if known
             else F.floor(F.lit(float(val_frac)) * total).cast("long"))
        running = counts.withColumn("cum", F.sum("c").over(ws.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))) \
            .withColumn("_n", total).withColumn("_k", k)
        first = running.filter(F.col("cum") >= F.greatest(F.col("_k"), F.lit(1))) \
            .withColumn("_r", F.row_number().over(ws.orderBy("_b"))).filter(F.col("_r") == 1)
        found = {r["seed"]: r for r in first.collect()}                    # one row per seed
        for s, (_, before, k0) in list(open_seeds.items()):
            r = found.get(s)
            if k0 is None and (r is None or r["_k"] <= 0 or r["_k"] >= r["_n"]):
                out[s] = ("~" if r is not None and r["_k"] >= r["_n"] > 0 else "", None)
                del open_seeds[s]
                continue
            k_all = r["_k"] if k0 is None else k0
            before += r["cum"] - r["c"]
            open_seeds[s] = (r["_b"], before, k_all)
            if r["c"] <= max_rows or width >= 32:
                cut[s] = (r["_b"], k_all - before)
                del open_seeds[s]
        width = min(32, width + 2)
    if cut:
        inside = keys.filter(_any_prefix({s: p for s, (p, _) in cut.items()})) \
            .withColumn("_rn", F.row_number().over(ws.orderBy("_h", "_id")))
        for r in inside.filter(F.col("_rn") == _per_seed({s: n for s, (_, n) in cut.items()})).collect():
            out[r["seed"]] = (r["_h"], r["_id"])
    return out


def _any_prefix(prefixes: dict) -> Column:
    cond = F.lit(False)
    for s, p in prefixes.items():
        cond = cond | ((F.col("seed") == s) & F.col("_h").startswith(p))
    return cond


def _per_seed(values: dict) -> Column:
    return F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v).cast("long"))])[F.col("seed")]


def held_out(df: DataFrame, picked: DataFrame, id_col: str = "pair_id") -> DataFrame:
    """J-9: all rows minus the picked ones, by key (left anti join)."""
    return df.join(picked.select(id_col), id_col, "left_anti")


def seed_runs(df: DataFrame, seeds: Sequence[int], val_frac: float = 0.2, id_col: str = "pair_id",
              bucket_hex: int = 4, max_bucket_rows: int = 1_000_000) -> DataFrame:
    """X-5: the exact random split (W-5) for every seed at once, stacked with a ``seed`` column.

    Rows are exploded over the seeds; the cuts of all seeds are found in the same jobs
    (:func:`_cut_keys`), and the split is one predicate per row against a broadcast table
    of cut keys with one row per seed."""
    seeds = [int(s) for s in seeds]
    x = df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    h = F.md5(F.concat(F.col("seed").cast("string"), F.lit("-"), F.col(id_col).cast("string")))
    keys = x.select("seed", F.col(id_col).alias("_id"), h.alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        cuts = _cut_keys(keys, seeds, val_frac, bucket_hex, max_bucket_rows)
    finally:
        keys.unpersist()
    schema = T.StructType([T.StructField("seed", T.IntegerType()), T.StructField("_hk", T.StringType()),
                           T.StructField("_ik", df.schema[id_col].dataType)])
    cut_table = df.sparkSession.createDataFrame([(s, *cuts[s]) for s in seeds], schema)      # one row per seed
    is_val = (h < F.col("_hk")) | ((h == F.col("_hk")) & (F.col(id_col) <= F.col("_ik")))
    return x.join(F.broadcast(cut_table), "seed") \
        .withColumn("split", F.when(is_val, F.lit("val")).otherwise(F.lit("train"))) \
        .select(*df.columns, "split", "seed")

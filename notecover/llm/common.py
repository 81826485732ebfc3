"""Shared helpers of the corpus operators: table access, lineage cuts, components."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.session import checkpoint_dir, cut_lineage, ship_package
from notecover.sources.tables import table

__all__ = ["arrow_groups", "arrow_map", "components", "cut_lineage", "give_back", "in_bitmap", "mark_bitmap", "only", "ship_package", "stored", "table"]


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns with fixed types; all others (also such with clashing names that
    differ in case only) are dropped. A missing column raises."""
    out = []
    for name, kind in columns.items():
        hit = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
        if not hit:
            raise ValueError(f"column {name!r} is missing; there are {df.columns}")
        out.append(F.col(f"`{hit[0]}`").cast(kind).alias(name))
    return df.select(*out)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def give_back() -> None:
    """Hand freed memory back to the system: workers stay alive between tasks, the driver between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def _mapped(fn):
    def run(batches):
        yield from fn(batches)
        give_back()
    return run


def _grouped(fn):
    def run(table):
        out = fn(table)
        give_back()
        return out
    return run


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_mapped(fn), schema)


def arrow_groups(df: DataFrame, keys: list[str], fn, schema) -> DataFrame:
    """``applyInArrow`` of each group with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInArrow(_grouped(fn), schema)


BITMAP_BITS = 1 << 24
_BUCKET_BITS = 4096 * 8


def mark_bitmap(df: DataFrame, key: str, wanted: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """``df`` with a boolean ``_maybe``: false where ``key`` surely does not occur in
    ``wanted[key]``.

    A bitmap over hashed keys, at most ``bits / 8`` bytes (2 MB) whatever the tables, is
    broadcast, so that a large ``df`` is thinned out before it is shuffled for the exact
    join that has to follow."""
    def pos():                                       # from 1, as the bitmap functions count
        return F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + F.lit(1)

    maps = (wanted.select(pos().alias("_p"))
            .groupBy(F.bitmap_bucket_number("_p").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_map")))
    bit = F.bitmap_bit_position(pos())
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (df.withColumn("_bucket", F.bitmap_bucket_number(pos()))
            .join(F.broadcast(maps), "_bucket", "left")
            .withColumn("_maybe", F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False)))
            .drop("_bucket", "_map"))


def in_bitmap(df: DataFrame, key: str, wanted: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may occur in ``wanted[key]`` (no false negatives)."""
    return mark_bitmap(df, key, wanted, bits).filter("_maybe").drop("_maybe")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): rows (node, root), root = the least
    node of the component; nodes without an edge to another node are absent.

    Alternating large-star and small-star steps: every node keeps an edge to the least of
    its neighbours, until all edges point at the roots. Each step groups with partial
    sums (a least value per node, never a list), so a node with very many neighbours costs
    one row per task. Each round is checkpointed to the shared folder; no link or
    component passes the driver, only two counts a round."""
    e = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, n = cut_lineage(e), None
    for _ in range(max_rounds):
        # done when every node either points at one root or is one
        ends = (e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("to"))
                .unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("to")))
                .groupBy("node").agg(F.sum("out").alias("out"), F.max("to").alias("to")))
        n, open_ = ends.agg(F.coalesce(F.sum("out"), F.lit(0)), F.count_if((F.col("out") > 1) | (F.col("out") + F.col("to") > 1))).first()
        if not open_:
            break
        # large star: each larger neighbour of u goes to the least of u's neighbourhood
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        # small star: each smaller neighbour of u, and u, goes to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = (big.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        e = cut_lineage(small.coalesce(max(1, n // 50_000)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

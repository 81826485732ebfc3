"""Sharding by sampled splitters (operator 9), in DataFrame functions only.

Records are ordered by (hash of the text, hash of the id). A size-weighted sample of these
keys gives quantile boundaries of many small ranges; ranges that turn out overfull are
sampled again and subdivided. Running sizes inside the ranges and the sizes of the ranges
before them place every record on the line from 0 to the total size, and equal stretches of
that line are the shards. So shard sizes differ by about one record, equal texts lie next
to each other, and a text that is a third of all rows is cut between ids, not kept in one
task.

The law that holds is ``bytes``. Defined cases: a null text has the size of none and the
checksum of an empty one; rows with null ids and repeated rows are records of their own;
records of equal key are in any order (equal rows then); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notecover.llm import common as C


@dataclass(frozen=True)
class Sharding:
    shards: int = 24
    overhead: int = 8
    ranges_per_shard: int = 32
    rows_per_range: int = 500_000
    sample_per_range: int = 8
    overfull: float = 2.0
    rounds: int = 3


def records(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    d = C.only(docs, doc_id="bigint", text="string")
    text = F.coalesce("text", F.lit(""))
    return d.select("doc_id", (F.octet_length(text).cast("long") + p.overhead).alias("size"), F.crc32(text).alias("text_crc32"),
                    F.xxhash64(text).alias("k1"), F.xxhash64("doc_id", F.lit(9)).alias("k2"))


def _sample(rec: DataFrame, each: float, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with probability size / each (at most 1) and the size each stands for."""
    u = F.pmod(F.xxhash64("k1", "k2", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    got = (rec.groupBy("k1", "k2").agg(F.sum("size").alias("size")).filter(u < F.col("size") / each)
           .select("k1", "k2", F.greatest(F.col("size").cast("double"), F.lit(float(each))).alias("w")).collect())
    return sorted((r.k1, r.k2, r.w) for r in got)


def _quantiles(sample: list[tuple[int, int, float]], step: float) -> list[tuple[int, int]]:
    """Boundaries after every ``step`` of weight."""
    out, full = [], 0.0
    for k1, k2, w in sample:
        if full >= step:
            out.append((k1, k2))
            full -= step * int(full / step)
        full += w
    return out


_CELL = 52      # keys are looked up by their top 12 bits


def _ranges(rec: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """``rec`` with its range. The boundaries, a bounded table, are broadcast by cells of k1."""
    low = [(-(1 << 63), -(1 << 63)), *cuts]
    rows = []
    for i, (a1, a2) in enumerate(low):
        b1, b2 = low[i + 1] if i + 1 < len(low) else (None, None)
        last = (b1 >> _CELL) if b1 is not None else (1 << 11) - 1
        rows += [(cell, i, a1, a2, b1, b2) for cell in range(a1 >> _CELL, last + 1)]
    side = rec.sparkSession.createDataFrame(rows, "cell bigint, range int, a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    above = (F.col("k1") > F.col("a1")) | ((F.col("k1") == F.col("a1")) & (F.col("k2") >= F.col("a2")))
    below = F.col("b1").isNull() | (F.col("k1") < F.col("b1")) | ((F.col("k1") == F.col("b1")) & (F.col("k2") < F.col("b2")))
    return (rec.withColumn("cell", F.shiftright("k1", _CELL)).join(F.broadcast(side), "cell").filter(above & below)
            .drop("cell", "a1", "a2", "b1", "b2"))


def shard(docs: DataFrame, p: Sharding = Sharding()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs(doc_id, text)."""
    rec = C.cut_lineage(records(docs, p))
    rows, total = rec.agg(F.count(F.lit(1)), F.sum("size")).first()
    n_ranges = p.shards * max(p.ranges_per_shard, -(-rows // (p.shards * p.rows_per_range)))
    target = max((total or 0) / n_ranges, 1.0)
    cuts = _quantiles(_sample(rec, target / p.sample_per_range, 0), target)
    for again in range(1, p.rounds + 1):
        dealt = _ranges(rec, cuts)
        sizes = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.min(F.struct("k1", "k2")).alias("lo"), F.max(F.struct("k1", "k2")).alias("hi"))
        over = sizes.filter((F.col("bytes") > p.overfull * target) & (F.col("lo") != F.col("hi"))).select("range")
        inside = dealt.join(F.broadcast(over), "range", "left_semi")      # at most one row a range
        more = _quantiles(_sample(inside, target / (4 * p.sample_per_range), again), target / 2)
        if not more or set(more) <= set(cuts):
            break
        cuts = sorted({*cuts, *more})

    inner = Window.partitionBy("range").orderBy("k1", "k2")
    dealt = _ranges(rec, cuts).withColumn("i", F.row_number().over(inner)).withColumn(
        "upto", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    dealt = C.cut_lineage(dealt)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)      # over one row a range
    base = dealt.groupBy("range").agg(F.max("i").alias("n"), F.max("upto").alias("bytes")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    middle = F.col("bytes_before") + F.col("upto") - F.col("size") / 2
    placed = (dealt.join(F.broadcast(base), "range")
              .withColumn("shard", F.least(F.lit(p.shards - 1), F.floor(middle * p.shards / max(total or 1, 1))).cast("int"))
              .withColumn("at", F.col("rows_before") + F.col("i") - 1))
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))                  # one row a shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")))

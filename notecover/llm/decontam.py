"""Benchmark decontamination by spaced-seed hashing (operator 5), in DataFrame functions only.

Fixed masks choose four word positions out of a short span and ignore the others, so a
substituted word breaks only the seeds that choose it. Items too short to leave one of them
whole whatever word is substituted have masks of their own: three neighbouring words for items of
three to five words, two and one for items of two and one. Seeds of the benchmark items are
joined with the seeds at every position of every document; hits on one diagonal (document
position less item position) are one, and each is verified word by word along it: a
document holds an item if at least ``percent`` percent of the item's words agree, or of a
window of ``window`` of its words.

Document seeds are made in one narrow pass and only hits leave it. The side of the
benchmark is broadcast when its count of seeds is below ``most_seeds`` and shuffled
otherwise, with the same rows. Defined cases: null or empty texts match nothing, nor does an
item without words; items of up to four words match where all their words do, as
``percent`` of 80 asks, and of five where four do; repeated items each match; rows with a
null doc_id are searched and reported under null;
rows that share an id are reported together; empty tables give no rows; further columns
are ignored. Words are runs of letters and digits in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C

MASKS = ((0, 1, 3, 4), (0, 2, 3, 5), (0, 1, 4, 6))
#: (mask, least and most words of the items it is for)
SHORT_MASKS = (((0, 1, 2), 3, 5), ((0, 1), 2, 2), ((0,), 1, 1))


@dataclass(frozen=True)
class Decontamination:
    masks: tuple = MASKS
    short_masks: tuple = SHORT_MASKS
    percent: int = 80
    window: int = 16
    most_seeds: int = 1_000_000


def words(text: Column) -> Column:
    """Words of a text; a leading or trailing separator leaves an empty string at that end."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")


def _masks(p: Decontamination) -> list[tuple[tuple[int, ...], int, int]]:
    """(mask, least and most words of the items it is for) of all masks."""
    return [(m, max(m) + 1, 1 << 30) for m in p.masks] + list(p.short_masks)


def _seed(array: str, at: str, k: int, mask: tuple[int, ...]) -> Column:
    """The seed of mask ``k`` at a position; null where the mask leaves the array."""
    whole = F.expr(f"{at} + {max(mask)} < size({array})")
    return F.when(whole, F.expr(f"xxhash64({k}, " + ", ".join(f"get({array}, {at} + {o})" for o in mask) + ")"))


def item_seeds(bench: DataFrame, p: Decontamination) -> tuple[DataFrame, DataFrame]:
    """(items, seeds): the items' words, and (seed, item, j, k) for mask ``k`` at word ``j``."""
    items = (C.only(bench, item_id="bigint", text="string")
             .select("item_id", F.filter(words(F.col("text")), lambda x: x != "").alias("iw"))
             .withColumn("item", F.xxhash64("item_id", "iw")))
    n = F.size("iw")
    seeds = F.array(*[F.struct(F.when(n.between(least, most), _seed("iw", "j", k, mask)).alias("seed"), F.lit(k).alias("k"))
                      for k, (mask, least, most) in enumerate(_masks(p))])
    at = (items.filter(n > 0).select("item", "iw", F.posexplode(F.sequence(F.lit(0), n - 1)).alias("_", "j"))
          .select("item", "j", F.inline(seeds)))
    return items.dropDuplicates(["item", "item_id"]), at.filter("seed is not null").select("seed", "item", "j", "k").distinct()


def hits(docs: DataFrame, seeds: DataFrame, p: Decontamination, used: set[int]) -> DataFrame:
    """(doc_id, item, diagonal), distinct; ``used``: the masks of which there are item seeds."""
    made = F.array(*[_seed("dw", "i", k, mask) for k, (mask, _, _) in enumerate(_masks(p)) if k in used])
    at = (docs.select("doc_id", words(F.col("text")).alias("dw"))
          .select("doc_id", "dw", F.explode(F.sequence(F.lit(0), F.size("dw") - 1)).alias("i"))
          .select("doc_id", "i", F.explode(made.cast("array<bigint>")).alias("seed")))
    return at.join(seeds, "seed").select("doc_id", "item", (F.col("i") - F.col("j")).alias("diagonal")).distinct()


def contaminated(docs: DataFrame, bench: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """(doc_id, item_id, item_words, agreeing, in_window, start): the best alignment of every
    benchmark item that a document holds; ``start`` is the item's word 0 in the document."""
    d = C.only(docs, doc_id="bigint", text="string")
    items, seeds = item_seeds(bench, p)
    items, seeds = C.cut_lineage(items), C.cut_lineage(seeds)
    by_mask = {r["k"]: r["count"] for r in seeds.groupBy("k").count().collect()}          # at most a row a mask
    bounded = sum(by_mask.values()) <= p.most_seeds
    seeds = seeds.select("seed", "item", "j")
    found = C.cut_lineage(hits(d, F.broadcast(seeds) if bounded else seeds, p, set(by_mask)))
    ids = found.select("doc_id").distinct()
    side = items.select("item", "iw").dropDuplicates(["item"])
    some = C.in_bitmap(d, "doc_id", ids).select(F.col("doc_id").alias("id"), "text")
    pairs = (found.join(F.broadcast(side) if bounded else side, "item").join(some, F.col("doc_id").eqNullSafe(F.col("id")))
             .withColumn("dw", words(F.col("text"))))
    flags = F.transform("iw", lambda x, k: F.coalesce((x == F.get(F.col("dw"), F.col("diagonal") + k)).cast("int"), F.lit(0)))
    w = F.least(F.size("iw"), F.lit(p.window))
    sums = F.transform(F.sequence(F.lit(1), F.size("m") - F.col("w") + 1),
                       lambda s: F.aggregate(F.slice("m", s, F.col("w")), F.lit(0), lambda a, x: a + x))
    aligned = C.cut_lineage(pairs.select("doc_id", "item", "diagonal", F.size("iw").alias("item_words"), flags.alias("m"), w.alias("w")))
    checked = (aligned
               .withColumn("agreeing", F.aggregate("m", F.lit(0), lambda a, x: a + x))
               .withColumn("in_window", F.array_max(sums))
               .filter((F.col("agreeing") * 100 >= p.percent * F.col("item_words")) | (F.col("in_window") * 100 >= p.percent * F.col("w"))))
    best = checked.groupBy("doc_id", "item").agg(F.max(F.struct("agreeing", "in_window", (-F.col("diagonal")).alias("d"))).alias("b"), F.max("item_words").alias("item_words"))
    names = items.select("item", "item_id")
    return (best.join(F.broadcast(names) if bounded else names, "item")
            .select("doc_id", "item_id", "item_words", F.col("b.agreeing").alias("agreeing"), F.col("b.in_window").alias("in_window"),
                    (-F.col("b.d")).alias("start")))


def drop_contaminated(docs: DataFrame, bench: DataFrame, p: Decontamination = Decontamination()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; the columns stay."""
    bad = C.cut_lineage(contaminated(docs, bench, p).select(F.col("doc_id").alias("bad")).distinct())
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("bad"))       # whatever the columns' names
    marked = C.mark_bitmap(packed, "bad", bad)
    open_ = marked.filter("_maybe").select("row", F.col("bad").alias("id"))
    return (marked.filter(~F.col("_maybe")).select("row.*")
            .unionByName(open_.join(bad, F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")))

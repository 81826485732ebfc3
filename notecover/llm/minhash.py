"""MinHash near-duplicate detection with compressed registers (operator 10).

Every document is its set of distinct word shingles. One pass hashes the shingles into
buckets and keeps the least value of each bucket as a 16-bit register: the number of
leading zeros and ten mantissa bits. Equal sets form one class. Registers are banded;
classes that share a band become candidates, the collision-corrected register estimate
drops those that can't reach the limit, and the rest are confirmed on the full sets.

Hot groups: copies collapse into their class before anything is banded; a band's members
are linked to its least member first (a star, not all pairs), and only members that
remain in different components are compared further, in blocks of bounded size and without
making a row per pair.

Defined cases: a null or empty text and a text without words have an empty set, link with
nothing and stand alone; a text with fewer words than a shingle has one shingle, its whole
sequence; rows with null ids take part and get a null component if no id is there;
repeated rows are one class; rows that share an id but differ in text are one node of the
result if linked, as any others. An empty table gives an empty result; further columns
are ignored. Word runs are separated by ``20 09-0D``; A-Z is lower-cased.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

MANTISSA = 10
EMPTY = 0xFFFF


@dataclass(frozen=True)
class MinHash:
    """Parameters. ``bands`` x ``rows`` registers: a pair at similarity s shares no band with
    probability (1 - s^rows)^bands, 5e-7 for the defaults at s = 0.8."""

    shingle_words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    full_bucket: int = 512

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def registers(row: np.ndarray, h: np.ndarray, rows: int, k: int) -> np.ndarray:
    """(rows, k) uint16: leading zeros and mantissa of the least hash per bucket; EMPTY if none."""
    bucket = (h >> np.uint64(52)) * np.uint64(k) >> np.uint64(12)          # from the top 12 bits
    value = h & np.uint64((1 << 52) - 1)
    least = np.full(rows * k, np.uint64(1 << 52), np.uint64)
    np.minimum.at(least, row * k + bucket.astype(np.int64), value)
    some = least < np.uint64(1 << 52)
    bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64)
    reg = (bits >> np.uint64(52 - MANTISSA)).astype(np.int64) - (1023 << MANTISSA)   # exponent 0..51, then mantissa
    return np.where(some, reg, EMPTY).astype(np.uint16).reshape(rows, k)


def _borrow_order(k: int) -> np.ndarray:
    """prio[j, b]: the order in which bucket j asks the buckets b for a value; a permutation
    of its own for each j, the same for every document. j itself comes first."""
    j = np.arange(k, dtype=np.uint64)
    prio = (spans.mix(j[:, None] * np.uint64(0x9E3779B97F4A7C15) + j[None, :] + np.uint64(1)) >> np.uint64(40)).astype(np.int32)
    prio[np.arange(k), np.arange(k)] = -1
    return prio


def band_keys(regs: np.ndarray, bands: int, rows: int, prio: np.ndarray) -> np.ndarray:
    """(n, bands) int64 keys. An empty register borrows the value of another bucket, in an
    order that all documents share, so registers agree with the probability of the sets'
    similarity however small the sets are."""
    n, k = regs.shape
    value = regs.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(16))
    holes = np.flatnonzero((regs == EMPTY).any(axis=1))
    for a in range(0, len(holes), 16):
        part = holes[a:a + 16]
        order = np.where((regs[part] == EMPTY)[:, None, :], np.int32(1 << 30), prio[None])
        value[part] = np.take_along_axis(value[part], order.argmin(axis=2), axis=1)
    out = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        out = spans.mix(out + value[:, r::rows][:, :bands] + np.uint64(r + 1))
    out = spans.mix(out + (np.arange(bands, dtype=np.uint64) << np.uint64(32)))
    return out.view(np.int64)


def _binary(a: np.ndarray) -> pa.Array:
    """One binary value per row of a 2-d array."""
    n, width = a.shape[0], a.shape[1] * a.itemsize
    off = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(a))])


def _sketcher(p: MinHash):
    def run(batches):
        prio = _borrow_order(p.registers)
        for batch in batches:
            ids = batch.column(0)
            for a, b, w in spans.words_of(batch.column(1)):
                row, h, n = spans.shingle_sets(w, p.shingle_words)
                regs = registers(row, h, w.rows, p.registers)
                key = np.zeros(w.rows, np.uint64)
                np.add.at(key, row, spans.mix(h ^ np.uint64(0xA0761D6478BD642F)))
                key = spans.mix(key ^ (n.astype(np.uint64) << np.uint64(40)))
                bands = band_keys(regs, p.bands, p.rows, prio)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(w.rows + 1, dtype=np.int32) * p.bands), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(key.view(np.int64)), _binary(regs), keys,
                     *(c.slice(a, b - a) for c in batch.columns[2:])],
                    names=["doc_id", "n_shingles", "node", "regs", "bands", *batch.schema.names[2:]])
    return run


def sketches(docs: DataFrame, p: MinHash, hashed: bool = False) -> DataFrame:
    """(doc_id, n_shingles, node, regs, bands): node is a 64-bit hash of the set. With ``hashed``
    also text_hash, which tells rows of one id apart."""
    d = C.only(docs, doc_id="bigint", text="string")
    if hashed:
        d = d.withColumn("text_hash", F.xxhash64("text"))
    return C.arrow_map(d, _sketcher(p), "doc_id bigint, n_shingles bigint, node bigint, regs binary, bands array<bigint>"
                       + (", text_hash bigint" if hashed else ""))


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates and the number of registers they rest on."""
    k = a.shape[1]
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    big, small = np.maximum(na, nb).astype(float), np.minimum(na, nb).astype(float)
    phi = 4.0 * (big / small) / ((1.0 + big / small) ** 2)
    chance = 0.169919487159739 * k / 2.0 ** (MANTISSA - 1) * phi      # expected equal registers of unrelated sets
    chance = np.minimum(chance * used / k, same)
    return np.where(used > 0, (same - chance) / np.maximum(used, 1), 0.0), used


def _verifier(p: MinHash):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            u, v, tu, tv = (batch.column(i) for i in range(4))
            keep = np.zeros(batch.num_rows, bool)
            # each pair's two texts side by side, so one slice holds both sets of a pair
            both = pa.chunked_array([tu, tv]).combine_chunks().take(pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.ravel()))
            raw, offsets = spans.buffers(both)
            pairs = offsets[::2]
            for a, b in spans.slices(pairs):
                o = offsets[2 * a:2 * b + 1]
                row, h, n = spans.shingle_sets(spans.Words(raw[o[0]:o[-1]], o - o[0]), p.shingle_words)
                pair = row // 2
                order = np.lexsort((h, pair))
                hh, pp = h[order], pair[order]
                twice = (hh[1:] == hh[:-1]) & (pp[1:] == pp[:-1])
                inter = np.bincount(pp[1:][twice], minlength=b - a)
                union = n[::2] + n[1::2] - inter
                keep[a:b] = (100 * inter >= p.percent * union) & (union > 0)
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(keep)), v.filter(pa.array(keep))], names=["u", "v"])
    return run


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the classes in wanted(node); only their texts are shuffled."""
    ids = C.cut_lineage(nodes.select("node", "doc_id").join(wanted.distinct(), "node"))
    return C.in_bitmap(C.only(docs, doc_id="bigint", text="string"), "doc_id", ids).join(ids, "doc_id").select("node", "text")


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, p: MinHash) -> DataFrame:
    """Pairs (u, v) whose full sets reach the limit."""
    text = _texts(docs, nodes, pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))))
    full = (pairs.join(text.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
            .join(text.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u")
            .select("u", "v", "text_u", "text_v"))
    return C.arrow_map(full, _verifier(p), "u bigint, v bigint")


def _comparer(p: MinHash):
    """Members of a cell that have a likely partner there: one in another component whose
    size and registers do not exclude the limit. A row per member, not per pair."""
    s = p.percent / 100.0

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("band")
        node, root, n = (table[c].to_numpy() for c in ("node", "root", "n_shingles"))
        regs = np.frombuffer(b"".join(table["regs"].to_pylist()), np.uint16).reshape(len(node), p.registers)
        keys = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(node), p.bands)
        left_of, right_of = table["left_side"].to_numpy(zero_copy_only=False), table["right_side"].to_numpy(zero_copy_only=False)
        band = table["band"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        wanted = np.zeros(len(node), bool)
        for a, b in zip(cuts[:-1], cuts[1:]):
            left, right = a + np.flatnonzero(left_of[a:b]), a + np.flatnonzero(right_of[a:b])
            i, j = _across_roots(left, right, root, n, p)
            for t in range(0, len(i), 4096):
                x, y = i[t:t + 4096], j[t:t + 4096]
                est, used = estimate(regs[x], regs[y], n[x], n[y])
                ok = est >= s - 5.0 * np.sqrt(s * (1 - s) / np.maximum(used, 1)) - 0.01
                # a pair that shares several bands counts in the first of them
                first = (keys[x] == keys[y]).argmax(axis=1)
                ok &= keys[x, first] == band[a]
                wanted[x[ok]] = wanted[y[ok]] = True
        return table.filter(pa.array(wanted)).select(["task", "band", "left_side", "right_side", "node", "root"])
    return run


def _across_roots(left: np.ndarray, right: np.ndarray, root: np.ndarray, n: np.ndarray, p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (left, right) of different components whose sizes do not exclude the limit."""
    other = root[left][:, None] != root[right][None]
    other &= np.minimum(n[left][:, None], n[right][None]) * 100 >= np.maximum(n[left][:, None], n[right][None]) * p.percent
    i, j = np.nonzero(other)
    return left[i], right[j]


def _exact(p: MinHash):
    """The pairs of a cell on their full sets; returns links that join what is apart: of all
    links found in a cell, a spanning forest over the components so far."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("band")
        node, root, band = (table[c].to_numpy() for c in ("node", "root", "band"))
        left_of, right_of = table["left_side"].to_numpy(zero_copy_only=False), table["right_side"].to_numpy(zero_copy_only=False)
        sets: list[np.ndarray] = []
        for _, _, w in spans.words_of(table["text"]):
            row, h, n = spans.shingle_sets(w, p.shingle_words)
            sets += np.split(h, np.cumsum(n)[:-1])
        size = np.array([len(x) for x in sets], np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1], [True]]))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            left, right = a + np.flatnonzero(left_of[a:b]), a + np.flatnonzero(right_of[a:b])
            if not len(left) or not len(right):
                continue
            inter = _intersections([sets[i] for i in left], [sets[j] for j in right])
            union = size[left][:, None] + size[right][None] - inter
            i, j = np.nonzero((100 * inter >= p.percent * union) & (root[left][:, None] != root[right][None]))
            if len(i):
                pairs = np.stack([root[left[i]], root[right[j]]], axis=1)
                found.append(np.unique(np.sort(pairs, axis=1), axis=0))
        links = np.unique(np.concatenate(found), axis=0)
        return pa.table({"u": np.ascontiguousarray(links[:, 1]), "v": np.ascontiguousarray(links[:, 0])})
    return run


def _intersections(a: list[np.ndarray], b: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``; only hashes
    that occur on both sides take part, ``width`` of them at a time."""
    ha, hb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ha, hb)
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(common):
        return out

    def where(h, sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.searchsorted(common, h).clip(max=len(common) - 1)
        ok = common[at] == h
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (ra, ca), (rb, cb) = where(ha, a), where(hb, b)
    for s in range(0, len(common), width):
        def dense(r, c, rows):
            lo, hi = np.searchsorted(c, [s, s + width])
            m = np.zeros((rows, min(width, len(common) - s)), np.float32)
            m[r[lo:hi], c[lo:hi] - s] = 1
            return m
        out += (dense(ra, ca, len(a)) @ dense(rb, cb, len(b)).T).astype(np.int64)
    return out


def _across(docs: DataFrame, members: DataFrame, nodes: DataFrame, p: MinHash) -> DataFrame:
    """Links (u, v) between components of ``members(band, node, m, root)``, by their roots.

    The members outside a band's largest component (its few) meet all members; those inside
    it, usually a large group of near copies, don't meet each other again. Small bands
    share a task; of a band of more than ``full_bucket`` members, each block of the few
    and each block of all are a group of their own, so no task holds a whole large band."""
    sizes = members.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("band").agg(F.max(F.struct("c", "root")).alias("b"), F.sum("c").alias("m")).select(
        "band", F.col("b.root").alias("main"), (F.col("m") - F.col("b.c")).alias("few"))
    groups = max(1, members.count() // 4096)

    def blocks(c: str):
        return F.greatest(F.when(F.col("m") > p.full_bucket, F.ceil(F.col(c) / p.full_bucket)).otherwise(1), F.lit(1)).cast("int")

    marked = (members.join(main, "band").withColumn("is_few", F.col("root") != F.col("main"))
              .withColumn("nl", blocks("few")).withColumn("nr", blocks("m"))
              .withColumn("l", F.pmod(F.xxhash64("node"), F.col("nl")).cast("int")).withColumn("r", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nr")).cast("int")))
    # a cell (i, j): block i of the few against block j of all
    row = F.when(F.col("is_few"), F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda j: F.struct(F.col("l").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    column = F.transform(F.sequence(F.lit(0), F.col("nl") - 1), lambda i: F.struct(i.alias("i"), F.col("r").alias("j")))
    dealt = (marked.withColumn("cell", F.explode(F.array_distinct(F.concat(row, column))))
             .withColumn("left_side", F.col("is_few") & (F.col("cell.i") == F.col("l"))).withColumn("right_side", F.col("cell.j") == F.col("r"))
             .withColumn("task", F.when(F.col("nr") > 1, F.xxhash64("band", "cell")).otherwise(F.pmod(F.xxhash64("band"), F.lit(groups))))
             .join(nodes.select("node", "n_shingles", "regs", "bands"), "node")
             .select("task", "band", "left_side", "right_side", "node", "root", "n_shingles", "regs", "bands"))
    cell = "task bigint, band bigint, left_side boolean, right_side boolean, node bigint, root bigint"
    likely = C.cut_lineage(C.arrow_groups(dealt, ["task"], _comparer(p), cell))
    text = _texts(docs, nodes, likely.select("node")).dropDuplicates(["node"])
    return C.arrow_groups(likely.join(text, "node"), ["task"], _exact(p), "u bigint, v bigint").distinct()


def _classes(docs: DataFrame, sk: DataFrame, p: MinHash) -> DataFrame:
    """(node, n_shingles, doc_id, root) of the sets in the sketches ``sk``: a set's least doc_id, and
    the node that stands for its component."""
    # a class per distinct set; its text is taken from its least id
    classes = (sk.filter("n_shingles > 0").groupBy("node", "n_shingles").agg(F.min("doc_id").alias("doc_id")))
    first = sk.filter("n_shingles > 0").select("doc_id", "node", "regs", "bands")
    nodes = C.cut_lineage(classes.join(first, ["node", "doc_id"]).dropDuplicates(["node"]))

    band = nodes.select("node", F.explode("bands").alias("band"))
    groups = band.groupBy("band").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    member = C.cut_lineage(band.join(groups, "band").select("band", "node", "u", "m"))
    star = member.filter("node != u").groupBy("u", F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("bands"))

    # 1. each class against the anchor it shares most bands with
    best = star.groupBy("v").agg(F.max(F.struct("bands", F.col("u").alias("a"))).alias("b")).select(F.col("b.a").alias("u"), "v")
    links = C.cut_lineage(_verified(docs, nodes, best, p))
    comp = C.cut_lineage(C.components(links))
    # 2. members of a band that still lie in different components, with each other
    state = member.join(comp, "node", "left").select("band", "node", "m", F.coalesce("root", "node").alias("root"))
    mixed = state.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("band")
    open_ = C.cut_lineage(state.join(mixed, "band"))
    last = C.cut_lineage(_across(docs, open_, nodes, p))
    if not last.isEmpty():
        comp = C.cut_lineage(C.components(comp.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(last)))   # from the components so far: fewer rounds

    return classes.join(comp, "node", "left").select("node", "n_shingles", "doc_id", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the least doc_id that can be reached over links of at least
    ``p.percent`` percent similarity; ``kept`` marks the row whose id it is."""
    sk = C.cut_lineage(sketches(docs, p))
    where = _classes(docs, sk, p)
    # the least id of each component
    least = where.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = where.join(least, "root").select("node", "n_shingles", "component_id")
    out = sk.select("doc_id", "n_shingles", "node").join(named, ["node", "n_shingles"], "left")
    cid = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the least id (a null id
    comes last, equal ids go by a hash of the text); the columns stay. Documents without
    words are no duplicates of others. A row is told by its id and text, so another text under the id of a
    dropped row stays; of equal rows one stays."""
    key = [F.col("doc_id").cast("bigint").alias("id"), F.xxhash64("text").alias("hash")]
    sk = C.cut_lineage(sketches(docs, p, hashed=True))
    where = _classes(docs, sk, p)
    rows = sk.filter("n_shingles > 0").select("doc_id", "text_hash", "node", "n_shingles") \
        .join(where.select("node", "n_shingles", "root"), ["node", "n_shingles"]).select("doc_id", "text_hash", "root")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_hash").alias("text_hash"))
    groups = rows.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = rows.groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).join(groups, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    bare = sk.filter("n_shingles = 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    verdict = C.cut_lineage(held.withColumn("stays", stays).unionByName(bare.withColumn("stays", F.lit(True)), allowMissingColumns=True)
                            .select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "stays", "copies"))
    packed = docs.select(F.struct("*").alias("row"), *key)                  # a row keeps its columns, whatever their names
    same = F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash"))
    left = packed.join(verdict.filter("not stays"), same, "left_anti")
    many = verdict.filter("stays and copies > 1")
    if many.isEmpty():
        return left.select("row.*")
    once = left.join(many, same, "left_semi").dropDuplicates(["id", "hash"])
    return left.join(many, same, "left_anti").unionByName(once).select("row.*")

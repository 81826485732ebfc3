"""Reversible line dedup: sharded cuckoo filters over exact reference-count tables (operator 11).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z lower-cased; keys
of at least ``min_chars`` code points are indexed by a 128-bit hash, dealt to shards by its
first bits. An index consists of three tables in the shared folder, each a list of Parquet
parts that are only ever added to, so a failed job leaves the index before it intact:

* references (shard, key, doc_id, text_hash, n): one row per document row and key, n = 1,
  or -1 where a deletion takes it back. Written by the map over the texts, not shuffled.
* counts (shard, key, version, refs, first): documents that hold the key, and the least
  doc_id of them; the row of the highest version holds.
* filters (shard, part, table): cuckoo filters with one 16-bit fingerprint per live key.

``insert`` groups the new references by key (partial sums first, so a line on a third of all
rows costs one row a task), and a shard's filter says which keys are surely new: those are
appended without a look at the older counts, which are read for the few others alone.
``delete`` adds negative references, counts the keys concerned anew from their
references, and takes the fingerprints of keys without a document out of the filters:
``dedup`` is then as if the document had never been there. ``dedup`` drops a line when a
smaller doc_id holds its key.

Skew: a key held by more than 1/4096 of all references is joined by broadcast (there are at
most 4096 of them, whatever the corpus); no other key has more rows than that share.

Defined cases: a null or empty text is one empty line, which stays; rows that share a doc_id
count as one document, so they do not drop each other's lines; a null doc_id comes after
all others, and such rows count as one document; repeated rows are treated alike; lines
and texts of any length are whole; an empty table gives no rows; further columns are
ignored, whatever their names. A doc_id may be inserted again after it was deleted.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecover.llm import common as C
from notecover.llm import spans

STRIP = b" \t\n\x0b\x0c\r"
_U = np.uint64
_REFS = "shard bigint, key binary, doc_id bigint, text_hash bigint, n int"
_COUNTS = "shard bigint, key binary, version int, refs bigint, first bigint"
_FILTERS = "shard bigint, part int, table binary"


@dataclass(frozen=True)
class LineDedup:
    min_chars: int = 10
    shard_keys: int = 250_000             # references a shard is made for; an outgrown shard gets further filters
    slots: int = 4                        # fingerprints of a bucket
    load: float = 0.85
    hot_share: int = 4096


# --- lines

def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Hash of a line's key, or None if the key is shorter than ``min_chars`` code points."""
    k = line.strip(STRIP).lower()
    if len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(k, digest_size=16).digest()


def _referrer(p: LineDedup):
    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0), batch.column(2)
            raw, offsets = spans.buffers(batch.column(1))
            for a, b in spans.slices(offsets):
                text = raw[offsets[a]:offsets[b]].tobytes()
                keys, rows = [], []
                for r in range(a, b):
                    lines = text[offsets[r] - offsets[a]:offsets[r + 1] - offsets[a]].split(b"\n")
                    found = {line_key(x, p.min_chars) for x in lines}
                    found.discard(None)
                    keys.extend(found)
                    rows.extend([r] * len(found))
                at = pa.array(rows, pa.int64())
                prefix = np.frombuffer(b"".join(k[:4] for k in keys), ">u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(keys, pa.binary()), ids.take(at), hashes.take(at)],
                                                 names=["prefix", "key", "doc_id", "text_hash"])
    return run


def _docs(docs: DataFrame) -> DataFrame:
    return C.only(docs, doc_id="bigint", text="string").withColumn("text_hash", F.xxhash64("text"))


def references(docs: DataFrame, p: LineDedup = LineDedup()) -> DataFrame:
    """(prefix, key, doc_id, text_hash): a row per document row and different key of it; ``prefix``
    are the key's first 32 bits."""
    return C.arrow_map(_docs(docs), _referrer(p), "prefix bigint, key binary, doc_id bigint, text_hash bigint")


# --- cuckoo filters

class Cuckoo:
    """A cuckoo filter: each key's 16-bit fingerprint lies in one of two buckets of ``slots``
    places, each bucket found from the other and the fingerprint. No false negatives; one
    copy per insertion, so deleting an inserted key never removes another's membership."""

    KICKS = 64

    def __init__(self, table: np.ndarray, seed: int = 1) -> None:
        self.table = table
        self.mask = _U(len(table) - 1)
        self.random = np.random.default_rng(seed)

    @classmethod
    def sized(cls, keys: int, p: LineDedup) -> Cuckoo:
        need = max(1, int(keys / p.load / p.slots) + 1)
        return cls(np.zeros((1 << (need - 1).bit_length(), p.slots), np.uint16))

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = ((h >> _U(48)).astype(np.uint16) | (h >> _U(48) == 0)).astype(np.uint16)       # never 0, the empty place
        return mark, (h & self.mask).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return (bucket.astype(_U) ^ (spans.mix(mark.astype(_U)) & self.mask)).astype(np.int64)

    def has(self, h: np.ndarray) -> np.ndarray:
        mark, one = self._places(h)
        two = self._other(one, mark)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(1)

    @property
    def free(self) -> int:
        return int((self.table == 0).sum())

    def add(self, h: np.ndarray) -> np.ndarray:
        """Insert all; returns the (mark, bucket) that found no place after ``KICKS`` rounds.

        All waiting fingerprints move at once: those that fit are placed, of the others one
        a full bucket throws out a random fingerprint, which goes on to its other bucket."""
        mark, bucket = self._places(h)
        for turn in range(2 * self.KICKS):
            mark, bucket = self._settle(mark, bucket)
            if not len(mark):
                break
            if turn:
                first = np.unique(bucket, return_index=True)[1]             # one per full bucket changes places
                slot = self.random.integers(0, self.table.shape[1], len(first))
                out = self.table[bucket[first], slot].copy()
                self.table[bucket[first], slot] = mark[first]
                mark[first] = out
            bucket = self._other(bucket, mark)
        return np.stack([mark.astype(np.int64), bucket])

    def _settle(self, mark: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(bucket, kind="stable")
        mark, bucket = mark[order], bucket[order]
        rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket, "left")
        empty = self.table[bucket] == 0
        fits = rank < empty.sum(1)
        # the (rank+1)-th empty place of the bucket
        slot = (np.cumsum(empty, 1) == (rank + 1)[:, None]).argmax(1)
        self.table[bucket[fits], slot[fits]] = mark[fits]
        return mark[~fits], bucket[~fits]

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Take one copy of each key's fingerprint out; returns which had one."""
        done = np.zeros(len(h), bool)
        mark, one = self._places(h)
        for i, (m, a, b) in enumerate(zip(mark.tolist(), one.tolist(), self._other(one, mark).tolist())):
            for bucket in (a, b):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    done[i] = True
                    break
        return done


def hashes_of(keys: pa.Array) -> np.ndarray:
    """64 bits of each 16-byte key, apart from those that name the shard."""
    if isinstance(keys, pa.ChunkedArray):
        keys = keys.combine_chunks()
    raw = b"".join(keys.to_pylist())
    return np.frombuffer(raw, "<u8").reshape(-1, 2)[:, 1].astype(_U)


def _filters_of(table: pa.Table, p: LineDedup) -> list[Cuckoo]:
    rows = sorted(zip(table.column("part").to_pylist(), table.column("table").to_pylist()))
    return [Cuckoo(np.frombuffer(b, np.uint16).reshape(-1, p.slots).copy(), part + 1) for part, b in rows]


def _add_all(filters: list[Cuckoo], h: np.ndarray, p: LineDedup) -> None:
    """Into the last filter, as far as its load allows, and into further ones for the rest."""
    while len(h):
        n = 0
        if filters:
            last = filters[-1]
            n = min(len(h), max(0, last.free - int(last.table.size * (1 - p.load))))
            while n:
                before = last.table.copy()
                if not last.add(h[:n]).size:
                    break
                last.table[:] = before                                      # some found no place: fewer then
                n //= 2
        h = h[n:]
        if len(h) and not n:
            filters.append(Cuckoo.sized(max(len(h), 2 * filters[-1].table.size if filters else 0), p))


_OUT = "shard bigint, part int, table binary, key binary"


def _result(shard: int, filters: list[Cuckoo], keys: pa.Array) -> pa.Table:
    n, m = len(filters), len(keys)
    return pa.table([pa.array([shard] * (n + m), pa.int64()), pa.array([*range(n), *[None] * m], pa.int32()),
                     pa.array([*(f.table.tobytes() for f in filters), *[None] * m], pa.binary()),
                     pa.concat_arrays([pa.nulls(n, pa.binary()), keys])], names=["shard", "part", "table", "key"])


def _shard_task(p: LineDedup, what: str):
    """One shard: its keys and its filters -> the changed filters, and for 'probe' the keys that a
    filter may hold (all others are inserted)."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = (left if left.num_rows else right).column("shard")[0].as_py()
        keys = pa.concat_arrays([pa.array([], pa.binary()), *left.column("key").chunks])
        filters = _filters_of(right, p)
        h = hashes_of(keys) if len(keys) else np.zeros(0, _U)
        maybe = np.zeros(len(h), bool)
        if what == "remove":
            for f in filters:
                left_over = np.flatnonzero(~maybe)
                maybe[left_over] |= f.remove(h[left_over])
            return _result(shard, filters, pa.array([], pa.binary()))
        if what == "probe":
            for f in filters:
                maybe |= f.has(h)
        _add_all(filters, h[~maybe], p)
        return _result(shard, filters, keys.filter(pa.array(maybe)))
    return run


# --- the index

@dataclass(frozen=True)
class Index:
    """Paths of an index's tables; every change gives a new Index, the old one stays usable."""

    spark: SparkSession
    p: LineDedup
    bits: int
    refs: tuple[DataFrame, ...] = ()
    counts: tuple[DataFrame, ...] = ()
    filters: DataFrame | None = None
    total: int = 0
    deletions: int = 0
    probed: list = field(default_factory=list)              # (keys, of these maybe old, of these old) of each insertion

    def _union(self, parts: tuple[DataFrame, ...], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def references(self) -> DataFrame:
        """(shard, key, doc_id, text_hash, n) of the documents in the index."""
        r = self._union(self.refs, _REFS)
        if self.deletions:
            r = r.groupBy("shard", "key", "doc_id", "text_hash").agg(F.sum("n").cast("int").alias("n")).filter("n > 0")
        return r.select("shard", "key", "doc_id", "text_hash", "n")

    def live(self, among: DataFrame | None = None) -> DataFrame:
        """(shard, key, refs, first) of the keys that some document holds."""
        c = self._union(self.counts, _COUNTS)
        if among is not None:
            c = c.join(among.select("shard", "key"), ["shard", "key"], "left_semi")
        if len(self.counts) > 1:
            c = (c.groupBy("shard", "key").agg(F.max(F.struct("version", "refs", "first")).alias("v"))
                 .select("shard", "key", "v.refs", "v.first"))
        return c.select("shard", "key", "refs", "first").filter("refs > 0")

    def _shards(self, keys: DataFrame, what: str) -> DataFrame:
        filters = self.filters if self.filters is not None else self.spark.createDataFrame([], _FILTERS)
        C.ship_package(self.spark)
        # columns of their own on both sides: keys and filters may come from one table
        keys = keys.select(F.col("shard").alias("shard"), F.col("key").alias("key"))
        filters = filters.select(*(F.col(c).alias(c) for c in ("shard", "part", "table")))
        return C.stored(keys.groupBy("shard").cogroup(filters.groupBy("shard"))
                        .applyInArrow(_shard_task(self.p, what), _OUT), "linefilters")


def _tables(out: DataFrame) -> DataFrame:
    return out.filter("part is not null").select("shard", "part", "table")


def new_index(spark: SparkSession, references_expected: int, p: LineDedup = LineDedup()) -> Index:
    """An empty index with a power of two of shards."""
    shards = max(1, -(-references_expected // p.shard_keys))
    return Index(spark, p, min(32, (shards - 1).bit_length()))


def _with_shard(refs: DataFrame, bits: int) -> DataFrame:
    return refs.withColumn("shard", F.shiftright("prefix", 32 - bits)).drop("prefix")


def insert(index: Index, docs: DataFrame) -> Index:
    """The index with the rows of docs(doc_id, text) added."""
    return insert_references(index, references(docs, index.p))


def insert_references(index: Index, refs: DataFrame) -> Index:
    new = C.stored(_with_shard(refs, index.bits).withColumn("n", F.lit(1)), "linerefs")
    total = new.count()
    if not total:
        return index
    fresh = C.stored(new.groupBy("shard", "key").agg(F.sum("n").alias("refs"), F.min("doc_id").alias("first")), "linekeys")
    out = index._shards(fresh, "probe")
    maybe = out.filter("part is null").select("shard", "key")
    filters = _tables(out)
    n_maybe = maybe.count()
    counts, n_old = fresh, 0
    if n_maybe:
        old = C.stored(index.live(maybe), "lineold")
        n_old = old.count()
        if n_old < n_maybe:                                                 # the filters' false alarms are new keys after all
            wrong = maybe.join(old, ["shard", "key"], "left_anti")
            filters = _tables(replace(index, filters=filters)._shards(wrong, "add"))
        counts = (fresh.unionByName(old).groupBy("shard", "key").agg(F.sum("refs").alias("refs"), F.min("first").alias("first"))
                  if n_old else fresh)
    version = len(index.counts)
    counts = C.stored(counts.select("shard", "key", F.lit(version).alias("version"), "refs", "first"), "linecounts")
    return replace(index, refs=(*index.refs, new), counts=(*index.counts, counts), filters=filters, total=index.total + total,
                   probed=[*index.probed, (fresh.count(), n_maybe, n_old)])


def delete(index: Index, ids: DataFrame) -> Index:
    """The index without the documents of ids(doc_id); unknown ids change nothing."""
    ids = C.only(ids, doc_id="bigint").distinct()
    refs = index.references()
    gone = C.stored(refs.join(ids, refs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
                    .groupBy("shard", "key", "doc_id", "text_hash").agg((-F.sum("n")).cast("int").alias("n")), "linegone")
    taken = gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not taken:
        return index
    after = replace(index, refs=(*index.refs, gone), deletions=index.deletions + 1, total=index.total + taken)
    touched = gone.select("shard", "key").distinct()
    held = (after.references().join(touched, ["shard", "key"], "left_semi")
            .groupBy("shard", "key").agg(F.sum("n").alias("refs"), F.min("doc_id").alias("first")))
    version = len(index.counts)
    counts = C.stored(touched.join(held, ["shard", "key"], "left")
                      .select("shard", "key", F.lit(version).alias("version"), F.coalesce("refs", F.lit(0)).alias("refs"), "first"),
                      "linecounts")
    after = replace(after, counts=(*index.counts, counts))
    dead = counts.filter("refs = 0")
    # a fingerprint lies in an unknown one of several filters: such shards are made anew from their exact keys
    many = index.filters.groupBy("shard").count().filter("count > 1").select("shard")
    many = many.join(dead.select("shard").distinct(), "shard", "left_semi")
    single = replace(after, filters=index.filters.join(many, "shard", "left_anti"))
    filters = _tables(single._shards(dead.join(many, "shard", "left_anti"), "remove"))
    anew = _tables(replace(after, filters=None)._shards(after.live().join(many, "shard", "left_semi"), "add"))
    return replace(after, filters=filters.unionByName(anew))


def _rebuilder(p: LineDedup):
    def run(batches):
        for batch in batches:
            ids, drops = batch.column(0), batch.column(2)
            raw, offsets = spans.buffers(batch.column(1))
            for a, b in spans.slices(offsets):
                text = raw[offsets[a]:offsets[b]].tobytes()
                total, gone, kept = [], [], []
                for r in range(a, b):
                    lines = text[offsets[r] - offsets[a]:offsets[r + 1] - offsets[a]].split(b"\n")
                    drop = set(drops[r].as_py() or ())
                    stay = [x for x in lines if line_key(x, p.min_chars) not in drop] if drop else lines
                    total.append(len(lines))
                    gone.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(total, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(kept, pa.binary()).view(pa.string())],
                                                 names=["doc_id", "n_lines", "n_dropped", "kept"])
    return run


def dropped(index: Index) -> DataFrame:
    """(doc_id, text_hash, key) of the references whose lines go: a smaller doc_id holds the key."""
    shared = index.live().filter("refs > 1 and first is not null")
    hot = shared.filter(F.col("refs") * index.p.hot_share >= index.total)           # at most hot_share keys
    refs = index.references()
    later = F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first"))
    cold = refs.join(shared.filter(F.col("refs") * index.p.hot_share < index.total), ["shard", "key"])
    return (cold.filter(later).select("doc_id", "text_hash", "key")
            .unionByName(refs.join(F.broadcast(hot), ["shard", "key"]).filter(later).select("doc_id", "text_hash", "key")))


def dedup(index: Index, docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), whose rows the index holds, as (doc_id, n_lines, n_dropped, kept)."""
    lists = (dropped(index).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
             .agg(F.collect_set("key").alias("drops")))
    d = _docs(docs)
    joined = d.join(lists, d["doc_id"].eqNullSafe(lists["_id"]) & d["text_hash"].eqNullSafe(lists["_hash"]), "left")
    return C.arrow_map(joined.select("doc_id", "text", "drops"), _rebuilder(index.p),
                       "doc_id bigint, n_lines bigint, n_dropped bigint, kept string")


def build(docs: DataFrame, p: LineDedup = LineDedup(), batches: int = 4) -> Index:
    """An index of all rows, inserted in ``batches`` by doc_id; the texts are read once."""
    refs = C.stored(references(docs, p).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "linerefs")
    index = new_index(docs.sparkSession, refs.count(), p)
    for b in range(batches):
        index = insert_references(index, refs.filter(F.col("batch") == b).drop("batch"))
    return index

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_fixtures import docs_of  # noqa: F401  (a fixture)

from notecover.llm import linededup as L
from notecover.llm import queries

SPACE = " \t\n\x0b\x0c\r"
LONG = "a line that many documents share"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_chars=10):
    """(doc_id, n_lines, n_dropped, kept) of every row."""
    holders = defaultdict(set)

    def keys(t):
        return [lower(x.strip(SPACE)) for x in (t or "").split("\n")]

    def rank(i):
        return (i is None, i or 0)

    for i, t in rows:
        for k in keys(t):
            if len(k) >= min_chars:
                holders[k].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x, k in zip(lines, keys(t)) if not (len(k) >= min_chars and min(holders[k]) < rank(i))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def result(index, docs):
    return sorted((tuple(r) for r in L.dedup(index, docs).collect()), key=repr)


ROWS = [(5, f"{LONG}\nown line of document five\n{LONG}"), (3, f"  {LONG.upper()} \t\nshort\nshort"), (9, f"x\n\n{LONG}\r\nshort\n"),
        (9, f"{LONG}\na second row of document nine"), (2, None), (1, ""), (7, "\n\n"), (8, "a second row of document nine"),
        (None, f"{LONG}\nheld by rows without id only"), (None, "held by rows without id only"), (4, "éééééééééé\nééééééééé"),
        (6, "éééééééééé\nééééééééé\nÉÉÉÉÉÉÉÉÉÉ"), (10, "z" * 200_000 + f"\n{LONG}"), (11, "z" * 200_000), (11, "z" * 200_000)]


def test_dedup_equals_brute_force(spark, docs_of):
    docs = docs_of(ROWS)
    for batches in (1, 3):
        assert result(L.build(docs, batches=batches), docs) == brute(ROWS)


def test_deletions_reverse_insertions(spark, docs_of):
    p = L.LineDedup(shard_keys=4)                                           # several shards, several filters a shard
    index = L.new_index(spark, 12, p)
    parts = [ROWS[:4], ROWS[4:9], ROWS[9:]]
    for rows in parts:
        index = L.insert(index, docs_of(rows))
    assert result(index, docs_of(ROWS)) == brute(ROWS)
    without = [r for r in ROWS if r[0] not in (3, 8, None)]
    fewer = L.delete(index, spark.createDataFrame([(3,), (8,), (None,), (77,)], "doc_id bigint"))
    assert result(fewer, docs_of(without)) == brute(without)
    # the filters hold exactly one fingerprint per live key
    live = {(r.shard, bytes(r.key)): r.refs for r in fewer.live().collect()}
    held = sum(int((np.frombuffer(r.table, np.uint16) > 0).sum()) for r in fewer.filters.collect())
    assert held == len(live)
    assert result(index, docs_of(ROWS)) == brute(ROWS)                     # the older index is still usable
    back = L.insert(fewer, docs_of([r for r in ROWS if r[0] in (3, 8, None)]))
    assert result(back, docs_of(ROWS)) == brute(ROWS)
    assert {(r.shard, bytes(r.key)): (r.refs, r.first) for r in back.live().collect()} == \
        {(r.shard, bytes(r.key)): (r.refs, r.first) for r in index.live().collect()}
    empty = L.delete(back, docs_of(ROWS))
    assert empty.live().count() == 0 and empty.references().count() == 0
    assert sum(int((np.frombuffer(r.table, np.uint16) > 0).sum()) for r in empty.filters.collect()) == 0


def test_filters_spare_the_exact_tables(spark, docs_of):
    rows = [(i, f"only document {i} holds this line\n{LONG if i % 50 == 0 else 'brief'}") for i in range(2000)]
    index = L.new_index(spark, 2000)
    for a in range(0, 2000, 500):
        index = L.insert(index, docs_of(rows[a:a + 500]))
    for k, (keys, maybe, old) in enumerate(index.probed):
        assert keys == 501 and old == (1 if k else 0) and old <= maybe <= old + 5


def test_hot_keys_and_shards(spark, docs_of):
    rows = [(i, f"{LONG}\n" + (f"pair line number {i // 2}" if i % 3 else "few")) for i in range(600)]
    docs = docs_of(rows).repartition(7)
    for p in (L.LineDedup(hot_share=1, shard_keys=40), L.LineDedup(hot_share=1 << 30)):
        assert result(L.build(docs, p), docs) == brute(rows)


def test_empty_table_clashing_columns_and_bad_types(spark, docs_of):
    assert L.dedup(L.build(docs_of([])), docs_of([])).count() == 0
    clash = docs_of(ROWS).selectExpr("doc_id", "text", "1 AS text_hash", "2 AS drops", "3 AS _id", "'x' AS key")
    assert result(L.build(clash), clash) == brute(ROWS)
    with pytest.raises(ValueError):
        L.build(docs_of(ROWS).drop("text"))


def test_cuckoo_filter_holds_all_and_forgets_what_is_removed():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    p = L.LineDedup()
    f = L.Cuckoo.sized(len(h), p)
    assert not f.add(h).size and f.has(h).all()
    other = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert f.has(other).mean() < 0.001
    assert f.remove(h[:25_000]).all() and f.has(h[25_000:]).all()
    assert f.has(h[:25_000]).mean() < 0.001
    grown = [L.Cuckoo.sized(10, p)]
    L._add_all(grown, h, p)
    assert len(grown) > 1 and np.any([g.has(h) for g in grown], axis=0).all()
    same = [L.Cuckoo.sized(4, p)]
    L._add_all(same, np.full(40, 12345, np.uint64), p)                      # one fingerprint more often than two buckets hold
    assert sum(int((g.table > 0).sum()) for g in same) == 40


def test_line_key_rules():
    assert L.line_key(b"  ABCDEFGHIJ\r", 10) == L.line_key(b"abcdefghij", 10) != L.line_key(b"abcdefghik", 10)
    assert L.line_key(b"abcdefghi ", 10) is None
    assert L.line_key(" abcdefghi".encode(), 10) is not None           # other white space belongs to the key
    assert L.hashes_of(pa.array([L.line_key(b"abcdefghij", 10)])).dtype == np.uint64


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.QUERIES["op11_line_dedup"](spark, sf).collect()), key=repr)
    assert got == [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in brute(rows)]
    assert any(g[2] for g in got)

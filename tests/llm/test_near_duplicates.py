import re
from itertools import combinations

import numpy as np
import pytest
from llm_fixtures import docs_of  # noqa: F401  (a fixture)
from pyspark.sql import functions as F

from notecover.llm import embeddings, minhash
from notecover.llm import common as C

SF = "/root/testdata/sf0.001"


def shingles(text, size):
    w = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def least(ids, links):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


def by_force(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = least(sets, links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_minhash_on_documents_as_by_force(spark, size):
    docs = C.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, minhash.MinHash(shingle_words=size)).collect()}
    assert got == by_force(rows, size)


def test_minhash_links_at_the_limit_and_short_texts(docs_of):
    base = [f"w{i}" for i in range(41)]                                    # 40 pairs
    other = base[:37] + ["x1", "x2", "x3", "x4"]
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(base[:33])), (4, "One"), (5, "one"), (6, "one two"), (7, ""), (8, " \t"),
            (9, "a b c d e"), (10, "a b c d e f"), (11, "long " * 20_000 + "end")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows), minhash.MinHash(shingle_words=2)).collect()}
    assert got == by_force(rows, 2)
    assert got[10][1] == 9 and got[5][1] == 4 and got[3][1] == 1


def test_minhash_nulls_repeats_empty_table_and_clashing_columns(spark, docs_of):
    rows = [(1, None), (None, "a b c"), (2, "a b c"), (2, "a b c"), (3, "A  b\nc"), (None, None)]
    extra = docs_of(rows).selectExpr("*", "1 as node", "2 as bands", "3 as u")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(extra, minhash.MinHash(shingle_words=2)).collect())
    assert got == sorted([(1, 0, 1, True), (-1, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (-1, 0, None, False)], key=str) or \
        sorted(got, key=str) == sorted([(1, 0, 1, True), (-1, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (-1, 0, None, False)], key=str)
    assert minhash.near_duplicates(docs_of([])).collect() == []


def test_large_group_of_near_copies_and_a_shared_passage(docs_of):
    rng = np.random.default_rng(3)
    words = [f"k{i}" for i in range(100)]
    rows = []
    for i in range(150):                                                    # near copies: one word differs
        w = list(words)
        w[i % 100] = f"n{i}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(55)]
    for i in range(120):                                                    # a common passage, else unlike
        rows.append((1000 + i, " ".join([f"q{i}_{j}" for j in range(rng.integers(12, 40))] + passage)))
    p = minhash.MinHash(shingle_words=2, full_bucket=32)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(rows), p).collect()}
    assert got == by_force(rows, 2)


def test_drop_near_duplicates_keeps_one_of_each_group(docs_of):
    text = " ".join(f"t{i}" for i in range(60))
    rows = [(5, text), (5, text), (7, text), (8, "other words here now"), (9, None), (9, None), (None, "solo a b c d e"), (None, "solo a b c d e")]
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(5, text), (8, "other words here now"), (9, None), (None, "solo a b c d e")], key=str)


def test_register_estimate_is_corrected():
    p = minhash.MinHash()
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**64 - 1, 20_000, dtype=np.uint64) for _ in range(2))
    row = np.repeat([0, 1], 20_000)
    regs = minhash.registers(row, np.concatenate([a, np.concatenate([a[:16_000], b[:4_000]])]), 2, p.registers)
    n = np.array([20_000])
    est, used = minhash.estimate(regs[:1], regs[1:], n, n)
    assert used[0] == p.registers and abs(est[0] - 2 / 3) < 0.12


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    edges = spark.createDataFrame(links, "u bigint, v bigint")
    got = {r.node: r.root for r in C.components(edges).collect()}
    assert got == {i: r for i, r in least({x for e in links[:-1] for x in e}, links[:-1]).items()}


def test_vectors_as_by_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 24))
    rows, i = [], 0
    for k in range(12):
        for _ in range(14):
            noise = rng.standard_normal(24) * rng.choice([0.02, 0.12, 0.2])
            rows.append((i, (base[k] + noise).astype(np.float32).tolist(), k % 3))
            i += 1
    rows += [(i, rows[0][1], 0), (i + 1, None, 0), (i + 2, [0.0] * 24, 0), (i + 3, [float("nan")] * 24, 0), (i + 4, rows[0][1], None), (i + 5, [1.0, 2.0], 0), (i + 6, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    ok = [(v, np.array(e, float), l) for v, e, l in rows if e and l is not None and np.isfinite(e).all() and np.any(e)]
    links = [(a[0], b[0]) for a, b in combinations(ok, 2) if a[2] == b[2] and len(a[1]) == len(b[1])
             and a[1] @ b[1] / (np.linalg.norm(a[1]) * np.linalg.norm(b[1])) >= 0.98]
    root = least([r[0] for r in rows], links)
    expect = {r[0]: (sum(r[0] in x for x in links), root[r[0]], root[r[0]] == r[0]) for r in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(df, embeddings.RotationCodes(block=16)).collect()}
    assert got == expect and links
    assert embeddings.near_duplicate_vectors(df.limit(0)).collect() == []


def test_rotation_codes_are_unbiased_and_bounded():
    p = embeddings.RotationCodes()
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code, factor, rotated = embeddings.encode(x, embeddings.rotation(64, p))
    upper = embeddings.upper_bounds(code, factor, rotated, p)
    exact = x @ x.T
    assert (upper >= exact - 1e-9).all()
    flat = embeddings.upper_bounds(code, factor, rotated, embeddings.RotationCodes(spread=0.0)) - exact
    off = flat[~np.eye(300, dtype=bool)]
    assert abs(off.mean()) < 0.005 and off.std() < 0.08


LONG_TEXT = " ".join(f"word{i}" for i in range(200))


def test_drop_near_duplicates_by_id_and_text(docs_of):
    near = LONG_TEXT + " more"
    rows = [(3, LONG_TEXT), (5, near), (5, "a clean text under the same id"), (7, LONG_TEXT), (7, LONG_TEXT), (None, LONG_TEXT), (None, ""),
            (8, "one two"), (8, "one two"), (9, None), (9, None)]
    kept = [(r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs_of(rows)).collect()]
    assert sorted(kept, key=repr) == sorted([(3, LONG_TEXT), (5, "a clean text under the same id"), (None, ""), (8, "one two"), (9, None)], key=repr)


def test_stages_keep_columns_of_any_name(spark, docs_of):
    """Extra columns that carry the stages' own names, in any case, pass through unchanged."""
    import corpus_pipeline as P

    names = ["_bad", "_id", "_n", "_bucket", "_map", "_maybe", "_doc", "_ks", "row", "id", "hash", "of", "doc", "was", "now", "hit", "node", "Bad"]
    rows = [(1, LONG_TEXT + " password: hunter2hunter2"), (2, LONG_TEXT), (2, LONG_TEXT), (3, "quite another short text"), (None, None), (4, "")]
    docs = docs_of(rows)
    for n in names[:-1]:
        docs = docs.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    empty = docs.limit(0)
    for name, stage in P.STAGES[1:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        for r in out.collect():
            assert all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for n in names[:-1]), name
        assert stage(spark, empty, "/root/testdata/sf0.001").collect() == []
    assert P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= len(rows)

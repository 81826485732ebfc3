import hashlib
from collections import Counter

import numpy as np
import pytest
from llm_fixtures import docs_of  # noqa: F401  (a fixture)

from notecover.llm import queries
from notecover.llm import tokenalign as T

SF = "/root/testdata/sf0.001"
ROWS = [(1, "The quick brown fox."), (2, "naïve café — 漢字 😀 x"), (3, None), (4, ""), (5, "tabs\tand\nlines  and   runs "),
        (6, "a <|endoftext|> and </s> <unk> <0x0A> inside"), (7, "already ▁ a piece mark"), (8, "The quick brown fox."),
        (None, "The quick brown fox."), (1, "one id, two texts"), (9, "word " * 30_000), (10, " " * 9000), (11, "x" * 50_000), (12, "\u0000 nul")]


@pytest.fixture(scope="module")
def encoders():
    return T._pair(*T.default_tokenizers())


def reference(rows):
    """Per row (n_a, n_b, n_groups, n_links, n_best, count_sum, groups) by the tokenizers' own encoders, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = T.default_tokenizers()
    tok = Tokenizer.from_file(path_a)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
    byte = T.byte_alphabet()
    of_a = {i: bytes(byte[c] for c in t) for t, i in tok.get_vocab().items() if t != "<|endoftext|>"}

    def of_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()

    found, count = [], Counter()
    for _, t in rows:
        a = tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = sp.encode(t) if t else []
        full = (" " + t).encode() if t else b""
        if b"".join(of_a[i] for i in a) != full or b"".join(map(of_b, b)) != full:
            a, b = [], []
        ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b(i)) for i in b]).tolist()
        where = {e: j for j, e in enumerate(ends_b)}
        links = [(a[i], b[where[e]]) for i, e in enumerate(ends_a) if e in where]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(e, i) + 1, where[e] + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        count.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(na, nb, ng, len(li), sum(count[x] == best[x[1]] for x in li), sum(count[x] for x in li), g) for na, nb, ng, li, g in found]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def expected(rows):
    return sorted(((i, *r) for (i, _), r in zip(rows, reference(rows))), key=repr)


def test_alignment_and_counts_equal_brute_force(spark, docs_of):
    docs = docs_of(ROWS)
    want = expected(ROWS)
    assert sum(1 for r in want if r[1] == 0) == 3                          # null, empty, and the text with a piece mark
    for p in (T.Align(), T.Align(sent_pairs=0, held_pairs=1, slice_bytes=64), T.Align(sent_pairs=20)):
        got = T.with_counts(T.align(docs, p=p), p).select(*COLUMNS).collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op12_token_alignment"](spark, SF).select(*COLUMNS[:-1], "groups_sha256").collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in expected(rows)]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert T.with_counts(T.align(docs_of([]))).count() == 0
    clash = docs_of(ROWS[:3]).selectExpr("doc_id", "text", "1 AS rid", "2 AS n_a", "3 AS links", "'z' AS groups")
    got = sorted((tuple(r) for r in T.with_counts(T.align(clash)).select(*COLUMNS).collect()), key=repr)
    assert got == expected(ROWS[:3])


def test_bytes_that_are_not_utf8_have_no_tokens(spark):
    d = spark.sql("SELECT 1L AS doc_id, CAST(unhex('61ff62') AS STRING) AS text UNION ALL SELECT 2L, 'ab'")
    assert {r.doc_id: r.n_a > 0 for r in T.align(d).collect()} == {1: False, 2: True}


def test_slices_and_their_links(encoders):
    # a: ab|c|de, b: a|bc|d|e
    x, y = T.cuts([2, 3, 5], [1, 3, 4, 5])
    assert (x.tolist(), y.tolist()) == ([2, 3], [2, 4])
    a, b = np.array([1, 2, 3]), np.array([4, 5, 6, 7])
    la, lb = np.array([2, 1, 2]), np.array([1, 2, 1, 1])
    assert T.GroupText(10, 10)(a, b, x, y) == "1,2|4,5;3|6,7"

    def pairs(codes):
        return [(int(c) >> 32, int(c) & 0xFFFFFFFF) for c in codes]

    assert pairs(T.slice_links(a, b, la, lb, x, y, "end")) == [(2, 5), (3, 7)]
    assert pairs(T.slice_links(a, b, la, lb, x, y, "slice")) == [(1, 4), (1, 5), (2, 4), (2, 5), (3, 6), (3, 7)]
    # an empty last token ends where the one before it ends
    one, two = np.array([1]), np.array([2])
    assert pairs(T.slice_links(np.array([1, 2]), np.array([4]), np.array([3, 0]), np.array([3]), two, one, "end")) == [(1, 4), (2, 4)]
    none = T.cuts([], [])
    assert len(none[0]) == 0 and T.GroupText(1, 1)(a[:0], b[:0], *none) == "" and not len(T.slice_links(a, b, la, lb, *none, "end"))
    with pytest.raises(ValueError):
        T.align(None, p=T.Align(links="other"))


def test_ranked_encoding_equals_the_tokenizer_file(encoders):
    enc = encoders[0]
    odd = [" it's we'll  x\n\n y 123abc ÄÖ", " " + " \n" * 3000 + "x", " " + "  " * 1500, " 漢字" * 50, " 😀👨‍👩‍👧 ǅ ٣ ⅷ _ -- <|endoftext|>"]
    odd += [f" a{chr(c)}b {chr(c)} 1{chr(c)}2{chr(c)}.{chr(c)}{chr(c)} x" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert enc(odd) == [enc.own.encode(t, add_special_tokens=False).ids for t in odd]

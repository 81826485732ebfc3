"""What the corpus pipeline leaves on the driver."""

import tracemalloc
from itertools import combinations_with_replacement

import numpy as np

from notecover.llm import common as C
from notecover.llm import minhash, packing


def test_patterns_of_all_lengths_take_little_memory():
    count = np.random.default_rng(0).integers(1, 5000, 2049)
    count[0] = 0
    tracemalloc.start()
    try:
        packing.patterns(count, packing.Packing())
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6                                   # all pairs of lengths at once took 113 MB


def test_patterns_as_by_force():
    rng = np.random.default_rng(1)
    for cap, most in ((5, 100), (40, 7), (150, 30), (150, 30_000)):
        count = rng.integers(0, 4, cap + 1)
        count[0] = 0
        have = [n for n in range(1, cap + 1) if count[n]]
        triples = [t[::-1] for t in combinations_with_replacement(have, 3) if sum(t) == cap]
        triples.sort(key=lambda t: (-min(count[n] for n in t), t))
        got = packing.patterns(count, packing.Packing(capacity=cap, max_triples=most))
        assert [t for t in got if len(t) == 3] == triples[:most]


def test_second_components_start_from_the_first(spark, monkeypatch):
    """The links found last join the components so far, not all links once more."""
    given = []
    found = C.components

    def noted(edges, *a):
        given.append({tuple(sorted(r)) for r in edges.filter("u != v").collect()})
        return found(edges, *a)

    monkeypatch.setattr(minhash.C, "components", noted)
    # a chain a - b - c - d of sets, and a pair of roots that only the last links join
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "u bigint, v bigint")
    last = spark.createDataFrame([(8, 1)], "u bigint, v bigint")
    monkeypatch.setattr(minhash, "_verified", lambda *a: links)
    monkeypatch.setattr(minhash, "_across", lambda *a: last)
    docs = spark.createDataFrame([(i, f"one two three four five six {i}") for i in range(3)], "doc_id bigint, text string")
    minhash._classes(docs, C.cut_lineage(minhash.sketches(docs, minhash.MinHash())), minhash.MinHash())
    assert given == [{(1, 2), (2, 3), (3, 4), (8, 9)}, {(1, 2), (1, 3), (1, 4), (8, 9), (1, 8)}]

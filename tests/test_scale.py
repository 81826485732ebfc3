"""Work that must not grow faster than the input: rows dealt over the cluster, texts handled once,
and the fast forms of costly steps against plain ones."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as E
from notecover.functions import lcs
from notecover.functions import text as T
from notecover.operators import prompt as PM
from notecover.operators import score as SC
from notecover.operators import similarity as SIM
from notecover.sources.tables import spread
from conftest import SF_SMALL


def above_the_join(df, word):
    """Whether ``word`` stands in the optimised plan above its first join."""
    txt = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in txt
    return word in txt[:txt.index("Join")]


def test_one_row_group_is_dealt_over_the_cluster(spark, scratch):
    """a scan of many cuts, of which one holds the only row group."""
    spark.range(4000).select("id", F.repeat(F.md5(F.col("id").cast("string")), 20).alias("text")).coalesce(1).write.parquet(f"{scratch}/t")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        scan = spark.read.parquet(f"{scratch}/t")
        busy = spread(scan, "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set(key, before)
    assert len(busy) > spark.sparkContext.defaultParallelism and sum(r["count"] for r in busy) == 4000


def test_pair_encoding_tokenises_before_the_fan_out(spark):
    assert not above_the_join(E.queries()["pair_encoding"](spark, SF_SMALL), "regexp_extract_all")


def test_pair_encoding_with_and_without_tokens(spark):
    rows = [(1, "a b, c", "x y"), (2, "a " * 300, "b " * 300), (3, None, None), (4, "one", "Two. " * 200)]
    df = spark.createDataFrame(rows, "pair_id int, idea_unit string, note_text string")
    cols = ("pair_id", "n_idea_kept", "n_note_kept", "n_real", "tokens_text", "input_ids", "attention_mask", "token_type_ids")
    n, t = PM.encoding_tokens("idea_unit")
    m, u = PM.encoding_tokens("note_text")
    ready = df.select("*", n.alias("n"), t.alias("t"), m.alias("m"), u.alias("u"))
    plain = PM.pair_encoding(df).select(*cols).collect()
    assert plain == PM.pair_encoding(ready, idea_tokens=(F.col("n"), F.col("t")), note_tokens=(F.col("m"), F.col("u"))).select(*cols).collect()
    assert [(r["n_idea_kept"], r["n_note_kept"], len(r["input_ids"])) for r in plain] == [(4, 2, 256), (127, 126, 256), (0, 0, 256), (1, 252, 256)]


def edit_dp(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def test_edit_distance_against_the_table():
    r = random.Random(7)
    for _ in range(600):
        chars = r.choice(("ab", "abcdé ", "abcdefgh\U0001d11e "))
        a, b = ("".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(2))
        assert lcs.edit_distance(a, b) == edit_dp(a, b)
    a, b = "the quick brown fox " * 40, "quick the fax brown jumps " * 9
    assert lcs.edit_distance(a, b) == edit_dp(a, b)


def test_levenshtein_on_a_table_is_the_expression(spark):
    rows = [(1, "b a", "a b"), (2, "", ""), (3, None, "x"), (4, "café noir", "cafe noir"), (5, "kitten " * 90, "sitting on"), (None, "a", "b"), (5, "q", "q")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = lcs.with_levenshtein_ratio(df, T.strip_lower("a"), T.strip_lower("b"), "r")
    want = df.withColumn("r", T.levenshtein_ratio(T.strip_lower("a"), T.strip_lower("b")))
    assert got.columns == want.columns and sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    assert "levenshtein(" not in E.queries()["fuzzy_levenshtein"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def loop_of(spark, df):
    """Generated code of the stage that loops over a broadcast join's matches, from that loop on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
        code = debug.codegenString(df.select("*")._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = [s for s in code.split("== Subtree") if "_matches_0.hasNext()" in s]
    assert stages
    return stages


def test_notes_are_tokenised_outside_the_loop_over_their_pairs(spark):
    """generated code puts columns of the large side off until they are read in the loop."""
    for name in ("aligned_span", "batch_budget", "pair_encoding"):
        assert not any(".find()" in s for s in loop_of(spark, E.queries()[name](spark, SF_SMALL))), name


def test_idea_positions_come_with_the_ideas(spark):
    """one join on the topic carries the order, the pairs are not joined again."""
    txt = E.queries()["aligned_span"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    top = txt[:txt.index("documents.parquet")] if "documents.parquet" in txt else txt
    assert top.index("Join Inner") < (top.index("Join LeftOuter") if "Join LeftOuter" in top else len(txt))


def test_scorer_keeps_token_sets():
    """a note is tokenised once for the pairs that follow one another, with the plain values."""
    import pandas as pd
    b = pd.DataFrame({"idea_unit": ["A b.", "c", None, "x y"], "note": ["a B; c"] * 3 + [None]})
    seen, plain = [], SC.overlap_tokens_py
    SC.overlap_tokens_py = lambda s: seen.append(s) or plain(s)
    try:
        got = SC.lexical_scorer_factory("idea_unit", "note")()(b)
    finally:
        SC.overlap_tokens_py = plain
    assert list(got["yes_logit"]) == [SC.overlap_py(i, n) for i, n in zip(b["idea_unit"], b["note"])] == [1.0, 1.0, 0.0, 0.0]
    assert seen.count("a B; c") == 1


def test_cosine_counts_tokens(spark):
    r = random.Random(3)
    words = ["aa", "bb", "Bb", "cc", "é1", "x", "_q", ",", "dd.ee"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12))) or None, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(300)]
    import regex

    def cosine(a, b):
        x, y = (Counter(regex.findall(T.TOK2, (s or "").lower())) for s in (a, b))
        n = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
        return sum(v * y[k] for k, v in x.items()) / math.sqrt(n) if n else 0.0
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {r["id"]: r["c"] for r in SIM.cosine_tf(df, "id", "a", "b", "c").collect()}
    assert got == {i: cosine(a, b) for i, a, b in rows}
    plan = SIM.cosine_tf(df, "id", "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "dot" not in plan                   # F11: no fold of six fields over every token


def test_lemmatise_moves_ids_not_words(spark):
    """with a small lemma table the words stay in their row; rows of one id count as one text."""
    rows = [(1, "The cats saw dogs."), (2, None), (3, "idk, cats!"), (3, "dogs CATS"), (None, "cats"), (None, "dogs"), (4, "été's cats")]
    df = spark.createDataFrame(rows, "id long, t string")
    lem = spark.createDataFrame([("cats", "cat"), ("dogs", "dog"), ("saw", None), (None, "none")], "word string, lemma string")
    few = df.filter("id is null or id <> 3")
    out = SIM.lemmatise(few, "id", "t", lem)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for frame in (df, few):
        got = SIM.lemmatise(frame, "id", "t", lem)
        words = SIM._lemmatise_exploded(frame, "id", "t", lem.selectExpr("word as _w", "lemma as _l"), "t_clean")
        assert got.columns == words.columns and sorted(got.collect(), key=repr) == sorted(words.collect(), key=repr)
    assert {r["id"]: r["t_clean"] for r in got.collect()} == {1: "the cat saw dog", 2: "", 4: "été s cat", None: ""}


def test_full_notes_deals_pairs_wide(spark):
    """pairs of few bytes are not gathered in few tasks before the text work."""
    from notecover.plans.q_chains import _span_features
    from notecover.sources.tables import wide
    txt = _span_features(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert any("RepartitionByExpression [" in line and line.rstrip().endswith(f"{wide(spark)}") for line in txt.splitlines())


def test_common_subsequence_of_a_contained_text(spark):
    """a text whose characters stand in the other in order needs no table."""
    seen, plain = [], lcs._char_masks
    lcs._char_masks = lambda *a: seen.append(a) or plain(*a)
    try:
        assert lcs.lcs_length("a quick brown fox", "qkbx") == 4 and lcs.edit_distance("a quick brown fox", "qkbx") == 13
        assert lcs.lcs_length("", "abc") == 0 and lcs.edit_distance("abc", "") == 3 and not seen
        assert lcs.lcs_length("abc", "cb") == 1 and seen
    finally:
        lcs._char_masks = plain

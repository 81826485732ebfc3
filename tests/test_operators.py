"""Smaller operators not covered by a registered query of their own."""

from pyspark.sql import functions as F

from notecover.operators import pairs as PR
from notecover.operators import prompt as PM
from notecover.operators import similarity as SIM


def test_lemmatise_keeps_order(spark):
    df = spark.createDataFrame([(1, "The cats were running, fast!"), (2, "")], "id long, t string")
    lem = spark.createDataFrame([("cats", "cat"), ("were", "be"), ("running", "run")], "word string, lemma string")
    got = {r["id"]: r["t_clean"] for r in SIM.lemmatise(df, "id", "t", lem).collect()}
    assert got == {1: "the cat be run fast", 2: ""}


def test_head_truncate(spark):
    df = spark.createDataFrame([("a b, c d e",)], "p string")
    assert df.select(PM.head_truncate(F.col("p"), 3)).first()[0] == "a b ,"


def test_keep_lengths_longest_first(spark):
    cases = [(3, 20, 10, 3, 7), (20, 3, 10, 7, 3), (10, 10, 10, 5, 5), (10, 10, 11, 6, 5), (2, 3, 10, 2, 3)]
    df = spark.createDataFrame([c[:3] for c in cases], "la int, lb int, room int")
    ka, kb = PM.keep_lengths(F.col("la"), F.col("lb"), F.col("room"))
    got = [(r[0], r[1]) for r in df.select(ka, kb).collect()]
    assert got == [(c[3], c[4]) for c in cases]


def test_segment_text_fanout_and_dedup(spark):
    pairs = spark.createDataFrame([(1, "t", 5, 2), (2, "t", 6, 9)], "pair_id long, topic string, id long, segment int")
    notes = spark.createDataFrame([("t", 5, "a", "b", None, None), ("t", 5, "x", "y", None, None)],
                                  "topic string, id long, segment1_notes string, segment2_notes string, "
                                  "segment3_notes string, segment4_notes string")
    fan = PR.segment_text(pairs, notes)
    assert fan.filter("pair_id = 1").count() == 2                       # duplicate notes fan out
    assert fan.filter("pair_id = 2").first()["segment_text"] == ""      # no note, invalid segment
    ded = PR.segment_text(pairs, notes.withColumn("ord", F.lit(0)), dedup=True, order_cols=["segment1_notes"])
    assert [r["segment_text"] for r in ded.filter("pair_id = 1").collect()] == ["b"]


def test_construct_pairs_counts(spark):
    notes = spark.createDataFrame([("t", 1, "a", None, "c", "d"), ("u", 2, "e", "f", "g", "h")],
                                  "topic string, id long, segment1_notes string, segment2_notes string, "
                                  "segment3_notes string, segment4_notes string")
    ideas = spark.createDataFrame([("t", "i1", 0), ("t", "i2", 1), ("u", "i3", 2)], "topic string, idea_unit string, pos long")
    assert PR.construct_pairs(notes, ideas).count() == 3 * 2 + 4 * 1


def test_attach_experiment_unk(spark):
    train = spark.createDataFrame([("t", 1), ("t", 9)], "topic string, id long")
    notes = spark.createDataFrame([("t", 1, "E2"), ("t", 1, "E1")], "topic string, id long, experiment string")
    got = {r["id"]: r["experiment"] for r in PR.attach_experiment(train, notes, ("experiment",)).collect()}
    assert got == {1: "E1", 9: "UNK"}

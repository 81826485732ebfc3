"""Sources, sinks and the streaming scorer."""

import os

from pyspark.sql import functions as F

from notecover.sources import fixtures as FX
from notecover.sources import io as IO
from notecover.streaming import scoring as ST
from conftest import SF_SMALL


def test_csv_encodings(spark, scratch):
    a, b, c = (os.path.join(scratch, n) for n in ("a.csv", "b.csv", "c.csv"))
    open(a, "wb").write(b"Topic ,ID\n\x93a\x94,1\n\xe9,2\n")
    open(b, "wb").write(b"\xef\xbb\xbfTopic,ID\nx,1\n")
    open(c, "wb").write(b'Topic,ID\n"a\nb",1\nc,2,3,4\n')
    enc = IO.detect_encodings(spark, [a, b])
    assert sorted(enc.values()) == ["UTF-8", "windows-1252"]
    df = IO.read_csv_smart(spark, [a, b])
    assert df.columns == ["Topic", "ID"]
    assert sorted(r["Topic"] for r in df.collect()) == ["x", "é", "“a”"]
    assert IO.read_csv_lenient(spark, c, ["Topic", "ID"]).count() == 1
    got = [r["Topic"] for r in IO.read_csv_smart(spark, [a]).collect()]      # no session setting needed
    assert "“a”" in got and "é" in got
    d = os.path.join(scratch, "d.csv")
    open(d, "wb").write(b"Topic,ID\n\x81\xe9,1\n")                           # a byte cp1252 does not have
    assert list(IO.detect_encodings(spark, [d]).values()) == ["ISO-8859-1"]
    assert IO.read_csv_smart(spark, [d]).first()["Topic"] == "\x81é"


def test_load_dataset_and_sinks(spark, scratch):
    folder = os.path.join(scratch, "data")
    os.makedirs(folder)
    open(os.path.join(folder, "Notes.csv"), "w").write(
        "Experiment,Topic,ID,Segment1_Notes,Segment2_Notes,Segment3_Notes,Segment4_Notes\nE1, Physics ,7,a,b,,d\n")
    open(os.path.join(folder, "train.csv"), "w").write(
        "Topic,ID,Segment,IdeaUnit,label\nPhysics,7,2.0,idea one,1\nPhysics,x,1,idea two,0\nPhysics,7,5,idea,1\n")
    open(os.path.join(folder, "test.csv"), "w").write("Topic,ID,Segment,IdeaUnit\nPhysics,7,1,idea one\n")
    notes, train, test = IO.load_dataset(spark, folder)
    assert notes.first()["topic"] == "Physics" and train.count() == 1 and test.count() == 1
    IO.write_table(train, os.path.join(scratch, "out"), "csv", columns=["topic", "id", "label", "missing"])
    back = spark.read.option("header", True).csv(os.path.join(scratch, "out"))
    assert back.columns == ["topic", "id", "label"]
    open(os.path.join(folder, "bert_eval_predictions.csv"), "w").write("label,prediction\n1,1\n")
    assert IO.find_prediction_file(spark, folder).endswith("bert_eval_predictions.csv")


def test_streaming_matches_batch(spark, scratch):
    pairs = FX.pairs(spark, SF_SMALL).select("pair_id", "id", "topic", "pos")
    src = os.path.join(scratch, "pairs")
    pairs.repartition(3).write.parquet(src)
    docs = FX.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    notes = ST.note_sets(docs)
    ideas = FX.ideas(spark, SF_SMALL)
    q = ST.start_scoring(spark, src, notes, ideas, os.path.join(scratch, "sink"), os.path.join(scratch, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(scratch, "sink"))
    want = ST.score_pairs(pairs, notes, ideas)
    assert got.count() == want.count() == pairs.count()
    assert got.exceptAll(want).count() == 0


def test_streaming_picks_up_new_files_once(spark, scratch):
    pairs = FX.pairs(spark, SF_SMALL).select("pair_id", "id", "topic", "pos")
    src, sink, ckpt = (os.path.join(scratch, n) for n in ("in", "out", "ck"))
    first, second = pairs.filter("pair_id % 2 = 0"), pairs.filter("pair_id % 2 = 1")
    first.write.parquet(os.path.join(src, "b1"))
    docs = FX.table(spark, SF_SMALL, "documents").select(F.col("doc_id").alias("id"), "text")
    notes, ideas = ST.note_sets(docs), FX.ideas(spark, SF_SMALL)
    ST.start_scoring(spark, src + "/*", notes, ideas, sink, ckpt).awaitTermination(300)
    n1 = spark.read.parquet(sink).count()
    second.write.parquet(os.path.join(src, "b2"))
    ST.start_scoring(spark, src + "/*", notes, ideas, sink, ckpt).awaitTermination(300)
    out = spark.read.parquet(sink)
    assert n1 == first.count()
    assert out.count() == pairs.count() and out.select("pair_id").distinct().count() == pairs.count()


def test_checkpoint_dir_from_session(spark, scratch):
    from notecover.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir() is not None


def test_lenient_read_pads_short_and_skips_long_records(spark, scratch):
    p = os.path.join(scratch, "lenient.csv")
    open(p, "w").write('a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x\ny",,\n\n10,"q,r",12,\n,,\n')
    got = [tuple(r) for r in IO.read_csv_lenient(spark, p, ["a", "b", "c"]).collect()]
    assert got == [("1", "2", "3"), ("4", "5", None), ("x\ny", None, None), (None, None, None)]
    assert tuple(IO.lenient_report(spark, p, ["a", "b", "c"]).first()) == (6, 4, 1, 2)
    bad = IO.skipped_records(spark, p, ["a", "b", "c"]).collect()
    assert [(r.a, r.record.strip(), r.n_fields) for r in bad] == [("6", "6,7,8,9", 4), ("10", '10,"q,r",12,', 4)]
    assert IO.read_csv_lenient(spark, p, ["a", "b", "c"]).count() == 4                  # also when no column is read


def test_paths_with_odd_characters(spark, scratch):
    for i, name in enumerate(["a b.csv", "c%20d#e.csv", "f+g.csv", "plain.csv"]):
        open(os.path.join(scratch, name), "w", encoding="utf-8").write(f"Topic,ID\n\u00e9{i},{i}\n")
    df = IO.read_csv_smart(spark, scratch)
    assert sorted(r.Topic for r in df.collect()) == ["\u00e90", "\u00e91", "\u00e92", "\u00e93"]
    assert [r.Topic for r in IO.read_csv_smart(spark, os.path.join(scratch, "a b.csv")).collect()] == ["\u00e90"]


def test_file_positions_run_over_all_files(spark, scratch):
    sizes = [("a.csv", 3, "utf-8"), ("b.csv", 5000, "utf-8"), ("c d.csv", 40, "cp1252"), ("e.csv", 700, "utf-8")]
    want, n = {}, 0
    for name, rows, enc in sizes:
        with open(os.path.join(scratch, name), "wb") as f:
            f.write(b"Topic,ID\n")
            for k in range(rows):
                f.write(f'"{name} \u00e9\n{k}",{k}\n'.encode(enc))
                want[f"{name} \u00e9\n{k}"] = n
                n += 1
    df = IO.read_csv_smart(spark, scratch, position_col="row_pos")
    assert df.columns == ["Topic", "ID", "row_pos"]
    assert {r.Topic: r.row_pos for r in df.collect()} == want
    moved = df.limit(0).unionByName(df).repartition(7).filter("ID >= 0")               # positions do not depend on the plan around
    assert {r.Topic: r.row_pos for r in moved.collect()} == want
    only = os.path.join(scratch, "b.csv")
    assert [r.row_pos for r in IO.read_csv_latin1(spark, only, position_col="p").orderBy("p").select("p").withColumnRenamed("p", "row_pos").collect()] == list(range(5000))

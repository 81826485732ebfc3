"""End to end on CSV files shaped like the reference's inputs (Notes.csv, train.csv, test.csv)."""

import os

from pyspark.sql import functions as F

from notecover.operators import align as AL
from notecover.operators import pairs as PR
from notecover.operators import record as R
from notecover.operators import score as SC
from notecover.operators import split as SP
from notecover.sources import io as IO


def _write_inputs(folder):
    os.makedirs(folder)
    notes = ["Experiment,Topic,ID,Segment1_Notes,Segment2_Notes,Segment3_Notes,Segment4_Notes"]
    train = ["Topic,ID,Segment,IdeaUnit,label"]
    test = ["Experiment,Topic,ID,Segment,IdeaUnit"]
    ideas = ["energy comes in quanta", "light is a wave", "electrons have spin", "atoms emit photons"]
    for i in range(40):
        segs = [f"notes {i} about {ideas[s]} and more" if (i + s) % 3 else "" for s in range(4)]
        notes.append(f"E{i % 2},Physics,{i}," + ",".join(segs))
        for s, idea in enumerate(ideas):
            row = f"Physics,{i},{s + 1},{idea}"
            if i < 30:
                train.append(row + f",{int((i + s) % 3 != 0)}")
            else:
                test.append(f"E{i % 2}," + row)
    for name, lines in (("Notes.csv", notes), ("train.csv", train), ("test.csv", test)):
        open(os.path.join(folder, name), "w").write("\n".join(lines) + "\n")


def test_aligned_flow_on_csv(spark, scratch):
    folder = os.path.join(scratch, "data")
    _write_inputs(folder)
    notes, train, test = IO.load_dataset(spark, folder)                      # IO-4, PF-3 ... PF-5
    train = train.withColumnRenamed("row_pos", "pair_id")                    # file positions as row ids
    test = test.withColumnRenamed("row_pos", "pair_id")
    train = PR.attach_experiment(train, notes, ("row_pos",))                 # J-1
    order = AL.idea_order(train, test, "pair_id")                            # W-1
    spans = AL.aligned_span(AL.idea_position(PR.full_notes(train, notes, order_cols=("row_pos",)), order))
    # J-3, J-4, F-10 ... F-14
    assert spans.count() == train.count() == 120
    val = SP.random_split(spans, 42, 0.2).filter("split = 'val'")           # W-5
    assert val.count() == 24
    scored = SC.batch_score(val.select("pair_id", "label", "idea_unit", "note_text"),
                            SC.lexical_scorer_factory("idea_unit", "note_text"),
                            "yes_logit double, no_logit double", keep=("pair_id", "label"))   # X-3
    rec = R.metric_record(scored.select(F.col("label").alias("y"), F.col("yes_logit").alias("score"),
                                        SC.yes_no_label().alias("pred")), model_pred="pred")  # A-22
    rows = {r["decision"]: r for r in rec.collect()}
    assert set(rows) == {"model", "threshold"} and rows["threshold"]["n_eval"] == 24

"""Stateless pair scoring on a stream of pairs (Structured Streaming).

The reference reads whole files and has no stream state, watermark or window, so only
its stateless steps apply: each micro-batch of pairs is joined to static tables (the
note token sets, the idea token sets) and scored with the same column expressions as
the batch path (F-9 overlap, F-17 threshold). Stream-static joins keep no state; the
sink is exactly-once through the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notecover.functions import text as T
from notecover.operators.joins import join_small


def note_sets(notes_text: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Static side: one F-9 token set per note, computed once."""
    return notes_text.select(F.col(id_col).alias("id"), T.overlap_tokens(text_col).alias("note_set"))


def score_pairs(pairs: DataFrame, notes: DataFrame, ideas: DataFrame, threshold: float = 0.2) -> DataFrame:
    """pairs (pair_id, id, topic, pos) -> (pair_id, score, prediction); works on a batch or a
    streaming ``pairs`` frame. ``ideas`` (topic, pos, idea_unit) is broadcast after a size check."""
    idea_sets = ideas.select("topic", "pos", T.overlap_tokens("idea_unit").alias("idea_set"))
    j = join_small(pairs.join(notes, "id"), idea_sets, ["topic", "pos"], salt_from="pair_id")
    score = T.overlap_of_sets(F.col("idea_set"), F.col("note_set"))
    return j.select("pair_id", score.alias("score"), (score >= F.lit(float(threshold))).cast("int").alias("prediction"))


def start_scoring(spark: SparkSession, pairs_dir: str, notes: DataFrame, ideas: DataFrame, sink_dir: str,
                  checkpoint: str, threshold: float = 0.2, available_now: bool = True) -> StreamingQuery:
    """Score every new parquet file of pairs in ``pairs_dir`` into ``sink_dir`` (parquet).

    ``checkpoint`` must be on storage every executor and the driver share."""
    schema = "pair_id BIGINT, id BIGINT, topic STRING, pos BIGINT"
    stream = spark.readStream.schema(schema).parquet(pairs_dir)
    out = score_pairs(stream, notes, ideas, threshold)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()

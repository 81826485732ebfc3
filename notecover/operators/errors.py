"""Error analysis tables (PF-17, PF-21, S-1 ... S-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notecover.operators.split import hash_order


def eval_examples(df: DataFrame, y="label", pred="prediction", score="prob_1", text_1="idea_unit",
                  text_2="note_text", id_col="id", segment="segment", keep=()) -> DataFrame:
    """PF-21 + PF-17: the flat examples table of the error report (``keep``: extra columns first)."""
    sc = F.col(score).cast("double") if score and score in df.columns else F.lit(None).cast("double")
    return df.select(*keep, F.col(y).cast("int").alias("true_label"), F.col(pred).cast("int").alias("pred_label"),
                     sc.alias("pred_prob_pos"), F.col(text_1).alias("text_1"), F.col(text_2).alias("text_2"),
                     F.col(id_col).alias("ID"), F.col(segment).alias("Segment"),
                     (F.col(y).cast("int") == F.col(pred).cast("int")).alias("correct"))


def top_false_positives(ex: DataFrame, k: int = 50, tiebreak: str = "ID") -> DataFrame:
    """S-2: true 0 predicted 1, highest score first (top-k, no full sort)."""
    return ex.filter((F.col("true_label") == 0) & (F.col("pred_label") == 1)) \
        .orderBy(F.col("pred_prob_pos").desc(), F.col(tiebreak).asc()).limit(k)


def top_false_negatives(ex: DataFrame, k: int = 50, tiebreak: str = "ID") -> DataFrame:
    """S-3: true 1 predicted 0, lowest score first."""
    return ex.filter((F.col("true_label") == 1) & (F.col("pred_label") == 0)) \
        .orderBy(F.col("pred_prob_pos").asc(), F.col(tiebreak).asc()).limit(k)


def random_errors(ex: DataFrame, kind: str = "fp", k: int = 50, seed: int = 42, id_col: str = "ID") -> DataFrame:
    """S-4: without scores, a hash-random sample of k errors of the given kind."""
    cond = ((F.col("true_label") == 0) & (F.col("pred_label") == 1)) if kind == "fp" else \
        ((F.col("true_label") == 1) & (F.col("pred_label") == 0))
    return ex.filter(cond).withColumn("_h", hash_order(seed, id_col)).orderBy("_h", id_col).limit(k).drop("_h")


def first_examples(ex: DataFrame, k: int = 20, order_col: str = "ID") -> DataFrame:
    """S-5: the first k examples by id."""
    return ex.orderBy(order_col).limit(k)

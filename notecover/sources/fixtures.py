"""Map the test-data tables onto the reference's data model (notes, ideas, pairs, ...).

Each fixture is a deterministic expression over the given tables, written once as a
Spark DataFrame builder and once as a SQL CTE (``SQL``) that the DuckDB oracle runs.
The two must stay in sync; tests compare them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notecover.functions import text as T
from notecover.operators.joins import join_small
from notecover.sources.tables import spread, table

SEGMENTS = ("segment1_notes", "segment2_notes", "segment3_notes", "segment4_notes")
SEEDS = (42, 43, 44)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> wide notes: experiment=lang, topic=source, id=doc_id, 4 quarter segments."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    d = d.withColumn("_q", F.expr("(length(text) + 3) div 4"))          # segment length, once per note
    segs = [F.nullif(F.expr(f"substring(text, {s - 1} * _q + 1, _q)"), F.lit("")).alias(SEGMENTS[s - 1])
            for s in (1, 2, 3, 4)]
    return d.select(F.col("lang").alias("experiment"), F.col("source").alias("topic"),
                    F.col("doc_id").alias("id"), *segs)


def ideas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark -> ideas: topic = 'src' || item_id % 20, pos = item_id."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("topic"),
                    F.col("text").alias("idea_unit"), F.col("item_id").alias("pos"))


def pairs(spark: SparkSession, sf_dir: str, with_text: bool = False, carry=None, labels: bool = True,
          idea_carry=None) -> DataFrame:
    """J-7: every idea of a topic x every note of that topic, with the label of the note unless
    ``labels`` is off: a query that does not read labels does not join them.

    The idea table is the small side (ideas per topic are bounded), so the topic join is a
    broadcast hash join after a size check; the fan-out per note is the topic's idea count.
    ``carry`` maps the notes frame to extra per-note columns (e.g. token arrays computed
    once per note) that ride along the fan-out instead of being joined back later;
    ``idea_carry`` does the same for the ideas frame. What a note carries is worked out once
    (:func:`text.once`), not once per pair.
    """
    n = notes(spark, sf_dir)
    extra = []
    if carry is not None:
        n = carry(n)
        extra = [c for c in n.columns if c not in ("experiment", "topic", "id") + SEGMENTS]
    texts = [T.once(F.array(*SEGMENTS)).alias("_texts")] if with_text else []
    n = n.select("experiment", "topic", "id", *[T.once(c).alias(c) for c in extra], *texts)
    # labels belong to notes: joined per note, so no exchange above the fan-out carries text
    if labels:
        n = n.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), "id", "left")
    i = ideas(spark, sf_dir)
    if idea_carry is not None:
        plain = i.columns
        i = idea_carry(i)
        extra += [c for c in i.columns if c not in plain]
    p = join_small(n, i, ["topic"], salt_from="id")
    seg = ((F.col("id") + F.col("pos")) % 4 + 1).cast("int")
    cols = [(F.col("id") * 100000 + F.col("pos")).alias("pair_id"), "experiment", "topic", "id",
            seg.alias("segment"), "idea_unit", "pos", *(["label"] if labels else [])]
    if with_text:
        cols += [F.coalesce(F.element_at("_texts", seg), F.lit("")).alias("segment_text")]
    return p.select(*cols, *extra)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs with score = lexical overlap(idea, whole note text), prediction = score >= 0.2.

    Each note is tokenised once, before the pair fan-out; the join carries the token set.
    """
    d = spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("lang").alias("experiment"), F.col("source").alias("topic"), F.col("doc_id").alias("id"),
        T.once(T.overlap_tokens("text")).alias("note_set"))
    i = ideas(spark, sf_dir).select("topic", "pos", T.overlap_tokens("idea_unit").alias("idea_set"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"),
                                                F.col("quality").alias("y"))
    seg = ((F.col("id") + F.col("pos")) % 4 + 1).cast("int")
    p = join_small(d.join(lab, "id"), i, ["topic"], salt_from="id")
    score = T.overlap_of_sets(F.col("idea_set"), F.col("note_set"))
    return p.select((F.col("id") * 100000 + F.col("pos")).alias("pair_id"), "experiment", "topic",
                    "id", seg.alias("segment"), F.col("y").cast("int").alias("y"),
                    score.alias("score"), (score >= 0.2).cast("int").alias("prediction"))


def scored_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     (F.col("l_quantity") / 50.0).alias("score"),
                     F.col("l_linestatus").alias("grp1"), F.col("l_linenumber").alias("grp2"))


def scored_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("id"),
                     F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("topic"),
                     (F.col("event_type") == "purchase").cast("int").alias("y"),
                     F.col("value").alias("score"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.when(F.col("id") % 17 == 0, F.lit("bad")).otherwise(
        F.concat(F.lit("["), (F.col("id") % 7).cast("string"), F.lit(".5, "),
                 (F.col("id") % 5).cast("string"), F.lit(".25]")))
    return scored_fine(spark, sf_dir).select("id", "topic", "y", z.alias("z"))


def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("y"),
                    ((F.col("label") + (F.col("vec_id") % 5 == 0).cast("int")) % 10).alias("y_pred"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule-scorer input built from whole texts: correct answer = the idea; response by id % 5:
    0 the idea, 1 the idea without letter 'e', 2 the idea followed by the note segment,
    3 the note segment, 4 'idk'. Label 1 for 0 and 1, 0 for 2, -1 for 3 and 4."""
    p = pairs(spark, sf_dir, with_text=True, labels=False)
    k = F.col("id") % 5
    resp = (F.when(k == 0, F.col("idea_unit"))
            .when(k == 1, F.replace(F.col("idea_unit"), F.lit("e"), F.lit("")))
            .when(k == 2, F.concat(F.col("idea_unit"), F.lit(" "), F.col("segment_text")))
            .when(k == 3, F.col("segment_text"))
            .otherwise(F.lit("idk")))
    lab = F.when(k <= 1, 1).when(k == 2, 0).otherwise(-1)
    return p.select("pair_id", F.col("topic").alias("question"), resp.alias("response"),
                    F.col("idea_unit").alias("correct_answer"), lab.alias("label"))


def conv_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations -> wide notes: id = conv_id, segment = turn % 4 + 1, the turns of a cell
    joined by one space in turn order. One aggregate per (conversation, segment) cell, then
    a pivot over the four fixed segment numbers (no per-row Python)."""
    c = table(spark, sf_dir, "conversations")
    cells = c.groupBy(F.col("conv_id").alias("id"), ((F.col("turn") % 4) + 1).cast("int").alias("seg")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
        .alias("cell"))
    wide = cells.groupBy("id").pivot("seg", [1, 2, 3, 4]).agg(F.first("cell"))
    return wide.select("id", *[F.col(str(i)).alias(SEGMENTS[i - 1]) for i in (1, 2, 3, 4)])


def raw_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty string-typed train table (bad ids, segments outside 1-4, bad labels, padding)."""
    p = pairs(spark, sf_dir)
    cyc = F.array(*[F.lit(v) for v in ("0", "1", "2", "3", "4", "5", "2.5", "2.0")])
    id_raw = (F.when(F.col("id") % 13 == 0, F.lit("abc"))
              .when(F.col("id") % 7 == 0, F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(".0 ")))
              .otherwise(F.col("id").cast("string")))
    seg_raw = F.element_at(cyc, ((F.col("id") + F.col("pos")) % 8 + 1).cast("int"))
    lab_raw = (F.when(F.col("pair_id") % 11 == 0, F.lit(None).cast("string"))
               .when(F.col("pair_id") % 11 == 1, F.lit("x"))
               .otherwise(F.col("label").cast("string")))
    topic_raw = F.when(F.col("id") % 5 == 0, F.concat(F.lit("  "), F.col("topic"), F.lit("\t"))) \
        .otherwise(F.col("topic"))
    return p.select("pair_id", F.col("experiment").alias("experiment_raw"), topic_raw.alias("topic_raw"),
                    id_raw.alias("id_raw"), seg_raw.alias("segment_raw"),
                    F.col("idea_unit").alias("idea_unit_raw"), lab_raw.alias("label_raw"))


def raw_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes(spark, sf_dir)
    id_raw = (F.when(F.col("id") % 13 == 0, F.lit("abc"))
              .when(F.col("id") % 7 == 0, F.concat(F.lit(" "), F.col("id").cast("string"), F.lit(".0 ")))
              .otherwise(F.col("id").cast("string")))
    topic_raw = F.when(F.col("id") % 5 == 0, F.concat(F.lit("  "), F.col("topic"), F.lit("\t"))) \
        .otherwise(F.col("topic"))
    exp_raw = F.when(F.col("id") % 3 == 0, F.concat(F.col("experiment"), F.lit(" "))).otherwise(F.col("experiment"))
    return n.select(exp_raw.alias("experiment_raw"), topic_raw.alias("topic_raw"), id_raw.alias("id_raw"),
                    *SEGMENTS)


# ---------------------------------------------------------------------------
# The same fixtures as SQL common table expressions (DuckDB dialect), for the oracle.
# ---------------------------------------------------------------------------
_WS = T.WS
SQL = {
    "notes": """notes AS (
  SELECT lang AS experiment, source AS topic, doc_id AS id,
    nullif(substring(text, 1, q), '') AS segment1_notes,
    nullif(substring(text, q + 1, q), '') AS segment2_notes,
    nullif(substring(text, 2 * q + 1, q), '') AS segment3_notes,
    nullif(substring(text, 3 * q + 1, q), '') AS segment4_notes
  FROM (SELECT *, (length(text) + 3) // 4 AS q FROM documents) d)""",
    "ideas": """ideas AS (
  SELECT 'src' || CAST(item_id % 20 AS VARCHAR) AS topic, text AS idea_unit, item_id AS pos
  FROM benchmark)""",
    "pairs": """pairs AS (
  SELECT n.id * 100000 + i.pos AS pair_id, n.experiment, n.topic, n.id,
    CAST((n.id + i.pos) % 4 + 1 AS INTEGER) AS segment, i.idea_unit, i.pos, l.quality AS label,
    coalesce([n.segment1_notes, n.segment2_notes, n.segment3_notes, n.segment4_notes]
             [CAST((n.id + i.pos) % 4 + 1 AS INTEGER)], '') AS segment_text
  FROM notes n JOIN ideas i ON n.topic = i.topic LEFT JOIN labels l ON l.doc_id = n.id)""",
    "scored": f"""scored AS (
  SELECT pair_id, experiment, topic, id, segment, CAST(label AS INTEGER) AS y, score,
    CAST(score >= 0.2 AS INTEGER) AS prediction
  FROM (SELECT *, CASE WHEN len(ia) = 0 THEN 0.0
                       ELSE len(list_intersect(ia, na)) / len(ia) END AS score
        FROM (SELECT p.*,
          list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce(p.idea_unit, '')), '.,;', '   '), '{_WS}'), lambda t: t <> '')) AS ia,
          list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce(d.text, '')), '.,;', '   '), '{_WS}'), lambda t: t <> '')) AS na
          FROM pairs p JOIN documents d ON d.doc_id = p.id WHERE p.label IS NOT NULL) a) b)""",
    "scored_big": """scored_big AS (
  SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_quantity / 50.0 AS score,
    l_linestatus AS grp1, l_linenumber AS grp2 FROM lineitem)""",
    "scored_fine": """scored_fine AS (
  SELECT event_id AS id, 'u' || CAST(user_id % 20 AS VARCHAR) AS topic,
    CAST(event_type = 'purchase' AS INTEGER) AS y, value AS score FROM events)""",
    "logits": """logits AS (
  SELECT id, topic, y, CASE WHEN id % 17 = 0 THEN 'bad'
    ELSE '[' || CAST(id % 7 AS VARCHAR) || '.5, ' || CAST(id % 5 AS VARCHAR) || '.25]' END AS z
  FROM scored_fine)""",
    "multiclass": """multiclass AS (
  SELECT vec_id AS id, label AS y, (label + CAST(vec_id % 5 = 0 AS INTEGER)) % 10 AS y_pred
  FROM embeddings)""",
    "answers": """answers AS (
  SELECT pair_id, topic AS question,
    CASE id % 5 WHEN 0 THEN idea_unit WHEN 1 THEN replace(idea_unit, 'e', '')
      WHEN 2 THEN idea_unit || ' ' || segment_text WHEN 3 THEN segment_text ELSE 'idk' END AS response,
    idea_unit AS correct_answer,
    CASE WHEN id % 5 <= 1 THEN 1 WHEN id % 5 = 2 THEN 0 ELSE -1 END AS label
  FROM pairs)""",
    "raw_train": """raw_train AS (
  SELECT pair_id, experiment AS experiment_raw,
    CASE WHEN id % 5 = 0 THEN '  ' || topic || chr(9) ELSE topic END AS topic_raw,
    CASE WHEN id % 13 = 0 THEN 'abc' WHEN id % 7 = 0 THEN ' ' || CAST(id AS VARCHAR) || '.0 '
      ELSE CAST(id AS VARCHAR) END AS id_raw,
    ['0', '1', '2', '3', '4', '5', '2.5', '2.0'][CAST((id + pos) % 8 + 1 AS INTEGER)] AS segment_raw,
    idea_unit AS idea_unit_raw,
    CASE WHEN pair_id % 11 = 0 THEN NULL WHEN pair_id % 11 = 1 THEN 'x'
      ELSE CAST(label AS VARCHAR) END AS label_raw
  FROM pairs)""",
    "conv_notes": """conv_notes AS (
  SELECT id, max(cell) FILTER (WHERE seg = 1) AS segment1_notes, max(cell) FILTER (WHERE seg = 2) AS segment2_notes,
    max(cell) FILTER (WHERE seg = 3) AS segment3_notes, max(cell) FILTER (WHERE seg = 4) AS segment4_notes
  FROM (SELECT conv_id AS id, CAST(turn % 4 + 1 AS INTEGER) AS seg, string_agg(text, ' ' ORDER BY turn) AS cell
        FROM conversations GROUP BY conv_id, turn % 4 + 1) c GROUP BY id)""",
    "raw_notes": """raw_notes AS (
  SELECT CASE WHEN id % 3 = 0 THEN experiment || ' ' ELSE experiment END AS experiment_raw,
    CASE WHEN id % 5 = 0 THEN '  ' || topic || chr(9) ELSE topic END AS topic_raw,
    CASE WHEN id % 13 = 0 THEN 'abc' WHEN id % 7 = 0 THEN ' ' || CAST(id AS VARCHAR) || '.0 '
      ELSE CAST(id AS VARCHAR) END AS id_raw,
    segment1_notes, segment2_notes, segment3_notes, segment4_notes
  FROM notes)""",
}

DEPENDS = {
    "notes": (), "ideas": (), "pairs": ("notes", "ideas"), "scored": ("pairs",),
    "scored_big": (), "scored_fine": (), "logits": ("scored_fine",), "multiclass": (),
    "answers": ("pairs",), "raw_train": ("pairs",), "raw_notes": ("notes",), "conv_notes": (),
}


def with_fixtures(body: str, *names: str, extra: tuple[str, ...] = ()) -> str:
    """Prefix ``body`` with the CTEs of the named fixtures (dependencies first).

    ``extra`` holds further "name AS (...)" CTE texts placed after the fixtures.
    """
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS[n]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [SQL[n] for n in order] + list(extra)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body

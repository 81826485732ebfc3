"""CSV sources and table sinks (IO-1 ... IO-10).

Readers return DataFrames with cleaned header names (PF-1); sinks write DataFrames with
Spark writers (no pandas round trip). Paths are whatever the cluster can read: local
folders in tests, shared storage on a cluster.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecover.operators.clean import normalize_columns
from notecover.operators.joins import broadcast_if_bounded
from notecover.session import cut_lineage

# Bytes that cp1252 leaves undefined: a file holding one of them is read as ISO-8859-1.
CP1252_UNDEFINED = "\x81\x8d\x8f\x90\x9d"
# Bytes 80-9F as ISO-8859-1 reads them, and the characters they are in cp1252.
_C1 = "".join(chr(b) for b in range(0x80, 0xA0) if chr(b) not in CP1252_UNDEFINED)
_CP1252 = _C1.encode("latin-1").decode("cp1252")
# Preferred prediction file names, in order (IO-5).
PREFERRED_PREDICTIONS = ("bert_predictions.csv", "predictions.csv", "results.csv", "bert_eval_predictions.csv")


#: Where a row comes from: file, first byte of its block, number within its task.
_PLACE = ("_file", "_block", "_at")
_ROW_BITS = (1 << 33) - 1          # the part of monotonically_increasing_id that counts rows of a task


def _csv(spark: SparkSession, paths: Sequence[str], encoding: str, schema: T.StructType | None = None,
         placed: bool = False, **options) -> DataFrame:
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("encoding", encoding).options(**options))
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(list(paths))
    if not placed:
        return normalize_columns(df)
    place = (F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
             F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    return normalize_columns(df.select("*", *[c.alias(n) for c, n in zip(place, _PLACE)]))


def plain_path(uri: str) -> str:
    """A path as a reader takes it, from the percent-encoded one of a file's metadata: decoded, and
    the characters of path patterns escaped."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(uri))


def detect_encodings(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """IO-1 decision per file: UTF-8 if all its lines are valid UTF-8, else windows-1252, else
    (a byte that cp1252 leaves undefined) ISO-8859-1. No session setting takes part.

    Lines are checked as they are read, so a file may be of any size; one row per file
    that holds a line comes back. A file without lines is not listed."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), "value")
    undefined = F.regexp_like(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), F.lit("[" + CP1252_UNDEFINED + "]"))
    checked = (lines.select("path", F.is_valid_utf8("value").alias("ok"), undefined.alias("undef"))
               .groupBy("path").agg(F.bool_and("ok").alias("ok"), F.bool_or("undef").alias("undef")).collect())
    return {plain_path(r["path"]): "UTF-8" if r["ok"] else "ISO-8859-1" if r["undef"] else "windows-1252" for r in checked}


def _from_latin1(df: DataFrame) -> DataFrame:
    """cp1252 text that was read as ISO-8859-1: bytes 80-9F get their characters, in names too."""
    table = str.maketrans(_C1, _CP1252)
    return df.select(*[(F.translate(F.col(f"`{f.name}`"), _C1, _CP1252) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
                       .alias(f.name.translate(table)) for f in df.schema.fields])


def read_csv_smart(spark: SparkSession, paths: Sequence[str] | str, position_col: str | None = None) -> DataFrame:
    """IO-1: read CSV files, each with the encoding that decodes it (see detect_encodings);
    a UTF-8 BOM is dropped by the reader; header names are cleaned. ``position_col`` adds the
    file position (:func:`file_position`)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    enc = detect_encodings(spark, paths) or {p: "UTF-8" for p in paths}
    groups: dict[str, list[str]] = {}
    for p, e in enc.items():
        groups.setdefault(e, []).append(p)
    out, placed = None, position_col is not None
    for e, ps in sorted(groups.items()):
        if e == "windows-1252":
            raw = _csv(spark, ps, "ISO-8859-1", placed=placed)
            part = _from_latin1(raw)
        else:
            part = _csv(spark, ps, e, placed=placed)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return file_position(out, position_col) if placed else out


def read_csv_latin1(spark: SparkSession, paths: Sequence[str] | str, position_col: str | None = None) -> DataFrame:
    """IO-2: CSV read as ISO-8859-1 (every byte decodes), multi-line fields allowed."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    out = _csv(spark, paths, "ISO-8859-1", placed=position_col is not None)
    return file_position(out, position_col) if position_col is not None else out


def file_position(df: DataFrame, col: str) -> DataFrame:
    """The exact position of each row, from 0, over all files of a placed read in order of their
    paths, however Spark deals files to tasks.

    A block of a file is read by one task from front to back, so a row's number in its block
    is its number in the task less that of the block's first row. One pass counts the rows
    of each block (a row per block comes out, written to the checkpoint folder); running
    sums over the blocks in (path, start) order are the offsets that the read joins."""
    blocks = df.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut_lineage(blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    out = df.join(broadcast_if_bounded(offsets), ["_file", "_block"])
    return out.withColumn(col, F.col("_before") + F.col("_at") - F.col("_first")).drop(*_PLACE, "_before", "_first")


def _lenient(spark, paths, columns, encoding) -> DataFrame:
    """``columns``, and of each record whose number of fields is another one its text ``_record`` and
    that number ``_fields`` (separators outside quotes, plus one)."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_record")])
    df = _csv(spark, paths, encoding, schema, mode="PERMISSIVE", columnNameOfCorruptRecord="_record")
    # Spark refuses to read records for their text alone: nothing of the first column comes along
    nothing = F.substring(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit("")), 1, 0)
    bare = F.concat(F.regexp_replace("_record", '"([^"]|"")*"', ""), nothing)
    return df.withColumn("_fields", F.coalesce(F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1, F.lit(len(columns))))


def read_csv_lenient(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str],
                     encoding: str = "UTF-8") -> DataFrame:
    """IO-3: skip records with too many fields; those with too few are kept, the rest of their
    columns null. All columns are text (typing happens afterwards, PF-3 ... PF-5).
    :func:`lenient_report` counts what was skipped and padded."""
    df = _lenient(spark, paths, columns, encoding)
    return df.filter(F.col("_fields") <= len(columns)).drop("_record", "_fields")


def lenient_report(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """IO-3 counts, one row: records read, kept, kept but padded, skipped."""
    df, n = _lenient(spark, paths, columns, encoding), F.col("_fields")
    return df.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(n <= len(columns)).alias("n_kept"),
                  F.count_if(n < len(columns)).alias("n_padded"), F.count_if(n > len(columns)).alias("n_skipped"))


def skipped_records(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """IO-3: the skipped records: ``columns`` as far as they go, the whole text ``record`` and ``n_fields``."""
    df = _lenient(spark, paths, columns, encoding).filter(F.col("_fields") > len(columns))
    return df.withColumnsRenamed({"_record": "record", "_fields": "n_fields"})


def with_row_position(df: DataFrame, col: str = "row_pos") -> DataFrame:
    """Order within each file as a column, taken right after the scan (before any shuffle), for
    tables that were not read by this module; over several files use the readers'
    ``position_col``, which is exact. Stable when a task is recomputed."""
    return df.withColumn(col, F.monotonically_increasing_id())


def load_dataset(spark: SparkSession, folder: str, reader=read_csv_latin1,
                 position_col: str | None = "row_pos") -> tuple[DataFrame, DataFrame, DataFrame]:
    """IO-4: Notes.csv, train.csv, test.csv of a folder, typed (PF-3 ... PF-5), lower-case names,
    each with its exact file position in ``position_col``. Operators that need "first row"
    semantics (W-1, W-2, W-3) order by it. ``reader`` takes (spark, path, position_col)."""
    from notecover.operators import clean as CL

    def std(df: DataFrame) -> DataFrame:
        ren = {"Experiment": "experiment", "Topic": "topic", "ID": "id", "Segment": "segment",
               "IdeaUnit": "idea_unit", "label": "label"}
        for i in range(1, 5):
            ren[f"Segment{i}_Notes"] = f"segment{i}_notes"
        for a, b in ren.items():
            if a in df.columns:
                df = df.withColumnRenamed(a, b)
        return df

    folder = folder.rstrip("/")
    notes, train, test = (std(reader(spark, f"{folder}/{name}", position_col)) for name in ("Notes.csv", "train.csv", "test.csv"))
    CL.require_columns(train, ["topic", "id", "segment", "idea_unit", "label"], "train.csv")
    CL.require_columns(test, ["topic", "id", "segment", "idea_unit"], "test.csv")
    return CL.coerce_notes(notes), CL.coerce_pairs(train, True), CL.coerce_pairs(test, False)


def find_prediction_file(spark: SparkSession, folder: str) -> str | None:
    """IO-5: preferred names first (in order), else the newest CSV of the folder.

    Uses the file metadata columns; one small job over the listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder.rstrip("/"))
    meta = files.select("path", F.col("modificationTime").alias("mtime"))
    rank = F.lit(len(PREFERRED_PREDICTIONS))
    for i, name in reversed(list(enumerate(PREFERRED_PREDICTIONS))):
        rank = F.when(F.col("path").endswith("/" + name), F.lit(i)).otherwise(rank)
    best = meta.withColumn("rank", rank).orderBy("rank", F.col("mtime").desc()).select("path").limit(1).collect()
    return best[0]["path"] if best else None


def write_table(df: DataFrame, path: str, fmt: str = "parquet", columns: Sequence[str] | None = None,
                mode: str = "overwrite") -> None:
    """IO-6 ... IO-10: write predictions, metrics, cleaned tables, error examples or sweep
    results. ``columns`` keeps only those that exist (submission-style subset)."""
    if columns is not None:
        df = df.select(*[c for c in columns if c in df.columns])
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)

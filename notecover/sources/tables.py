"""Parquet table access for the test-data folders (one parquet per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


_READS: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a test-data folder.

    The DataFrame (a lazy scan) is reused per session and path, so building a query that
    reads a table several times does not list files and read footers again each time."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    try:
        key = (spark.sparkContext.applicationId, id(spark), path)
    except Exception:  # noqa: BLE001 - no context id available: no reuse
        return spark.read.parquet(path)
    df = _READS.get(key)
    if df is None:
        df = _READS[key] = spark.read.parquet(path)
    return df


def wide(spark: SparkSession) -> int:
    """Tasks for costly work per row: three a core, or the session's shuffle partitions if more."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread the rows of a scan over the whole cluster, for the per-row text work after it.

    The number of scan partitions does not tell how many tasks get rows: a file is cut by
    bytes, but a row group is read whole by one of the cuts, so a large table of few row groups has
    many partitions of which few hold anything. The rows are dealt by ``key`` (deterministic
    on retry) to three partitions a core, or as many as the scan has if that is more: the
    texts cross one shuffle, once, and long ones even out."""
    try:
        n = max(3 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions())
    except Exception:  # noqa: BLE001 - sessions without RDD access (Spark Connect): leave the scan as is
        return df
    return df.repartition(n, key)

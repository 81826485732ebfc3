"""Session helpers: a local session for tests/bench and a checkpoint-dir resolver."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "notecover") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the session you are given."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("NOTECOVER_DRIVER_MEM", "16g"))
    )
    if "NOTECOVER_ANSI" in os.environ:        # default: Spark's own (ANSI on in Spark 4)
        b = b.config("spark.sql.ansi.enabled", os.environ["NOTECOVER_ANSI"])
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` from the session. Only in local mode (tests) and only
    when it is unset do we create a private folder; on a cluster an unset value is an
    error, because a machine-local folder would not survive an executor loss.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if sc.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="notecover-ckpt-")
        sc.setCheckpointDir(path)
        return path
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative jobs")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession | None = None) -> None:
    """Make ``notecover`` importable in the Python workers (like ``--py-files``).

    Python UDFs and ``mapInPandas`` functions refer to this package; workers started
    outside the repository cannot import it. The package's .py files are zipped once per
    application on the driver and added with ``addPyFile``, which Spark serves to every
    executor."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    fd, path = tempfile.mkstemp(prefix="notecover-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, files in os.walk(pkg_dir):
            if "__pycache__" in dirpath:
                continue
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)

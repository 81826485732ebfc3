"""Join helpers: size-checked broadcast and salted joins for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notecover.session import cut_lineage

# Broadcast only below this many bytes (measured, not estimated) and rows.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
BROADCAST_MAX_ROWS = 2_000_000


#: Size of a side with nested columns: above every bound, so it is never broadcast.
UNMEASURED = (1 << 62, 1 << 62)

#: Join types whose rows do not depend on how the small side is shipped: a salted join
#: replicates the small side, so its unmatched rows must never be part of the result.
SAFE_JOINS = ("inner", "left", "left_semi", "left_anti")


def _check_how(how: str) -> None:
    if how not in SAFE_JOINS:
        raise ValueError(f"join type {how!r} is not supported here; use one of {SAFE_JOINS}")


def _field_bytes(f: T.StructField):
    """Payload bytes of a column, or None for a type whose content is not measured."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
        return F.coalesce(F.aggregate(c, F.lit(0), lambda acc, x: acc + F.coalesce(F.octet_length(x), F.lit(0)) + 16),
                          F.lit(0)) + 16
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(c), F.lit(0)) * 16 + 16
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return None
    return F.lit(8)


def measured_size(df: DataFrame) -> tuple[int, int]:
    """(rows, approximate bytes) of ``df`` from one aggregate job.

    Strings count their UTF-8 bytes plus 16, string arrays their elements' bytes, other
    arrays 16 bytes per element, other fields 8 bytes: an upper-bound style estimate of
    the broadcast payload. Nothing is remembered: a table replaced in place is measured
    again. Measure tables or materialised results, not a pipeline that would then run
    twice (see :func:`join_derived`)."""
    parts = [_field_bytes(f) for f in df.schema.fields]
    if any(p is None for p in parts):
        return UNMEASURED
    row_bytes = parts[0] if parts else F.lit(8)
    for p in parts[1:]:
        row_bytes = row_bytes + p
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes.cast("long")).alias("b")).first()
    return int(r["n"]), int(r["b"] or 0)


def broadcast_if_bounded(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES,
                         max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Return ``broadcast(df)`` when its measured size is under the bounds, else ``df``.

    Above the bounds the join stays a shuffle join and AQE (skew join, coalescing)
    decides at run time; callers with few, hot keys should use :func:`salted_join`.
    """
    n, b = measured_size(df)
    if n <= max_rows and b <= max_bytes:
        return F.broadcast(df)
    return df


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                buckets: int | None = None, salt_from: str | None = None) -> DataFrame:
    """Shuffle join that spreads each key over ``buckets`` tasks (by default half of the
    session's shuffle partitions, at least 32, so that one hot key can use the cluster).

    The big side gets salt = pmod(hash(salt_from or all columns), buckets); the small side
    is replicated once per salt value; only the join types of ``SAFE_JOINS`` are accepted.
    Used when the small side is too big to broadcast and a few keys hold most rows
    (e.g. topics).
    """
    _check_how(how)
    if buckets is None:
        buckets = max(32, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2)
    src = F.col(salt_from) if salt_from else F.struct(*[F.col(f"`{c}`") for c in big.columns])
    b = big.withColumn("_salt", F.pmod(F.hash(src), F.lit(buckets)))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return b.join(s, keys + ["_salt"], how).drop("_salt")


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", buckets: int | None = None,
               salt_from: str | None = None, max_bytes: int = BROADCAST_MAX_BYTES,
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a large table with a side expected to be small, keyed by few hot keys (topics).

    Broadcast when the side is measured under the bounds; otherwise a salted shuffle join
    so that no single key lands in one task."""
    _check_how(how)
    n, b = measured_size(small)
    if n <= max_rows and b <= max_bytes:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, buckets, salt_from)


def join_derived(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner",
                 salt_from: str | None = None) -> DataFrame:
    """:func:`join_small` for a side that is itself the result of a pipeline: it is written
    once to the checkpoint folder, and both the measurement and the join read that."""
    return join_small(big, cut_lineage(small), keys, how, salt_from=salt_from)

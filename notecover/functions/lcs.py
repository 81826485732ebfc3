"""F-4: token-sort Indel ratio, the one text score with no built-in Spark expression; and F-5
on tables, by the same bit-parallel means.

ratio = 2 * LCS(a, b) / (len a + len b) on whitespace-token-sorted strings (two empty
strings score 1.0). The LCS length uses the bit-parallel recurrence of Hyyrö (2004):
one big-integer update per character of the shorter string, so a pair costs
O(len_short * len_long / 64) word operations. It runs in an Arrow-batched pandas UDF;
token sorting, stripping and lowercasing stay in Spark expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from notecover.functions import text as T


def _char_masks(a: str, need: set[str]) -> dict[str, int]:
    """Bit mask of the positions of each character of ``need`` in ``a`` (bit i = a[i])."""
    masks: dict[str, int] = {}
    if len(a) > 64:                         # one comparison of all characters, packed to bits
        chars = sorted(need)
        bits = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == np.array([[ord(ch)] for ch in chars], dtype=np.uint32)
        for ch, row in zip(chars, np.packbits(bits, axis=1, bitorder="little")):
            if m := int.from_bytes(row.tobytes(), "little"):
                masks[ch] = m
    else:
        for i, ch in enumerate(a):
            if ch in need:
                masks[ch] = masks.get(ch, 0) | (1 << i)
    return masks


def is_subsequence(b: str, a: str) -> bool:
    """Whether the characters of ``b`` stand in ``a`` in their order (one scan of ``a``)."""
    at = 0
    for ch in b:
        at = a.find(ch, at) + 1
        if not at:
            return False
    return True


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings (code points)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    if is_subsequence(b, a):
        return len(b)
    masks = _char_masks(a, set(b))
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        m = masks.get(ch)
        if m is None:
            continue
        u = v & m
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel_ratio(a: str | None, b: str | None, skip_below: float | None = None) -> float:
    a = a or ""
    b = b or ""
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    if skip_below is not None:
        bound = 2.0 * min(len(a), len(b)) / total      # exact upper bound of the ratio
        if bound <= skip_below:
            return bound
    return 2.0 * lcs_length(a, b) / total


@pandas_udf(DoubleType())
def _indel_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def _indel_bounded_udf(a: pd.Series, b: pd.Series, skip: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y, s) for x, y, s in zip(a, b, skip)], dtype="float64")


def token_sort_ratio(a, b, skip_below: float | None = None) -> Column:
    """F-4 on two text columns (already stripped / lowercased as the caller wants).

    With ``skip_below``, pairs whose length bound 2*min/(la+lb) is <= skip_below get the
    bound instead of the exact ratio; use it only where every decision threshold is above
    ``skip_below`` (labels and sweeps), never where the score itself is reported.
    """
    from notecover.session import ship_package
    ship_package()
    sa, sb = T.token_sort(a), T.token_sort(b)
    if skip_below is None:
        return _indel_udf(sa, sb)
    return _indel_bounded_udf(sa, sb, F.lit(float(skip_below)))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of two strings (code points), by the bit-parallel recurrence of Myers
    (1999) in Hyyrö's form: one update of big integers per character of the shorter string."""
    if len(a) < len(b):
        a, b = b, a
    if is_subsequence(b, a):                 # the rest is inserted: no distance is less than the difference in length
        return len(a) - len(b)
    masks = _char_masks(a, set(b))
    full = (1 << len(a)) - 1
    vp, vn = full, 0
    for ch in b:                             # bits beyond the text are not cleared: nothing moves down from them
        m = masks.get(ch, 0)
        d0 = (((m & vp) + vp) ^ vp) | m | vn
        hp = vn | (full ^ (d0 | vp))
        hn = d0 & vp
        hp = (hp << 1 | 1) & full
        vp = (hn << 1) | (full ^ (d0 | hp))
        vn = hp & d0
    return len(b) + (vp & full).bit_count() - (vn & full).bit_count()


def levenshtein_ratio_py(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 - edit_distance(a, b) / longest if longest else 1.0


def with_levenshtein_ratio(df: DataFrame, a, b, out: str) -> DataFrame:
    """F-5 on a table: ``df`` with column ``out``, the values of :func:`text.levenshtein_ratio`.

    The built-in edit distance visits each cell of the table of the two texts; here a pair costs
    O(len_short * len_long / 64) word operations. Texts are sorted in Spark expressions and compared in Arrow
    batches; the other columns pass through unchanged."""
    return with_sorted_ratio(df, T.token_sort(a), T.token_sort(b), out)


def with_sorted_ratio(df: DataFrame, a: Column, b: Column, out: str) -> DataFrame:
    """:func:`with_levenshtein_ratio` of texts whose tokens are sorted already."""
    from notecover.session import ship_package
    ship_package(df.sparkSession)
    schema = StructType([*df.schema.fields, StructField(out, DoubleType())])
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [levenshtein_ratio_py(x.as_py(), y.as_py()) for x, y in zip(batch.column(n), batch.column(n + 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(ratio, pa.float64())], names=schema.names)

    return df.select("*", a.alias("_sa"), b.alias("_sb")).mapInArrow(run, schema)

"""Text scalar functions as Spark column expressions (F-1 ... F-9, F-14, F-24).

All of them are built-in expressions (regex, arrays, higher-order functions), so they
stay inside the JVM and whole-stage codegen. The one exception, the token-sort Indel
ratio, lives in ``lcs.py`` as an Arrow-batched pandas UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Regex classes that behave the same in Spark (Java regex) and in
# the SQL oracle (RE2). Python's str.split()/strip() treat every Unicode space as
# whitespace; Java's \s is ASCII only, hence the explicit WS class.
# ---------------------------------------------------------------------------
WORD_CHARS = r"\p{L}\p{N}\p{M}_"
TOK = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_\s]"     # word or single punctuation mark
WORD = r"[\p{L}\p{N}\p{M}_]+"                            # word only
TOK2 = r"[\p{L}\p{N}\p{M}_]{2,}"                         # words of 2+ characters
WS_CLASS = (r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same whitespace set as characters (Python's str.isspace()), for translate / trim.
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
WS = WS_CLASS + "+"
DIGITS = r"\p{Nd}+"
STRIP = "^" + WS + "|" + WS + "$"
# Non-answers of the rule scorer (PF-19).
NON_ANSWERS = ("", "idk", "i don't know", "i dunno")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c) -> Column:
    """``c``, worked out before a fan-out. Generated code of a broadcast join puts off the columns of its
    large side until they are read, within the loop over the matches: a text would be tokenised
    again for every pair. A lambda is not part of generated code, so a projection that holds one
    ends in rows with the value in them."""
    return F.transform(F.array(col(c)), lambda x: x)[0]


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (a set trim, no regex)."""
    return F.trim(col(c), F.lit(WS_CHARS))


def _spaces(c, extra: str = "") -> Column:
    """Map every whitespace character (and ``extra`` characters) to a plain space."""
    src = extra + WS_CHARS
    return F.translate(c, src, " " * len(src))


def strip_lower(c) -> Column:
    """F-1: ``str(x).strip().lower()``; null becomes ''."""
    return F.lower(py_strip(F.coalesce(col(c), F.lit(""))))


def ws_tokens(c, extra_separators: str = "") -> Column:
    """Python ``str.split()`` on Unicode whitespace (no empty tokens).

    Whitespace is translated to spaces and trimmed, split on single spaces (a plain
    character split, no regex engine) and the empty strings left by space runs removed."""
    t = F.trim(_spaces(F.coalesce(col(c), F.lit("")), extra_separators))
    return F.array_remove(F.split(t, " "), "")


def word_tokens(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WORD), 0)


def model_tokens(c) -> Column:
    """F-14: lowercased words and single punctuation marks."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOK), 0)


def tf_tokens(c) -> Column:
    """Tokens of the term-count vectoriser: lowercase words of 2+ characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(TOK2), 0)


def jaccard(a, b) -> Column:
    """F-2: |A ∩ B| / |A ∪ B| on whitespace token sets; 0 if either set is empty."""
    ta, tb = F.array_distinct(ws_tokens(a)), F.array_distinct(ws_tokens(b))
    return jaccard_of_sets(ta, tb)


def jaccard_of_sets(ta: Column, tb: Column) -> Column:
    """|A ∩ B| / |A ∪ B| with |A ∪ B| = |A| + |B| - |A ∩ B|; 0 when a set is empty.

    Written without a CASE so that each token array is evaluated once (common
    subexpressions are shared only outside conditional branches)."""
    inter = F.size(F.array_intersect(ta, tb))
    return F.coalesce(F.try_divide(inter, F.size(ta) + F.size(tb) - inter), F.lit(0.0))


def overlap_tokens(c) -> Column:
    """F-9 token set: lowercase, '.,;' to spaces, whitespace split, distinct."""
    return F.array_distinct(ws_tokens(F.lower(F.coalesce(col(c), F.lit(""))), ".,;"))


def overlap_of_sets(idea_set: Column, note_set: Column) -> Column:
    """|idea ∩ note| / |idea| on distinct token arrays; 0 for an empty idea. The hash set is
    built over the (small) idea set and the note set is streamed through it."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(note_set, idea_set)), F.size(idea_set)), F.lit(0.0))


def lexical_overlap(idea, note) -> Column:
    """F-9: share of the idea's distinct tokens found in the note; 0 for an empty idea."""
    return overlap_of_sets(overlap_tokens(idea), overlap_tokens(note))


def token_sort(c) -> Column:
    """Whitespace tokens sorted by code point and joined by one space."""
    return F.array_join(F.sort_array(ws_tokens(c)), " ")


def levenshtein_ratio(a, b) -> Column:
    """F-5: 1 - LD(a', b') / max(len a', len b') on token-sorted texts; both empty -> 1."""
    sa, sb = token_sort(a), token_sort(b)
    mx = F.greatest(F.length(sa), F.length(sb))
    return F.coalesce(1.0 - F.try_divide(F.levenshtein(sa, sb), mx), F.lit(1.0))


def digit_runs(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(DIGITS), 0)


def number_match(response, answer) -> Column:
    """F-6: 1 if the response has digit runs and they equal the answer's, in order."""
    ra, rb = digit_runs(response), digit_runs(answer)
    # a product, not AND: both operands are always evaluated, so ra is extracted once
    return (ra == rb).cast("int") * F.least(F.size(ra), F.lit(1))


def three_way_label(score, high: float = 0.60, low: float = 0.59) -> Column:
    """F-8: > high -> 1, > low -> 0, else -1 (strict comparisons, as in the code)."""
    s = col(score)
    return F.when(s > high, 1).when(s > low, 0).otherwise(-1)


def non_answer(c) -> Column:
    """PF-19: True when the cleaned response is empty or a stock non-answer."""
    return strip_lower(c).isin(*NON_ANSWERS)


def embedding_cosine(a, b) -> Column:
    """F-24: cosine of two float arrays in index order; 0 when a norm is 0 or input missing."""
    da = F.transform(col(a), lambda x: x.cast("double"))
    db = F.transform(col(b), lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(da, db, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    na = F.aggregate(F.transform(da, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    nb = F.aggregate(F.transform(db, lambda x: x * x), F.lit(0.0), lambda acc, x: acc + x)
    den = F.sqrt(na) * F.sqrt(nb)
    return F.when(den.isNull() | (den == 0), F.lit(0.0)).otherwise(dot / den)


def non_empty(c) -> Column:
    """PF-20: text with something besides whitespace."""
    return F.length(py_strip(F.coalesce(col(c), F.lit("")))) > 0

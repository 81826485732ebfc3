"""Prompt text (F-19, F-20), prompt truncation (F-21) and pair encoding (F-23).

The instructions are a parameter with a plain default. A prompt is instructions, (for
one-shot) a worked example with its YES/NO answer, the idea, the note, and a final
'Answer:' cue. Token counts use the F-14 word/punctuation tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notecover.functions import text as T

# Default wording; callers pass their own through ``instructions``.
INSTRUCTIONS = (
    "Does the note express the idea?\n"
    "Reply YES or NO.\n"
)
EXAMPLE_HEAD = "\nWorked example\nIDEA:\n"
EXAMPLE_NOTE = "\nNOTE:\n"
EXAMPLE_ANSWER = "\nAnswer: "
QUERY_HEAD = "\n\nNow decide\nIDEA:\n"
QUERY_NOTE = "\nNOTE:\n"
TAIL = "\nAnswer:"


def _s(c: Column) -> Column:
    return T.py_strip(F.coalesce(c, F.lit("")))


def zero_shot_parts(idea: Column, note: Column, instructions: str = INSTRUCTIONS) -> list[Column]:
    return [F.lit(instructions + QUERY_HEAD.lstrip("\n")), _s(idea), F.lit(QUERY_NOTE), _s(note), F.lit(TAIL)]


def one_shot_parts(idea: Column, note: Column, ex_idea: Column, ex_note: Column, ex_label: Column,
                   instructions: str = INSTRUCTIONS) -> list[Column]:
    ans = F.when(ex_label == 1, F.lit("YES")).otherwise(F.lit("NO"))
    return [F.lit(instructions + EXAMPLE_HEAD.lstrip("\n")), _s(ex_idea), F.lit(EXAMPLE_NOTE), _s(ex_note),
            F.lit(EXAMPLE_ANSWER), ans, F.lit(QUERY_HEAD), _s(idea), F.lit(QUERY_NOTE), _s(note), F.lit(TAIL)]


def zero_shot(idea: Column, note: Column, instructions: str = INSTRUCTIONS) -> Column:
    """F-19: instructions, idea and note (both stripped), answer cue."""
    return F.concat(*zero_shot_parts(idea, note, instructions))


def one_shot(idea: Column, note: Column, ex_idea: Column, ex_note: Column, ex_label: Column,
             instructions: str = INSTRUCTIONS) -> Column:
    """F-20: as F-19 with one worked example and its YES/NO answer first."""
    return F.concat(*one_shot_parts(idea, note, ex_idea, ex_note, ex_label, instructions))


def n_tokens(c: Column) -> Column:
    return F.size(T.model_tokens(c))


def example_tokens(ex_idea: Column, ex_note: Column, ex_label: Column) -> Column:
    """Tokens the example adds to a one-shot prompt; compute it once per example row."""
    ans = F.when(ex_label == 1, F.lit("YES")).otherwise(F.lit("NO"))
    return n_tokens(_s(ex_idea)) + n_tokens(_s(ex_note)) + n_tokens(ans)


def cut_note(idea: Column, note: Column, max_tokens: int = 1024, example: dict | None = None,
             example_tokens_col: Column | None = None, instructions: str = INSTRUCTIONS) -> tuple[Column, Column, Column]:
    """F-21: (note as it fits into a prompt of ``max_tokens``, the prompt's token count,
    truncated flag). The note is cut, never the instructions or the final cue; this is the
    note that a scorer of the prompt gets to see.

    Parts are joined at whitespace, so the prompt's token count is the sum of the parts'
    counts: the fixed template parts are literals (folded at planning), the example's
    count comes per example row (``example_tokens_col``), and only the note is tokenised
    per row. The note keeps its first ``budget`` tokens, joined by one space."""
    note_s = _s(note)
    note_toks = T.model_tokens(note_s)
    if example is None:
        parts = zero_shot_parts(idea, note, instructions)
        fixed = sum((n_tokens(p) for i, p in enumerate(parts) if i != 3), F.lit(0))
    else:
        parts = one_shot_parts(idea, note, **example, instructions=instructions)
        fixed_parts = [p for i, p in enumerate(parts) if i in (0, 2, 4, 6, 7, 8, 10)]
        ex = example_tokens_col if example_tokens_col is not None else example_tokens(**example)
        fixed = sum((n_tokens(p) for p in fixed_parts), F.lit(0)) + ex
    total = fixed + F.size(note_toks)
    over = total > max_tokens
    budget = F.greatest(F.lit(max_tokens) - fixed, F.lit(0))
    note_used = F.when(over, F.array_join(F.slice(note_toks, 1, budget), " ")).otherwise(note_s)
    n = F.when(over, fixed + F.least(budget, F.size(note_toks))).otherwise(total)
    return note_used, n, over


def truncate_note(idea: Column, note: Column, max_tokens: int = 1024, example: dict | None = None,
                  example_tokens_col: Column | None = None, instructions: str = INSTRUCTIONS) -> tuple[Column, Column, Column]:
    """F-21: (prompt with the note cut to fit, its token count, truncated flag); see :func:`cut_note`."""
    note_used, n, over = cut_note(idea, note, max_tokens, example, example_tokens_col, instructions)
    if example is None:
        return zero_shot(idea, note_used, instructions), n, over
    return one_shot(idea, note_used, **example, instructions=instructions), n, over


def head_truncate(prompt: Column, max_tokens: int = 1024) -> Column:
    """F-21 as in the reference: keep the first ``max_tokens`` tokens of the whole prompt."""
    return F.array_join(F.slice(T.model_tokens(prompt), 1, max_tokens), " ")


def keep_lengths(la: Column, lb: Column, room: Column) -> tuple[Column, Column]:
    """'Longest first' pair truncation in closed form: tokens are removed one at a time from
    the longer side (the second side on ties) until la + lb <= room."""
    half = F.floor(room / 2).cast("int")
    keep_b = F.least(lb, F.greatest(room - la, half))
    keep_a = F.least(la, room - keep_b)
    fits = la + lb <= room
    return F.when(fits, la).otherwise(keep_a), F.when(fits, lb).otherwise(keep_b)


def encoding_tokens(c, max_length: int = 256) -> tuple[Column, Column]:
    """What :func:`pair_encoding` needs of a text: its token count, and the tokens that can fit.
    Compute them once per text, before pairs fan out."""
    t = T.model_tokens(c)
    return F.size(t), F.slice(t, 1, max_length - 3)


def pair_encoding(df: DataFrame, idea: str = "idea_unit", note: str = "note_text", max_length: int = 256, vocab_size: int = 30522,
                  idea_tokens: tuple[Column, Column] | None = None, note_tokens: tuple[Column, Column] | None = None) -> DataFrame:
    """F-23 (re-aimed): [CLS] idea [SEP] note [SEP], longest-first truncation, padding,
    attention mask, token types and hashed ids (pmod(xxhash64(token), vocab_size)).

    ``idea_tokens`` and ``note_tokens`` are columns with :func:`encoding_tokens` (of the same
    ``max_length``) of ideas and notes that were tokenised before the pair fan-out."""
    cols = df.columns
    none = F.array().cast("array<string>")
    (na, ta), (nb, tb) = idea_tokens or encoding_tokens(idea, max_length), note_tokens or encoding_tokens(note, max_length)
    df = df.withColumns({"_na": F.coalesce(na, F.lit(0)), "_ta": F.coalesce(ta, none), "_nb": F.coalesce(nb, F.lit(0)), "_tb": F.coalesce(tb, none)})
    ta, tb = F.col("_ta"), F.col("_tb")
    ka, kb = keep_lengths(F.col("_na"), F.col("_nb"), F.lit(max_length - 3))
    df = df.withColumns({"_ka": ka, "_kb": kb})
    ka, kb = F.col("_ka"), F.col("_kb")
    toks = F.concat(F.array(F.lit("[CLS]")), F.slice(ta, 1, ka), F.array(F.lit("[SEP]")),
                    F.slice(tb, 1, kb), F.array(F.lit("[SEP]")))
    n_real = ka + kb + 3
    pad = F.array_repeat(F.lit("[PAD]"), F.lit(max_length) - n_real)
    types = F.concat(F.array_repeat(F.lit(0), ka + 2), F.array_repeat(F.lit(1), kb + 1),
                     F.array_repeat(F.lit(0), F.lit(max_length) - n_real))
    mask = F.concat(F.array_repeat(F.lit(1), n_real), F.array_repeat(F.lit(0), F.lit(max_length) - n_real))
    full = F.concat(toks, pad)
    ids = F.transform(full, lambda t: F.pmod(F.xxhash64(t), F.lit(vocab_size)))
    return df.select(*cols, ka.alias("n_idea_kept"), kb.alias("n_note_kept"), n_real.alias("n_real"),
                     F.array_join(toks, " ").alias("tokens_text"), ids.alias("input_ids"),
                     mask.alias("attention_mask"), types.alias("token_type_ids"))

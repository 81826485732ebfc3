"""Shared SQL fragments for the DuckDB oracle (kept apart from the Spark code paths)."""

from notecover.functions import text as T

WS = T.WS


def metric_cols(n="n", tp="tp", fp="fp", fn="fn", tn="tn", correct=None) -> str:
    corr = correct or f"({tp} + {tn})"
    return (f"round(CASE WHEN {n} > 0 THEN {corr} / {n} ELSE 0.0 END, 6) AS accuracy, "
            f"round(CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END, 6) AS precision, "
            f"round(CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END, 6) AS recall, "
            f"round(CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END, 6) AS f1")


def counters(y="y", p="prediction") -> str:
    return (f"count(*) AS n, count(*) FILTER (WHERE {y} = 1 AND {p} = 1) AS tp, "
            f"count(*) FILTER (WHERE {y} <> 1 AND {p} = 1) AS fp, "
            f"count(*) FILTER (WHERE {y} = 1 AND {p} <> 1) AS fn, "
            f"count(*) FILTER (WHERE {y} <> 1 AND {p} <> 1) AS tn")


def overlap_set(expr: str) -> str:
    """F-9 token set in SQL."""
    return (f"list_distinct(list_filter(regexp_split_to_array(translate(lower(coalesce({expr}, '')), "
            f"'.,;', '   '), '{WS}'), lambda t: t <> ''))")


def ws_tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), '{WS}'), lambda t: t <> '')"


def strip_lower(expr: str) -> str:
    return f"lower(regexp_replace(coalesce({expr}, ''), '^{WS}|{WS}$', '', 'g'))"


def histogram(src: str, y="y", score="score") -> str:
    return (f"SELECT {score} AS score, count(*) FILTER (WHERE {y} = 1) AS pos, "
            f"count(*) FILTER (WHERE {y} <> 1) AS neg FROM {src} "
            f"WHERE {score} IS NOT NULL AND NOT isnan({score}) GROUP BY {score}")


def cumulative(hist_cte: str) -> str:
    """cum_pos / cum_neg over score descending, P and N totals."""
    return (f"SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg, "
            f"sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM {hist_cte} "
            f"WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)")


def token_sort(expr: str) -> str:
    """Whitespace tokens in code point order, joined by one space."""
    return f"array_to_string(list_sort({ws_tokens(expr)}), ' ')"


_BLOCK = 60
_FULL = (1 << _BLOCK) - 1


def lcs_ctes(src: str, px: str) -> tuple[str, ...]:
    """LCS length of two texts of any length: table ``{px}q`` (pair_id, total, lcs) of ``src`` (pair_id, a, b).

    The bit-parallel recurrence of Hyyrö (2004) over blocks of 60 bits: the positions of each
    character of the shorter text are masks, the longer text is folded character by character,
    and the carry travels through the blocks."""
    add = "(e[1] + (e[1] & e[2]) + acc.c)"
    step = (f"list_reduce(list_zip(v, m), lambda acc, e: {{'o': list_append(acc.o, ({add} & {_FULL}) | (e[1] - (e[1] & e[2]))), "
            f"'c': {add} >> {_BLOCK}}}, {{'o': CAST([] AS BIGINT[]), 'c': CAST(0 AS BIGINT)}}).o")
    ones = (f"list_transform(range((length(s) + {_BLOCK - 1}) // {_BLOCK}), lambda k: CASE WHEN (k + 1) * {_BLOCK} <= length(s) "
            f"THEN CAST({_FULL} AS BIGINT) ELSE (CAST(1 AS BIGINT) << CAST(length(s) - k * {_BLOCK} AS INTEGER)) - 1 END)")
    return (
        f"{px}p AS (SELECT pair_id, CASE WHEN length(a) >= length(b) THEN a ELSE b END AS l, "
        f"CASE WHEN length(a) >= length(b) THEN b ELSE a END AS s FROM {src})",
        f"{px}ch AS (SELECT s, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i "
        f"FROM (SELECT DISTINCT s FROM {px}p WHERE s <> '') d)",
        f"{px}bl AS (SELECT s, c, i // {_BLOCK} AS k, CAST(sum(CAST(1 AS BIGINT) << CAST(i % {_BLOCK} AS INTEGER)) AS BIGINT) AS m "
        f"FROM {px}ch GROUP BY ALL)",
        f"{px}mk AS (SELECT s, c, map(list(k), list(m)) AS mk FROM {px}bl GROUP BY ALL)",
        f"{px}mp AS (SELECT s, map(list(c), list(list_transform(range((length(s) + {_BLOCK - 1}) // {_BLOCK}), "
        f"lambda k: coalesce(mk[k], 0)))) AS masks, {ones} AS ones FROM {px}mk GROUP BY s)",
        f"{px}v AS (SELECT pair_id, ones, list_reduce(list_filter(list_transform(string_split(l, ''), lambda x: masks[x]), "
        f"lambda x: x IS NOT NULL), lambda v, m: {step}, ones) AS v FROM {px}p JOIN {px}mp USING (s))",
        f"{px}q AS (SELECT p.pair_id, length(l) + length(s) AS total, coalesce(length(s) - "
        f"list_sum(list_transform(list_zip(v.v, v.ones), lambda e: bit_count(e[1] & e[2]))), 0) AS lcs "
        f"FROM {px}p p LEFT JOIN {px}v v USING (pair_id))",
    )


def indel_ratio(px: str) -> str:
    """F-4 from a row of ``{px}q``."""
    return f"CASE WHEN {px}q.total = 0 THEN 1.0 ELSE 2 * {px}q.lcs / {px}q.total END"


def edit_distance(a: str, b: str) -> str:
    """Edit distance in characters: DuckDB's function counts bytes, so each distinct character
    of the two texts is first replaced by a one-byte character (more than 127: an error)."""
    chars = f"list_distinct(string_split({a} || {b}, ''))"
    frm = f"array_to_string({chars}, '')"
    to = (f"CASE WHEN len({chars}) > 127 THEN error('more than 127 distinct characters') "
          f"ELSE array_to_string(list_transform(range(len({chars})), lambda i: chr(CAST(i + 1 AS INTEGER))), '') END")
    return f"CASE WHEN {a} = {b} THEN 0 ELSE levenshtein(translate({a}, {frm}, {to}), translate({b}, {frm}, {to})) END"


def levenshtein_ratio(a: str, b: str) -> str:
    """F-5 on two token-sorted texts."""
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 "
            f"ELSE 1 - ({edit_distance(a, b)}) / greatest(length({a}), length({b})) END")


def long_rows(section: str, src: str, cols: dict[str, str], key: str | None = None) -> str:
    """(section, key, value) rows of the named value expressions ``cols`` over ``src``."""
    names = ", ".join(f"{key} || ':{n}'" if key else f"'{n}'" for n in cols)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for e in cols.values())
    return f"SELECT '{section}' AS section, unnest([{names}]) AS key, unnest([{values}]) AS value FROM {src}"


def long_union(parts) -> str:
    return ("SELECT section, key, round(value, 6) AS value FROM (" + "\nUNION ALL ".join(parts)
            + ") long_rows WHERE value IS NOT NULL")


def report_ctes(src: str, y: str, p: str, px: str) -> tuple[str, ...]:
    """A-5 of table ``src`` as ``{px}rep`` (class, precision, recall, f1, support)."""
    return (
        f"{px}cells AS (SELECT {y} AS t, {p} AS p, count(*) AS n FROM {src} GROUP BY ALL)",
        f"{px}per AS (SELECT cls, sum(s) AS support, sum(tp) AS tp, sum(pn) AS pred_n FROM ("
        f"SELECT t AS cls, n AS s, CASE WHEN t = p THEN n ELSE 0 END AS tp, 0 AS pn FROM {px}cells "
        f"UNION ALL SELECT p, 0, 0, n FROM {px}cells) x GROUP BY cls)",
        f"{px}pc AS (SELECT CAST(CAST(cls AS BIGINT) AS VARCHAR) AS class, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision, "
        f"CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, "
        f"CASE WHEN support + pred_n > 0 THEN 2 * tp / (support + pred_n) ELSE 0.0 END AS f1, support, tp FROM {px}per)",
        f"{px}rep AS (SELECT class, precision, recall, f1, support FROM {px}pc "
        f"UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support) FROM {px}pc "
        f"UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM {px}pc "
        f"UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
        f"sum(f1 * support) / sum(support), sum(support) FROM {px}pc)",
    )


def evaluation_rows(src: str, y: str, p: str, px: str, all_rows: str, groups: tuple[str, ...] = ()) -> list[str]:
    """The sections of an evaluation of complete rows ``src`` (CTEs of :func:`report_ctes` needed)."""
    names = {k: k for k in ("accuracy", "precision", "recall", "f1")}
    body = f"(SELECT *, {metric_cols()}, CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2 END " \
           f"AS balanced_accuracy FROM (SELECT {counters(y, p)} FROM {src}) c) m"
    out = [long_rows("input", f"(SELECT count(*) AS n_in, count(*) - (SELECT count(*) FROM {src}) AS n_dropped FROM {all_rows}) i",
                     {"n_in": "n_in", "n_dropped": "n_dropped"}),
           long_rows("metrics", body, {"n": "n", **names, "balanced_accuracy": "balanced_accuracy"}),
           long_rows("confusion", body, {"0->0": "tn", "0->1": "fp", "1->0": "fn", "1->1": "tp"}),
           long_rows("report", f"{px}rep", {k: k for k in ("precision", "recall", "f1", "support")}, "class")]
    if groups:
        g = ", ".join(groups)
        cond = " AND ".join(f"{c} IS NOT NULL" for c in groups)
        out.append(long_rows("group", f"(SELECT *, {metric_cols()}, (tp + fn) / n AS pos_prevalence FROM (SELECT {g}, {counters(y, p)} "
                             f"FROM {src} WHERE {cond} GROUP BY {g}) c) m", {"n": "n", **names, "pos_prevalence": "pos_prevalence"},
                             "concat_ws('|', " + g + ")"))
    return out

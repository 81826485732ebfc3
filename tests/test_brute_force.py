"""Queries without an SQL oracle, checked against straightforward Python on small fixtures."""

import pytest

import __spark_entry__ as E
from notecover.functions.lcs import lcs_length
from notecover.sources import fixtures as FX
from conftest import SF_SMALL

WS = None


def py_clean(x):
    import regex
    return " ".join(regex.findall(r"[\p{L}\p{N}\p{M}_]+", (x or "").lower()))


def token_sort(x):
    return " ".join(sorted(x.strip().lower().split()))


def lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ch in a:
        cur = [0]
        for j, d in enumerate(b):
            cur.append(prev[j] + 1 if ch == d else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def indel(a, b):
    a, b = token_sort(a), token_sort(b)
    return 1.0 if not a and not b else 2 * lcs_dp(a, b) / (len(a) + len(b))


def lev(a, b):
    a, b = token_sort(a), token_sort(b)
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    m = max(len(a), len(b))
    return 1.0 if m == 0 else 1 - prev[-1] / m


@pytest.fixture(scope="module")
def answers(spark):
    return [r.asDict() for r in FX.answers(spark, SF_SMALL).collect()]


def test_fuzzy_indel_brute_force(spark, answers):
    got = {r["pair_id"]: r["fuzzy"] for r in E.queries()["fuzzy_indel"](spark, SF_SMALL).collect()}
    assert len(got) == len(answers)
    for a in answers[:150]:
        assert got[a["pair_id"]] == pytest.approx(round(indel(a["response"], a["correct_answer"]), 6), abs=1e-6)


def test_fuzzy_levenshtein_brute_force(spark, answers):
    got = {r["pair_id"]: r["levenshtein_ratio"] for r in E.queries()["fuzzy_levenshtein"](spark, SF_SMALL).collect()}
    for a in answers[:120]:
        assert got[a["pair_id"]] == pytest.approx(round(lev(a["response"], a["correct_answer"]), 6), abs=1e-6)


def _rule_rows(answers):
    out = []
    for a in answers:
        r, c = py_clean(a["response"]), py_clean(a["correct_answer"])
        guard = r.strip().lower() in ("", "idk", "i don't know", "i dunno")
        out.append((a["label"], None if guard else indel(r, c), guard))
    return out


def test_rule_chain_brute_force(spark, answers):
    rows = _rule_rows(answers)
    pred = [-1 if g else (1 if s > 0.60 else 0 if s > 0.59 else -1) for _, s, g in rows]
    lab = [y for y, _, _ in rows]
    tp = sum(p == 1 and y == 1 for p, y in zip(pred, lab))
    fp = sum(p == 1 and y != 1 for p, y in zip(pred, lab))
    fn = sum(p != 1 and y == 1 for p, y in zip(pred, lab))
    got = E.queries()["rule_chain"](spark, SF_SMALL).first()
    assert (got["n"], got["correct"], got["tp"], got["fp"], got["fn"]) == \
        (len(lab), sum(p == y for p, y in zip(pred, lab)), tp, fp, fn)


def test_rule_tuning_brute_force(spark, answers):
    rows = _rule_rows(answers)
    best = None
    for h in range(60, 66):
        for lo in range(55, h):
            H, L = h / 100, lo / 100
            correct = sum((-1 if g else (1 if s > H else 0 if s > L else -1)) == y for y, s, g in rows)
            acc = correct / len(rows)
            if best is None or acc > best[0]:
                best = (acc, H, L)
    got = E.queries()["rule_tuning"](spark, SF_SMALL).first()
    assert (got["result_1_limit"], got["result_0_limit"]) == (best[1], best[2])
    assert got["accuracy"] == pytest.approx(round(best[0], 6))


def test_lcs_long_texts():
    a = "the quick brown fox " * 50
    b = "quick the fox brown " * 40
    assert lcs_length(a, b) == lcs_dp(a, b)

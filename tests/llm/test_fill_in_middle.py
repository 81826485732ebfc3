import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import docs_of  # noqa: F401  (a fixture)
from pyspark.sql import functions as F

from notecover.llm import fim, spans

UNIT = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+", "sentence": r"[^!.?\n]*[!.?\n]|[^!.?\n]+", "char": r"(?s)."}


def brute(doc_id, text, p):
    t = text or ""
    units = re.findall(UNIT[p.unit], t)
    h = hashlib.sha256(f"{p.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:x]), "".join(units[x:y]), "".join(units[y:])
    P, S, M = p.markers
    if not t or any(m in t for m in p.markers) or h3 % 100 >= p.rate:
        return doc_id, n, "plain", None, None, t, t
    if h4 % 100 < p.spm:
        return doc_id, n, "spm", len(pre), len(mid), S + suf + P + pre + M + mid, t
    return doc_id, n, "psm", len(pre), len(mid), P + pre + S + suf + M + mid, t


TEXTS = [None, "", "\n", "\n\n", "one line", "one\ntwo\nthree", "ends\n", "é\n漢字\n😀\nx", "has <P> in it\nx", "<S", "x<M>", "<\n<\nP>\n",
         "a. b! c? d\te", "long " * 60_000 + "\nend", "\r\n\r\n", "<P\n>\n<<S\n>", "x\n" * 5000]
ROWS = [(i, t) for i in range(40) for t in TEXTS] + [(None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc"), (1 << 60, "q\nr")]


@pytest.mark.parametrize("p", [fim.Fim(), fim.Fim(unit="word", rate=70, spm=30), fim.Fim(unit="sentence", seed=3), fim.Fim(unit="char"),
                               fim.Fim(markers=("<|pre|>", "<|suf|>", "<|mid|>"))], ids=["line", "word", "sentence", "char", "markers"])
def test_equals_brute_force_and_round_trips(spark, docs_of, p):
    out = fim.transform(docs_of(ROWS), p).withColumn("back", fim.restored("output", "form", p.markers))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    assert got == sorted((brute(i, t, p) for i, t in ROWS), key=repr)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}


def test_empty_table_clashing_columns_and_bytes(spark, docs_of):
    assert fim.transform(docs_of([])).count() == 0
    clash = docs_of([(1, "a\nb")]).withColumn("output", F.lit(1)).withColumn("n", F.lit(2)).withColumn("Form", F.lit("z"))
    assert tuple(fim.transform(clash).first()) == brute(1, "a\nb", fim.Fim())[:-1]
    d = spark.sql("SELECT 5L AS doc_id, CAST(unhex('61ff0a62fe') AS STRING) AS text")
    out = fim.transform(d).selectExpr("hex(output)", "form").first()
    parts = {"psm": (b"<P>", b"<S>", b"<M>"), "spm": (b"<S>", b"<P>", b"<M>")}[out[1]]
    assert sorted(re.split(b"|".join(parts), bytes.fromhex(out[0]))[1:]) in ([b"", b"", b"a\xff\nb\xfe"], [b"", b"a\xff\n", b"b\xfe"])


def test_markers_that_overlap_are_refused():
    for m in (("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "ba", "c"), ("aa", "b", "c"), ("xPx", "P", "q")):
        with pytest.raises(ValueError):
            fim._check(fim.Fim(markers=m))
    with pytest.raises(ValueError):
        fim.Boundaries(np.zeros(0, np.uint8), np.zeros(1, np.int64), "page")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=400))
def test_rank_and_select(symbols):
    s = np.array(symbols, np.uint8)
    m = fim.WaveletMatrix(s)
    i = np.arange(len(s) + 1)
    for c in range(8):
        want = np.concatenate([[0], np.cumsum(s == c)])
        assert (m.rank(c, i) == want).all()
        places = np.flatnonzero(s == c)
        assert (m.select(c, np.arange(len(places))) == places).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.!é漢😀", max_size=30), min_size=1, max_size=6), st.sampled_from(sorted(UNIT)), st.data())
def test_units_and_cuts(texts, unit, data):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    b = fim.Boundaries(np.frombuffer(b"".join(raw), np.uint8), off, unit)
    units = [re.findall(UNIT[unit], t) for t in texts]
    n = b.units()
    assert n.tolist() == [len(u) for u in units]
    k = np.array([data.draw(st.integers(0, len(u))) for u in units], np.int64)
    assert (b.after(k, n) - off[:-1]).tolist() == [len("".join(u[:x]).encode()) for u, x in zip(units, k.tolist())]


def test_draws():
    h = hashlib.sha256(b"7:12").hexdigest()
    assert fim.draws(7, [12]).tolist() == [[int(h[k:k + 8], 16) for k in (0, 8, 16, 24)]]
    assert spans.SLICE_BYTES < 300_000 * 5                                  # the long text above fills slices of its own

"""Property tests: Spark column functions vs a plain-Python statement of the same rule.

Each hypothesis example is a *batch* of generated strings checked in one
Spark job, so a few dozen examples cover thousands of inputs.
"""

import os
import re
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabloom.functions import text as TX
from tabloom.functions.numbers import with_parsed_number
from tabloom.operators import ingest
from tabloom.sinks import writers
from tabloom.sources import files

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
WORDS = st.text(alphabet="abcXYZ éü01#-_. \n", min_size=0, max_size=30)


def _run(spark, values, col_fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {r.i: r.o for r in df.select("i", col_fn(F.col("v")).alias("o")).collect()}


def _py_after_last(t, m):
    pos = t.lower().rfind(m.lower())
    return t if pos == -1 else t[pos + len(m):].strip(" \t\n\r\x0b\x0c")


@SETTINGS
@given(st.lists(WORDS, min_size=1, max_size=40), st.sampled_from(["###", "answer:", "x"]))
def test_after_last_matches_rule(spark, texts, marker):
    got = _run(spark, texts, lambda c: TX.after_last(c, marker))
    assert [got[i] for i in range(len(texts))] == [_py_after_last(t, marker) for t in texts]


NAMES = st.text(alphabet="abcdXY019-_ /", min_size=1, max_size=20).map(lambda s: s.lstrip("."))


@SETTINGS
@given(st.lists(NAMES, min_size=1, max_size=40), st.sampled_from(["", ".pdf", ".tar.gz", "_2023", "_2023.pdf"]))
def test_names_match_rule(spark, names, suffix):
    vals = [n + suffix for n in names]
    comp = _run(spark, vals, TX.company_from_source)
    title = _run(spark, vals, TX.title_from_source)
    label = _run(spark, vals, TX.company_label)
    for i, v in enumerate(vals):
        tail = v.split("-")[-1]
        assert comp[i] == re.sub(r"\.[^./]*$", "", tail)
        base = v.split("/")[-1]
        assert title[i] == re.sub(r"\.[^.]*$", "", base)
        assert label[i] == re.sub(r"_2023$", "", re.sub(r"\.pdf$", "", v))


@SETTINGS
@given(st.lists(st.text(alphabet="aZ9_- .,!é中\t", max_size=15), min_size=1, max_size=40))
def test_clean_key_matches_rule(spark, names):
    got = _run(spark, names, TX.clean_key)
    for i, n in enumerate(names):
        s = n.strip(" ")
        want = "UNKNOWN" if not s else re.sub(r"[^\w-]", "_", s)
        assert got[i] == want, (n, got[i], want)


def _py_number(s):
    """The parser's rule, stated in Python (same fixed marker list)."""
    from tabloom.functions.numbers import MISSING_MARKERS
    t0 = s.strip(" ")
    if t0.lower() in MISSING_MARKERS:
        return None, None, None, False
    pct = "%" in t0
    t1 = re.sub(r"[%\s]", "", t0)
    acc = re.fullmatch(r"\((.*)\)", t1)
    t2 = acc.group(1) if acc else t1
    op = re.match(r"(<=|>=|<|>|=|~)?", t2).group(1) or ""
    body = t2[len(op):]

    def num(x):
        if re.fullmatch(r"[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?", x):
            x = x.replace(",", "")
        elif re.fullmatch(r"[+-]?[0-9]*,[0-9]+", x):
            x = x.replace(",", ".")
        return float(x) if re.fullmatch(r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", x) else None
    unsigned = r"[0-9][0-9,]*(?:\.[0-9]+)?"
    rng = re.fullmatch(rf"({unsigned})[-–—]({unsigned})", body)
    if rng:
        return num(rng.group(1)), num(rng.group(2)), "range", pct
    v = num(body)
    if v is not None and acc:
        v = -v
    if v is None:
        return None, None, None, pct
    if op in ("<", "<="):
        return None, v, op, pct
    if op in (">", ">="):
        return v, None, op, pct
    return v, v, "=", pct


NUMBERS = st.one_of(
    st.builds(lambda a, b: f"{a}.{b}", st.integers(0, 99999), st.integers(0, 99)),
    st.builds(lambda a: f"{a:,}", st.integers(1000, 10 ** 7)),
    st.builds(lambda a, b: f"{a},{b:04d}", st.integers(-9, 9), st.integers(0, 9999)),
    st.builds(lambda o, a: f"{o}{a}", st.sampled_from(["<", ">", "<=", ">=", "~", "=", ""]), st.integers(-500, 500)),
    st.builds(lambda a, b: f"{a}-{b}", st.integers(0, 99), st.integers(100, 999)),
    st.builds(lambda a: f"({a})", st.integers(0, 9999)),
    st.builds(lambda a, p: f"{a}{p}", st.integers(-99, 99), st.sampled_from(["%", " %", ""])),
    st.sampled_from(["", "na", "UP", "-", "NaN", "n/a", "abc", "1.2.3", ",5"]),
)


@SETTINGS
@given(st.lists(NUMBERS, min_size=1, max_size=60))
def test_parse_number_matches_rule(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, txt string")
    got = {r.i: (r.lo, r.hi, r.op, r.is_pct) for r in with_parsed_number(df, "txt").collect()}
    for i, t in enumerate(texts):
        assert got[i] == _py_number(t), (t, got[i], _py_number(t))


CELLS = st.text(alphabet='ab;"\n ,1', max_size=8)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(CELLS, min_size=2, max_size=2), min_size=1, max_size=6))
def test_csv_roundtrip(spark, rows):
    rows = [[c if c.strip() else "x" for c in r] for r in rows]  # blank lines are not records
    data = [("doc", 3, 1, ri, ci, h, c) for ri, r in enumerate(rows) for ci, (h, c) in enumerate(zip(["k", "v"], r))]
    cells = spark.createDataFrame(
        data, "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    root = tempfile.mkdtemp(prefix="tabloom-prop-")
    writers.write_tables(cells, root)
    back = files.read_tables(spark, root).collect()
    got = {(r.row_idx, r.col_idx): (r.header, r.cell) for r in back}
    want = {(ri, ci): (h, c) for _, _, _, ri, ci, h, c in data}
    assert got == want


@SETTINGS
@given(st.integers(1, 30000), st.integers(50, 5000), st.integers(0, 49))
def test_fixed_chunks_cover_text(spark, n, size, overlap):
    text = "".join(chr(97 + (i * 7) % 26) for i in range(n))
    pages = spark.createDataFrame([("s", 1, text)], "source string, page int, text string")
    ch = sorted(ingest.chunk_fixed(pages, size, overlap).collect(), key=lambda r: r.chunk_no)
    rebuilt = ch[0].content + "".join(c.content[overlap:] for c in ch[1:])
    assert rebuilt == text and all(len(c.content) <= size for c in ch)

"""Inline-fixture tests for operators the driver tables cannot exercise,
golden arithmetic re-derived by hand, and metamorphic properties."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabloom.functions.numbers import with_parsed_number
from tabloom.operators import context as X
from tabloom.operators import evaluate as E
from tabloom.operators import filters, ingest
from tabloom.operators import link as L
from tabloom.operators import quant as Q
from tabloom.operators import retrieve as R
from tabloom.operators import tables as T
from tabloom.sinks import writers
from tabloom.sources import files


def _tmp():
    return tempfile.mkdtemp(prefix="tabloom-test-")


# ---------------------------------------------------------------- T9 parser

PARSE_CASES = [
    ("31774", 31774.0, 31774.0, "=", False),
    ("(74.0)", -74.0, -74.0, "=", False),
    ("-13%", -13.0, -13.0, "=", True),
    ("<38", None, 38.0, "<", False),
    (">-40%", -40.0, None, ">", True),
    ("25-30", 25.0, 30.0, "range", False),
    ("10,291", 10291.0, 10291.0, "=", False),
    ("-0,0007", -0.0007, -0.0007, "=", False),
    ("< 0.1", None, 0.1, "<", False),
    ("+9%", 9.0, 9.0, "=", True),
    ("UP", None, None, None, False),
    ("na", None, None, None, False),
    ("-", None, None, None, False),
    ("NaN", None, None, None, False),
    ("", None, None, None, False),
]


def test_parse_number(spark):
    df = spark.createDataFrame([(t,) for t, *_ in PARSE_CASES], "txt string")
    got = {r.txt: (r.lo, r.hi, r.op, r.is_pct) for r in with_parsed_number(df, "txt").collect()}
    for txt, lo, hi, op, pct in PARSE_CASES:
        g = got[txt]
        assert (g[0] is None) == (lo is None) and (lo is None or math.isclose(g[0], lo)), (txt, g)
        assert (g[1] is None) == (hi is None) and (hi is None or math.isclose(g[1], hi)), (txt, g)
        assert g[2] == op and g[3] == pct, (txt, g)


# ------------------------------------------------------- golden arithmetic

def _facts(spark, rows):
    return spark.createDataFrame(rows, "company string, metric string, year int, value double")


def test_golden_reduction_percentage(spark):
    f = _facts(spark, [("c", "m", 2022, 113211.0), ("c", "m", 2023, 105593.0)])
    r = Q.answer(Q.q_pct(f, ["company", "metric"], 2022, 2023, "reduction")).collect()[0]
    assert r.answer == "6.73"


def test_golden_ratio_average(spark):
    f = _facts(spark, [("c", "a", 1, 14334.0), ("c", "b", 1, 14171.0), ("c", "a", 2, 377.0), ("c", "b", 2, 692.0)])
    ratio = Q.q_ratio(f, ["company", "year"], F.col("metric") == "a", F.col("metric") == "b")
    v = Q.two_step(ratio, ["company"], "mean", item="year").collect()[0].value
    assert abs(v - 77.81) <= 0.01


def test_golden_ratio_average_companies(spark):
    f = _facts(spark, [("x", "a", 1, 33093.0), ("x", "b", 1, 3039435.0),
                       ("y", "a", 1, 10291.0), ("y", "b", 1, 735018.0)])
    ratio = Q.q_ratio(f, ["company"], F.col("metric") == "a", F.col("metric") == "b")
    mean = ratio.agg(F.avg("value").alias("value"))
    assert Q.answer(mean).collect()[0].answer == "1.24"


def test_golden_average_sum(spark):
    f = _facts(spark, [("s", "x", 2022, 115550.0), ("s", "x", 2023, 111567.0),
                       ("s", "y", 2022, 6964.0), ("s", "y", 2023, 6719.0)])
    inner = Q.q_mean(f, ["company", "metric"])
    out = Q.answer(Q.two_step(inner, ["company"], "sum", item="metric")).collect()[0]
    assert out.answer == "120400.00"


def test_golden_sum_inf(spark):
    rows = [("s", "a", 1, 377.0), ("s", "a", 2, 351.0), ("s", "a", 3, 366.0), ("s", "a", 4, 692.0),
            ("s", "a", 5, 380.0), ("s", "b", 1, 1000.0), ("s", "b", 2, 2000.0)]
    inner = Q.q_sum(_facts(spark, rows), ["company", "metric"])
    best = Q.two_step(inner, ["company"], "inf", item="metric").collect()[0]
    assert best.metric == "a" and best.value == 2166.0


def test_golden_rank_low_printed_desc(spark):
    f = _facts(spark, [("A", "m", 1, 22042.0), ("B", "m", 1, 42423.0), ("C", "m", 1, 112228.0)])
    r = Q.q_rank(f, ["metric"], 2, "company", pick="low", order="desc").collect()[0]
    assert r.answer == "42423.00, 22042.00"
    r = Q.q_rank(f, ["metric"], 2, "company", pick="low", order="asc").collect()[0]
    assert r.answer == "22042.00, 42423.00"


def test_golden_units_then_sum(spark):
    f = spark.createDataFrame([("a", 112228.0, "t"), ("b", 0.2, "Mt"), ("c", 42423.0, "t")],
                              "company string, value double, unit string")
    rules = spark.createDataFrame([("Mt", "t", 1e6), ("kt", "t", 1e3)], "unit string, target string, factor double")
    n = Q.normalize_units(f, rules, "t")
    total = n.agg(F.sum("value").alias("value")).collect()[0].value
    assert total == 354651.0
    g = spark.createDataFrame([("d", 1.0, "GJ")], "company string, value double, unit string")
    assert Q.normalize_units(g, rules, "t").collect()[0].status == "no_rule"


def test_golden_sum_ranking(spark):
    rows = []
    sums = {"coal": 199398, "gas": 150463, "oil": 54253, "wind": 5319, "solar": 1868, "nuke": 0}
    for k, v in sums.items():
        rows += [("s", k, 2022, v / 2), ("s", k, 2023, v / 2)]
    inner = Q.q_sum(_facts(spark, rows), ["company", "metric"])
    r = Q.two_step(inner, ["company"], "rank", item="metric", n=6, pick="high", order="desc").collect()[0]
    assert r.answer == "199398.00, 150463.00, 54253.00, 5319.00, 1868.00, 0.00"


# ------------------------------------------------------------- file sources

def _write(path, text, binary=False):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb" if binary else "w", encoding=None if binary else "utf-8") as fh:
        fh.write(text)


def test_read_tables_quotes_ragged_encodings(spark):
    root = _tmp()
    _write(f"{root}/OTC_SU_2023/311_0.csv", 'Indicator;Units;2023\n"Energy\nuse";GJ;10,291\nWaste;t;UP\n')
    _write(f"{root}/vivendi/141_0.csv", "a;b;c\n1;2;3\n4;5;6;7\n")
    _write(f"{root}/latin/5_1.csv", "Name;Wert\nK\xf6ln;1\n".encode("iso-8859-1"), binary=True)
    _write(f"{root}/bom/6_0.csv", "﻿x;y\n1;2\n")
    cells = files.read_tables(spark, root).cache()
    su = {(r.row_idx, r.col_idx): (r.header, r.cell) for r in cells.where("source = 'OTC_SU_2023'").collect()}
    assert su[(0, 0)] == ("Indicator", "Energy\nuse")
    assert su[(0, 2)] == ("2023", "10,291") and su[(1, 2)] == ("2023", "UP")
    rag = cells.where("source = 'vivendi' AND row_idx = 1").collect()
    assert max(r.n_fields for r in rag) == 4 and rag[0].width == 3
    assert cells.where("source = 'latin'").where("col_idx = 0").collect()[0].cell == "Köln"
    assert cells.where("source = 'bom' AND col_idx = 0").collect()[0].header == "x"
    key = cells.where("source = 'OTC_SU_2023'").select("page", "table_no").distinct().collect()[0]
    assert (key.page, key.table_no) == (311, 0)
    dropped = files.read_tables(spark, root, on_bad="drop").where("source = 'vivendi'")
    assert dropped.select("row_idx").distinct().count() == 1
    fixed = T.repair_table(cells.where("source = 'vivendi'").drop("n_fields", "width"))
    # the widest row sets the width: nothing is cut, shorter rows are padded
    assert [r.cell for r in fixed.where("row_idx = 1").orderBy("col_idx").collect()] == ["4", "5", "6", "7"]
    assert [r.cell for r in fixed.where("row_idx = 0").orderBy("col_idx").collect()] == ["1", "2", "3", "NaN"]


def test_read_pages_codes_refs_questions(spark):
    root = _tmp()
    _write(f"{root}/pages/fres/191.txt", "Intro\n[TABLEPLACEHOLDER 0]\nmid\n[TABLEPLACEHOLDER 1]\n")
    p = files.read_pages(spark, f"{root}/pages").collect()[0]
    assert (p.source, p.page) == ("fres", 191) and "PLACEHOLDER 1" in p.text
    _write(f"{root}/codes.json", '{"301-1": "Materials used", "302-1": "Energy", "303-3": "Water"}')
    codes = files.read_codes(spark, f"{root}/codes.json").orderBy("ordinal").collect()
    assert [c.code for c in codes] == ["301-1", "302-1", "303-3"]
    _write(f"{root}/refs/Eni/metadata_after_llm.json", '{"302-1": [[60, 0], [60, 0], [61, 2]], "305-1": []}')
    refs = files.read_refs(spark, f"{root}/refs").collect()
    assert len(refs) == 4 and sum(1 for r in refs if r.page is None) == 1
    dedup = L.dedupe_refs(files.read_refs(spark, f"{root}/refs")).collect()
    assert len(dedup) == 2
    _write(f"{root}/qd/Eni/verbal_questions_metadata.json", '{"q1": [[5, 0], [5, 1]], "q2": []}')
    assert files.read_question_refs(spark, f"{root}/qd").count() == 3
    _write(f"{root}/qs/energy/verbal_questions_metadata.json",
           '{"q1": [{"source": "Eni", "pages": [{"page_n": 5, "csv_files": ["5_0.csv", "5_2.csv"]}]}]}')
    s = files.read_question_refs(spark, f"{root}/qs", form="sector").orderBy("table_no").collect()
    assert [(r.sector, r.source, r.page, r.table_no) for r in s] == [("energy", "Eni", 5, 0), ("energy", "Eni", 5, 2)]


def test_read_qa_and_join(spark):
    root = _tmp()
    _write(f"{root}/qa.csv",
           "index,pdf name,page nbr,table nbr,gri,question_type_ext,question,value\n"
           "0,['OTC_SU_2023.pdf'],[309],[0],302,sum,\"What, total?\",12\n"
           "1,\"['A_2023', 'B_2023']\",\"['79', '46']\",\"['0', '0']\",305,rank,Q2,\"1, 2\"\n")
    qa = files.read_qa(spark, f"{root}/qa.csv").orderBy("qid").collect()
    assert qa[0].refs[0].source == "OTC_SU_2023" and qa[0].refs[0].page == 309
    assert [r.page for r in qa[1].refs] == [79, 46] and qa[0].question == "What, total?"
    tables = spark.createDataFrame([("OTC_SU_2023", 309, 0)], "source string, page int, table_no int")
    j = L.qa_tables(files.read_qa(spark, f"{root}/qa.csv"), tables).orderBy("qid", "ref_no").collect()
    assert [r.missing for r in j] == [False, True, True]


def test_list_documents(spark):
    root = _tmp()
    for name in ("a.pdf", "b.PDF", "c.txt"):
        _write(f"{root}/{name}", "x")
    names = sorted(r.title for r in files.list_documents(spark, root).collect())
    assert names == ["a", "b"]


# ------------------------------------------------------------- sinks

def test_write_and_read_tables_roundtrip(spark):
    cells = spark.createDataFrame(
        [("d", 1, 0, 0, 0, "k", "a;b"), ("d", 1, 0, 0, 1, "v", "1"), ("d", 1, 0, 1, 0, "k", "c"),
         ("d", 1, 0, 1, 1, "v", "2")],
        "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    out = _tmp() + "/t"
    writers.write_tables(cells, out)
    with open(f"{out}/d/1_0.csv") as f:
        assert f.read().splitlines() == ["k;v", '"a;b";1', "c;2"]
    back = files.read_tables(spark, out).select(cells.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    js = writers.refs_json(spark.createDataFrame([("E", "302-1", 60, 0, 0), ("E", "302-1", 61, 2, 1)],
                                                 "source string, code string, page int, table_no int, ordinal int"))
    assert js.collect()[0].json == '{"302-1":[[60,0],[61,2]]}'


# ------------------------------------------------------------- filters / ingest

def test_validate_and_delete(spark):
    with pytest.raises(ValueError):
        filters.validate_retrieval([], False, False, True)
    with pytest.raises(ValueError):
        filters.validate_retrieval([("model_name", "x")], False, False, True)
    with pytest.raises(ValueError):
        filters.validate_retrieval([("source", "a")], True, False, True)
    filters.validate_retrieval([("source", "a")], False, False, True)
    store = spark.createDataFrame([("x",), ("y",)], "chunk_id string")
    with pytest.raises(ValueError):
        ingest.delete_chunks(store, "everything")
    assert ingest.delete_chunks(store, "all").count() == 0
    assert ingest.delete_chunks(store, ["x"]).count() == 1


def test_ingest_twice_equals_once(spark):
    rows = [("s", 1, "alpha beta"), ("s", 2, "gamma"), ("s", 2, "gamma")]
    batch = spark.createDataFrame(rows, "source string, page int, content string").withColumns(
        {"model_name": F.lit("m"), "company_name": F.lit("c"), "company_sectors": F.array(F.lit("x"))})
    batch = ingest.with_chunk_id(batch)
    empty = batch.limit(0)
    new1, _ = ingest.split_new(batch, empty)
    store = new1.cache()
    new2, skipped = ingest.split_new(batch, store)
    assert store.count() == 2 and new2.count() == 0 and skipped.count() == 2


def test_chunks_cover_page(spark):
    text = "".join(chr(97 + i % 26) for i in range(9000))
    pages = spark.createDataFrame([("s", 1, text)], "source string, page int, text string")
    ch = sorted(ingest.chunk_fixed(pages, 4000, 200).collect(), key=lambda r: r.chunk_no)
    rebuilt = ch[0].content + "".join(c.content[200:] for c in ch[1:])
    assert rebuilt == text and all(len(c.content) <= 4000 for c in ch)


# ------------------------------------------------------------- retrieval

def _brute_tfidf(docs, query, k):
    import re
    tok = lambda s: re.findall(r"(?u)\b\w\w+\b", s.lower())
    n = len(docs)
    vocab = {}
    for d in docs.values():
        for t in set(tok(d)):
            vocab[t] = vocab.get(t, 0) + 1
    idf = {t: math.log((1 + n) / (1 + c)) + 1 for t, c in vocab.items()}

    def vec(s):
        v = {}
        for t in tok(s):
            if t in idf:
                v[t] = v.get(t, 0) + idf[t]
        nrm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / nrm for t, x in v.items()}
    q = vec(query)
    scores = {p: sum(q.get(t, 0) * w for t, w in vec(d).items()) for p, d in docs.items()}
    return sorted(scores.items(), key=lambda kv: (-round(kv[1], 9), kv[0]))[:k]


def test_sparse_topk_matches_brute_force(spark):
    docs = {1: "The energy use of the plant rose", 2: "water withdrawal and water use", 3: "scope one emissions",
            4: "energy energy energy", 5: "", 6: "plant water energy emissions"}
    chunks = spark.createDataFrame([("s", p, c) for p, c in docs.items()], "source string, page int, content string")
    queries = spark.createDataFrame([(0, "energy use of water"), (1, "nothing matches zz")],
                                    "query_id int, text string")
    got = R.sparse_topk(queries, R.tfidf_fit(chunks), k=5).orderBy("query_id", "rank").collect()
    for qid, qtext in ((0, "energy use of water"), (1, "nothing matches zz")):
        exp = _brute_tfidf(docs, qtext, 5)
        mine = [(r.page, r.score) for r in got if r.query_id == qid]
        assert [p for p, _ in mine] == [p for p, _ in exp]
        assert all(abs(a - b) < 1e-9 for (_, a), (_, b) in zip(mine, exp))


def test_chunks_of_one_page_are_kept_apart(spark):
    import math
    chunks = spark.createDataFrame([("s", 1, 0, "energy use"), ("s", 1, 1, "water use"), ("s", 2, 0, "waste")],
                                   "source string, page int, chunk_no int, content string")
    model = R.tfidf_fit(chunks)
    idf = {r.term: r.idf for r in model.idf.collect()}
    assert abs(idf["use"] - (math.log(4 / 3) + 1)) < 1e-12
    q = spark.createDataFrame([(0, "water use")], "query_id int, text string")
    sparse = R.sparse_topk(q, model, 3)
    assert [(r.page, r.chunk_no) for r in sparse.orderBy("rank").collect()] == [(1, 1), (1, 0), (2, 0)]
    dense = sparse.withColumn("score", F.lit(0.5))
    assert R.fuse(dense, sparse, 5).count() == 3
    with pytest.raises(Exception, match="share one key"):
        R.tfidf_fit(chunks, ["source"], ["page"]).idf.collect()


def test_fuse_lambda_zero_ranks_like_dense(spark):
    dense = spark.createDataFrame([(0, "s", 1, 1, 0.1), (0, "s", 2, 2, 0.2), (0, "s", 3, 3, 0.5)],
                                  "query_id int, source string, page int, rank int, score double")
    sparse = spark.createDataFrame([(0, "s", 4, 1, 0.9), (0, "s", 1, 2, 0.3)],
                                   "query_id int, source string, page int, rank int, score double")
    out = R.fuse(dense, sparse, k=5, lmbd=0.0).orderBy("rank").collect()
    assert [r.page for r in out][:3] == [4, 1, 2] or [r.page for r in out][:3] == [1, 2, 3]
    assert [r.page for r in out if r.page in (1, 2, 3)] == [1, 2, 3]
    out = R.fuse(dense, sparse, k=5, lmbd=0.3).orderBy("rank").collect()
    assert out[0].page == 4  # a sparse-only hit outranks dense-only ones (absent side adds 0)


def test_dense_topk_exact(spark):
    vecs = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 1.0]), ("s", 3, [1.0, 1.0]),
                                  ("s", 4, None)], "source string, page int, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, embedding array<float>")
    out = R.dense_topk(q, vecs, k=2).orderBy("rank").collect()
    assert [r.page for r in out] == [1, 3]
    sim = R.dense_topk(q, vecs, k=1, score="similarity").collect()[0]
    assert sim.page == 1 and sim.score > 0.99


# ------------------------------------------------------------- linking / context

def test_prune_all_yes_is_identity(spark):
    refs = spark.createDataFrame([("d", "c1", 1, 0, 0), ("d", "c1", 2, 0, 1), ("d", "c2", None, None, 0)],
                                 "source string, code string, page int, table_no int, ordinal int")
    tables = spark.createDataFrame([("d", 1, 0), ("d", 2, 0)], "source string, page int, table_no int")
    verdicts = refs.where("page IS NOT NULL").select("source", "code", "page", "table_no",
                                                     F.lit("yes").alias("verdict"))
    kept = L.prune_refs(refs, verdicts, tables)
    assert kept.count() == 2
    no = verdicts.withColumn("verdict", F.lit("NO"))
    assert L.prune_refs(refs, no, tables).count() == 0


def test_fill_placeholders_and_insert(spark):
    pages = spark.createDataFrame([("d", 191, "A\n[TABLEPLACEHOLDER 0]\nB [TABLEPLACEHOLDER 5]")],
                                  "source string, page int, text string")
    tt = spark.createDataFrame([("d", 191, 0, "k,v\n1,2\n")], "source string, page int, table_no int, table_text string")
    out = X.fill_placeholders(pages, tt).collect()[0].text
    assert out == "A\n\n[Table from page 191, num 0]\nk,v\n1,2\n\nB "
    texts = spark.createDataFrame([("x", "see <Table1> and <Table2>")], "source string, text string")
    tabs = spark.createDataFrame([("x", 1, "<table></table>")], "source string, j int, html string")
    assert X.insert_tables(texts, tabs).collect()[0].text == "see <table></table> and <Table2>"


def test_select_cells_and_facts(spark):
    cells = spark.createDataFrame(
        [("d", 1, 0, 0, 0, "Indicator", "Energy use"), ("d", 1, 0, 0, 1, "Units", "GJ"),
         ("d", 1, 0, 0, 2, "2023", "10,291"), ("d", 1, 0, 0, 3, "2022", "9%"),
         ("d", 1, 0, 1, 0, "Indicator", "Water"), ("d", 1, 0, 1, 1, "Units", "m3"),
         ("d", 1, 0, 1, 2, "2023", "UP"), ("d", 1, 0, 1, 3, "2022", "(5)")],
        "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    q = spark.createDataFrame([(7, "What was the energy use in 2023?", "d", 1, 0)],
                              "question_id int, question string, source string, page int, table_no int")
    sel = T.select_cells(q, cells).collect()[0]
    assert sel.rows == [0] and sel.row_names == ["Energy use"] and sel.cols == [2]
    facts = {(r.row_label, r.year): (r.unit, r.value) for r in T.to_facts(cells).collect()}
    assert facts[("Energy use", 2023)] == ("GJ", 10291.0)
    assert facts[("Water", 2022)] == ("m3", -5.0) and facts[("Water", 2023)][1] is None


def test_noise_tables(spark):
    tables = spark.createDataFrame([("d", p, t) for p in (1, 2) for t in (0, 1)] + [("e", 9, 0)],
                                   "source string, page int, table_no int")
    targets = spark.createDataFrame([("t1", "d", 1, 0), ("t2", "e", 9, 0)],
                                    "target_id string, source string, page int, table_no int")
    out = L.add_noise_tables(targets, tables).orderBy("target_id", "noise_rank").collect()
    assert [(r.noise_page, r.noise_table_no) for r in out if r.target_id == "t1"] == [(1, 1), (2, 0)]
    assert not [r for r in out if r.target_id == "t2"]


# ------------------------------------------------------------- evaluation

EVAL_CASES = [
    ("What is it?", "12", "12", "extra", True),
    ("What is it?", "12", "12 tonnes", "extra", True),
    ("What %?", "45", "0.45", "rel", True),
    ("How many?", "<38", "< 38 kg", "extra", True),
    ("How many?", "10291", "10,291", "rel", True),
    ("Range?", "25-30", "25 – 30", "extra", True),
    ("List?", "1, 2", "['1', '2']", "rel", True),
    ("What?", "12", "nan", "extra", False),
    ("What?", "12", "13", "rel", False),
    ("Which?", "yes", "Yes.", "rel", True),
]


def test_evaluate_cascade(spark):
    df = spark.createDataFrame([(i, "m", q, v, r, d) for i, (q, v, r, d, _) in enumerate(EVAL_CASES)],
                               "qid int, model string, question string, value string, response string, dataset string")
    got = {r.qid: r.correct for r in E.evaluate(df).collect()}
    assert [got[i] for i in range(len(EVAL_CASES))] == [c[-1] for c in EVAL_CASES]
    em = E.exact_match(E.evaluate(df)).collect()[0]
    assert em.em == 80.0 and em.n == len(EVAL_CASES)


# ------------------------------------------------------------- added coverage

def test_recursive_split_example(spark):
    pages = spark.createDataFrame([("s", 1, "aaaa bbbb cccc dddd"), ("s", 2, None)], "source string, page int, text string")
    out = ingest.chunk_packed(pages, 10, 3).orderBy("chunk_no").collect()
    assert [r.content for r in out] == ["aaaa bbbb", "cccc dddd"]
    ok, failed = ingest.chunk_with_errors(pages.withColumn("error", F.lit(None).cast("string")))
    assert ok.count() == 1 and failed.collect()[0].reason == "no text"


def test_limit_and_index_join(spark):
    qa = spark.createDataFrame([(i, f"q{i}", i % 2) for i in range(10)], "qid int, question string, hierarchical int")
    assert [r.qid for r in E.limit_questions(qa, 3).collect()] == [0, 1, 2]
    res = spark.createDataFrame([(3, True), (4, False)], "qid int, correct boolean")
    j = {r.qid: r.hierarchical for r in L.join_on_index(res, qa).collect()}
    assert j == {3: 1, 4: 0}


def test_sinks_pages_metrics_sector(spark):
    root = _tmp()
    pages = spark.createDataFrame([("d", 1, "text one"), ("d", 2, "text two")], "source string, page int, text string")
    writers.write_pages(pages, f"{root}/pages")
    back = files.read_pages(spark, f"{root}/pages")
    assert back.count() == 2
    writers.write_metrics(spark.createDataFrame([("cot", 93.1)], "model string, em double"), f"{root}/m")
    m = spark.read.option("header", True).csv(f"{root}/m").collect()[0]
    assert (m.model, m.em) == ("cot", "93.1")
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, "k", "x"), ("d", 2, 0, 0, 0, "k", "y")],
                                  "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    hits = spark.createDataFrame([("energy", "d", 1)], "sector string, source string, page int")
    writers.export_sector(pages, cells, hits, f"{root}/sec")
    assert [tuple(r) for r in files.read_pages(spark, f"{root}/sec/energy").collect()] == [("d", 1, "text one")]
    assert [(r.source, r.page, r.header, r.cell) for r in files.read_tables(spark, f"{root}/sec").collect()] == [("d", 1, "k", "x")]


def test_index_table(spark):
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, "k", "a"), ("d", 1, 0, 0, 1, "v", "1"),
                                   ("d", 1, 0, 1, 0, "k", "b"), ("d", 1, 0, 1, 1, "v", "2")],
                                  "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    got = {(r.row_idx, r.col_idx): r.cell for r in T.index_table(cells).collect()}
    assert got[(-1, 0)] == "index" and got[(-1, 1)] == "k" and got[(0, 0)] == "0" and got[(1, 2)] == "2"


def test_tfidf_model_checkpoint_and_store(spark):
    docs = spark.createDataFrame([("s", 1, "energy water"), ("s", 2, "water water"), ("t", 3, "energy")],
                                 "source string, page int, content string")
    q = spark.createDataFrame([(0, "water")], "query_id int, text string")
    model = R.tfidf_fit(docs)
    base = sorted((r.source, r.page, r.rank, round(r.score, 9)) for r in R.sparse_topk(q, model, 2).collect())
    ck = sorted((r.source, r.page, r.rank, round(r.score, 9)) for r in R.sparse_topk(q, model.checkpoint(), 2).collect())
    path = _tmp() + "/model"
    model.save(path)
    loaded = R.TfidfModel.load(spark, path, ["source"], ["page"])
    st = sorted((r.source, r.page, r.rank, round(r.score, 9)) for r in R.sparse_topk(q, loaded, 2).collect())
    assert base == ck == st and ("s", 2, 1) in [x[:3] for x in base]


def test_dense_query_blocks_match_single_block(spark, monkeypatch):
    import random
    rnd = random.Random(7)
    vecs = spark.createDataFrame([("s" if i % 2 else "t", i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(60)],
                                 "source string, page int, embedding array<float>")
    q = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(8)]) for i in range(25)],
                              "query_id int, embedding array<float>")
    one = sorted((r.query_id, r.source, r.rank, r.page) for r in R.dense_topk(q, vecs, 3).collect())
    monkeypatch.setattr(R, "QUERY_BLOCK_BYTES", 300)
    monkeypatch.setattr(R, "CELL_DOCS", 7)
    monkeypatch.setattr(R.scoring, "SCORE_CELLS", 40)
    many = sorted((r.query_id, r.source, r.rank, r.page) for r in R.dense_topk(q, vecs, 3).collect())
    assert one == many and len(one) == 25 * 2 * 3


def test_golden_ratio_ranking_low_desc(spark):
    f = _facts(spark, [("s", "a", 1, 707033.0), ("s", "b", 1, 688474.0),
                       ("t", "a", 1, 417294.0), ("t", "b", 1, 512802.0),
                       ("u", "a", 1, 900000.0), ("u", "b", 1, 100000.0)])
    ratio = Q.q_ratio(f, ["company"], F.col("metric") == "a", F.col("metric") == "b").withColumn("metric", F.lit("m"))
    r = Q.two_step(ratio, ["metric"], "rank", item="company", n=2, pick="low", order="desc").collect()[0]
    assert r.answer == "102.70, 81.38"


def test_delete_from_bucketed_store(spark):
    import glob
    rows = [(f"id{i}", f"s{i % 7}", i) for i in range(70)]
    chunks = ingest.with_store_bucket(spark.createDataFrame(rows, "chunk_id string, source string, page int"), n=16)
    root = _tmp()
    chunks.write.partitionBy("bucket").parquet(f"{root}/store")
    before = {d: os.path.getmtime(d) for d in glob.glob(f"{root}/store/bucket=*")}
    doomed = spark.createDataFrame([("id0",), ("id7",), ("id3",)], "chunk_id string")
    n = writers.delete_from_store(spark, f"{root}/store", doomed, f"{root}/staging")
    left = spark.read.parquet(f"{root}/store")
    assert left.count() == 67 and left.where(F.col("chunk_id").isin("id0", "id7", "id3")).count() == 0
    touched = {r.bucket for r in chunks.where(F.col("chunk_id").isin("id0", "id7", "id3")).collect()}
    assert n == len(touched)
    after = {d: os.path.getmtime(d) for d in glob.glob(f"{root}/store/bucket=*")}
    untouched = [d for d in before if int(d.rsplit("=", 1)[1]) not in touched]
    assert untouched and all(after[d] == before[d] for d in untouched)


def test_stream_ingest_incremental_and_idempotent(spark):
    from tabloom.streaming.ingest_stream import ingest_stream
    root = _tmp()
    schema = "source string, page int, content string"

    def to_chunks(batch):
        b = batch.withColumns({"model_name": F.lit("m"), "company_name": F.col("source"),
                               "company_sectors": F.array(F.lit("x"))})
        return ingest.with_chunk_id(b).select("chunk_id", "source", "page", "content")

    spark.createDataFrame([("a", 1, "one"), ("a", 2, "two")], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    file_schema = spark.read.parquet(f"{root}/in").schema
    q = ingest_stream(spark, f"{root}/in", file_schema, f"{root}/store",
                      f"{root}/ckpt", to_chunks)
    q.awaitTermination()
    assert spark.read.parquet(f"{root}/store").count() == 2
    # a new file arrives: one new chunk and one repeat of an already stored chunk
    spark.createDataFrame([("a", 2, "two"), ("b", 1, "three")], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    q = ingest_stream(spark, f"{root}/in", file_schema, f"{root}/store",
                      f"{root}/ckpt", to_chunks)
    q.awaitTermination()
    store = spark.read.parquet(f"{root}/store")
    assert store.count() == 3 and store.select("chunk_id").distinct().count() == 3


def test_stored_index_reused_and_rebuilt_on_change(spark):
    import time
    from tabloom.plans.index_store import stored_tfidf
    root = _tmp()
    spark.createDataFrame([("s", 1, "energy water"), ("s", 2, "water")], "source string, page int, content string") \
        .coalesce(1).write.parquet(f"{root}/docs")
    calls = []

    def build():
        calls.append(1)
        return spark.read.parquet(f"{root}/docs")
    q = spark.createDataFrame([(0, "water")], "query_id int, text string")
    m1 = stored_tfidf(spark, "t", [f"{root}/docs"], build, ["source"], ["page"])
    m2 = stored_tfidf(spark, "t", [f"{root}/docs"], build, ["source"], ["page"])
    assert len(calls) == 1
    assert [r.page for r in R.sparse_topk(q, m2, 2).orderBy("rank").collect()] == [2, 1]
    time.sleep(1.1)
    spark.createDataFrame([("s", 1, "energy water water water"), ("s", 2, "energy")],
                          "source string, page int, content string").coalesce(1).write.mode("overwrite") \
        .parquet(f"{root}/docs")
    m3 = stored_tfidf(spark, "t", [f"{root}/docs"], build, ["source"], ["page"])
    assert len(calls) == 2
    assert [r.page for r in R.sparse_topk(q, m3, 2).orderBy("rank").collect()] == [1, 2]


# ------------------------------------------------------------- shapes that used to lose data

def test_read_tables_keeps_blank_fields_and_lone_quotes(spark):
    import os
    root = _tmp()
    os.makedirs(f"{root}/doc")
    with open(f"{root}/doc/3_0.csv", "w", encoding="utf-8") as f:
        f.write(';2023;2022\nCO2;1;2\n;7;\n\n5" pipe;;3\n"a;b";"x ""y""";"two\nlines"\n"open;8;9\n')
    got = {}
    for r in files.read_tables(spark, root).collect():
        got.setdefault(r.row_idx, {})[r.col_idx] = (r.header, r.cell)
    rows = [[got[i][c][1] for c in sorted(got[i])] for i in sorted(got)]
    assert rows == [["CO2", "1", "2"], ["", "7", ""], ['5" pipe', "", "3"], ["a;b", 'x "y"', "two\nlines"], ['"open', "8", "9"]]
    assert [got[0][c][0] for c in range(3)] == ["", "2023", "2022"]
    bare = files.read_tables(spark, root, header=False)
    assert bare.where("row_idx = 0").orderBy("col_idx").select("cell").first().cell == ""


def test_repair_keeps_cells_beyond_the_header_and_headerless_tables(spark):
    rows = [("s", 1, 0, 0, 0, "h", "a"), ("s", 1, 0, 0, 1, None, "note"), ("s", 1, 0, 1, 0, "h", "b"),
            ("s", 1, 1, 0, 0, None, "x"), ("s", 1, 1, 0, 2, None, "z")]
    cells = spark.createDataFrame(rows, "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    got = {(r.table_no, r.row_idx, r.col_idx): r.cell for r in T.repair_table(cells).collect()}
    assert got == {(0, 0, 0): "a", (0, 0, 1): "note", (0, 1, 0): "b", (0, 1, 1): "NaN",
                   (1, 0, 0): "x", (1, 0, 1): "NaN", (1, 0, 2): "z"}


def test_unique_headers_avoid_names_that_exist(spark):
    rows = [("s", 1, 0, 0, i, h, "v") for i, h in enumerate(["a", "a", "a_1", " ", "A"])]
    cells = spark.createDataFrame(rows, "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    got = [r.header for r in T.unique_headers(cells).orderBy("col_idx").collect()]
    assert got == ["a", "a_2", "a_1", "col_3", "A_3"]


def test_qa_lists_of_either_quote_kind(spark):
    import os
    root = _tmp()
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/qa.csv", "w", encoding="utf-8") as f:
        f.write('index,pdf name,page nbr,table nbr,question,value\n')
        f.write('0,"[""L\'Oreal.pdf"", \'b.pdf\']","[1, 2]","[0, 3]",q,1\n1,not a list,[1],[0],q2,2\n')
    got = {r.qid: r.refs for r in files.read_qa(spark, f"{root}/qa.csv").collect()}
    assert [(r.source, r.page, r.table_no) for r in got[0]] == [("L'Oreal", 1, 0), ("b", 2, 3)]
    qa = spark.createDataFrame([(1, None), (2, [("s", 1, 0)])], "qid int, refs array<struct<source:string,page:int,table_no:int>>")
    tables = spark.createDataFrame([("s", 1, 0)], "source string, page int, table_no int")
    assert sorted((r.qid, r.missing) for r in L.qa_tables(qa, tables).collect()) == [(1, True), (2, False)]


def test_small_wrong_answers(spark):
    from tabloom.functions import numbers as N, text as X
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(N.format_answer(F.lit(1.0049999996))) == "1.00" and one(N.format_answer(F.lit(1.005))) == "1.01"
    assert one(X.url_quote(F.lit("a b/~*+é"))) == "a%20b/~%2A%2B%C3%A9"
    assert one(X.strip_markdown(F.lit("```x\ncode\n``` **b** ```one```"))) == "code\n b `one"
    html = spark.createDataFrame([("s", 1, "<ul><li><p>x</p></li><li>y</li></ul><p>t</p>")], "source string, page int, html string")
    assert [(r.category, r.text.replace(" ", "")) for r in L.html_elements(html).orderBy("elem_idx").collect()] == [("Table", "xy"), ("Text", "t")]
    f = spark.createDataFrame([("c", "m", 1, 2.0), ("c", "m", 1, 3.0), ("c", "m", 2, 5.0)], "company string, metric string, year int, value double")
    with pytest.raises(Exception, match="several values"):
        Q.q_ratio(f, ["company"], F.col("year") == 1, F.col("year") == 2).collect()


def test_delete_every_row_of_a_bucket(spark):
    rows = [(f"id{i}", "s", i) for i in range(5)]
    chunks = ingest.with_store_bucket(spark.createDataFrame(rows, "chunk_id string, source string, page int"), n=4)
    root = _tmp()
    chunks.write.partitionBy("bucket").parquet(f"{root}/store")
    assert writers.delete_from_store(spark, f"{root}/store", chunks.select("chunk_id"), f"{root}/stage") == 1
    assert spark.read.schema(chunks.schema).parquet(f"{root}/store").count() == 0


def test_retrieval_call_checks_filters_and_modes(spark):
    chunks = spark.createDataFrame([("s", 1, "energy use"), ("s", 2, "water"), ("t", 1, "energy")], "source string, page int, content string")
    vecs = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [0.0, 1.0]), ("t", 1, [1.0, 0.0])], "source string, page int, embedding array<float>")
    qt = spark.createDataFrame([(0, "energy")], "query_id int, text string")
    qv = spark.createDataFrame([(0, [1.0, 0.1])], "query_id int, embedding array<float>")
    for mode in ("use_dense", "use_sparse", "use_ensemble"):
        out = R.retrieve(chunks, vecs, qt, qv, [("source", "s")], k=1, with_scores=False, **{mode: True})
        assert "score" not in out.columns and [(r.source, r.page) for r in out.collect()] == [("s", 1)]
    with pytest.raises(ValueError):
        R.retrieve(chunks, vecs, qt, qv, [], use_sparse=True)


def test_vectors_are_appended(spark):
    root = _tmp() + "/vectors"
    vecs = spark.createDataFrame([("s", 1, [1.0])], "source string, page int, embedding array<float>")
    writers.append_vectors(vecs, root)
    writers.append_vectors(vecs, root)
    assert spark.read.parquet(root).count() == 2


def test_header_lines_and_row_units(spark):
    grid = [["", "", "2023", "2022"], ["", " ", "Group", "Group"], ["Energy use", "(TJ)", "14334", "16665"], ["Water (m3)", "", "7", "8"]]
    rows = [("s", 1, 0, i, j, h, c) for i, line in enumerate(grid[1:]) for j, (h, c) in enumerate(zip(grid[0], line))]
    cells = spark.createDataFrame(rows, "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string")
    facts = T.to_facts(T.merge_header_rows(cells)).where("value is not null").collect()
    got = {(r.row_label, r.year): (r.column_label, r.unit, r.value) for r in facts}
    assert got == {("Energy use", 2023): ("2023 Group", "TJ", 14334.0), ("Energy use", 2022): ("2022 Group", "TJ", 16665.0),
                   ("Water (m3)", 2023): ("2023 Group", "m3", 7.0), ("Water (m3)", 2022): ("2022 Group", "m3", 8.0)}


def test_qa_reads_the_multi_table_columns(spark):
    root = _tmp()
    _write(f"{root}/multi.csv", "Unnamed: 0,pdf name,page nbr,table nbr,answer_value,answer_company,unit,years,question,question_type_ext,gri,value\n"
           "4,\"['a', 'b']\",\"['310', '47']\",\"['1', '1']\",28,\"['a']\",MWh,\"[2023, 2022]\",q,sum,302,28\n")
    r = files.read_qa(spark, f"{root}/multi.csv").collect()[0]
    assert (r.unit, r.years, r.answer_value, r.answer_companies) == ("MWh", [2023, 2022], "28", ["a"])
    assert [(x.source, x.page, x.table_no) for x in r.refs] == [("a", 310, 1), ("b", 47, 1)]

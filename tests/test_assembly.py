"""Context and prompts assembled in the order of their requests."""

import time

import pytest
from pyspark.sql import functions as F

from tabloom.operators import link as L
from tabloom.operators import assembly as A
from tabloom.operators import context as X

REQ = "query_id int, question string, name string, ordinal int"
REF = "query_id int, name string, source string, page int, ordinal int"
TT = "source string, page int, table_no int, table_text string"


def _inputs(spark):
    pages = spark.createDataFrame([("a", 1, "x [TABLEPLACEHOLDER 0] y [TABLEPLACEHOLDER 7]"), ("a", 2, None), ("b", 1, "z"), ("b", 1, "y")],
                                  "source string, page int, text string")
    return pages, spark.createDataFrame([("a", 1, 0, "t\n"), ("a", 9, 0, "u\n")], TT)


def test_document_form(spark):
    req = spark.createDataFrame([(1, "q", "b", 1), (1, "q", "a", 0), (1, "q", "a", 5), (1, "q", "c", 2), (1, "q", "d", 3), (2, "r", "a", 0)], REQ)
    known = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("a",)], "name string")
    refs = spark.createDataFrame([(1, "a", "a", 2, 1), (1, "a", "a", 1, 0), (1, "a", "a", 1, 4), (1, "a", "a", 8, 2),
                                  (1, "b", "b", 1, 0), (1, "d", "d", None, None)], REF)
    got = {r.query_id: (r.context, r.reply) for r in A.assemble_context(req, known, refs, *_inputs(spark)).collect()}
    assert got[1] == (
        "Company name: a\n\n\n---\n# Page 1\nx \n[Table from page 1, num 0]\nt\n y \n\n---\n# Page 2\n\n\n---\n"
        "Company name: b\n\n\n---\n# Page 1\nz\n\n---\n"
        "⚠️ No references found for query 'q' in c\n"
        "Company name: d\n\n\n---\n", None)
    assert got[2] == ("⚠️ No references found for query 'r' in a\n", None)


def test_an_unknown_file_ends_the_reply(spark):
    req = spark.createDataFrame([(1, "q", "a", 0), (1, "q", "y", 2), (1, "q", "z", 1), (2, None, "a", 0)], REQ)
    known = spark.createDataFrame([("a",)], "name string")
    refs = spark.createDataFrame([], REF)
    got = {r.query_id: (r.context, r.reply) for r in A.assemble_context(req, known, refs, *_inputs(spark)).collect()}
    assert got == {1: (None, "⚠️ No metadata.json found for z"), 2: ("⚠️ No references found for query '' in a\n", None)}
    assert A.assemble_context(req.where("false"), known, refs, *_inputs(spark)).count() == 0
    with pytest.raises(ValueError):
        A.assemble_context(req, known, refs, *_inputs(spark), form="x")


def test_sector_form(spark):
    req = spark.createDataFrame([(1, "q", n, i) for i, n in enumerate(["oil", "new", "gas"])], REQ)
    known = spark.createDataFrame([("oil",), ("gas",)], "name string")
    refs = spark.createDataFrame([(1, "oil", "b", 1, 0), (1, "oil", "a", 1, 1)], REF)
    row = A.assemble_context(req, known, refs, *_inputs(spark), form="sector").first()
    assert row.reply is None and row.context == (
        "Sector: oil\n\n\n---\n# Source: b\n# Page 1\nz\n\n---\n# Source: a\n# Page 1\nx \n[Table from a - page 1, num 0]\nt\n y \n\n---\n"
        "⚠️No metadata found for the sector 'new'\n"
        "⚠️  No reference found for query “q” in sector 'gas'\n")


def test_markers_run_over_all_files(spark):
    t = spark.createDataFrame([("s", "b", 1, 0, "<b10>"), ("s", "a", 10, 0, "<a100>"), ("s", "a", 2, 1, "<a21>"), ("u", "b", 1, 0, "<v>")],
                              "name string, source string, page int, table_no int, html string")
    assert sorted((r.name, r.source, r.page, r.j) for r in A.number_markers(t).collect()) == [
        ("s", "a", 2, 1), ("s", "a", 10, 2), ("s", "b", 1, 3), ("u", "b", 1, 1)]
    end = ". Analyse the main values to answer the question."
    texts = {r.name: r.text for r in A.marker_texts(t, "sector").collect()}
    assert texts["s"] == ("Sector: s\nThe following reports were analysed: a, b.\nConsider the data shown in the following tables: "
                          "<Table1> e <Table2> e <Table3>" + end)
    got = {r.name: r.text for r in A.table_prompts(t).collect()}
    assert got["s"] == "File: s\nConsider the data shown in the following tables<a21> e <a100> e <b10>" + end
    assert A.table_prompts(t.where("false"), "sector").count() == 0


def test_all_shown_text_of_a_page_is_an_element(spark):
    html = ("<html><head><title>no</title></head><body>lead <b>in</b><script>no()</script><ul><li>x</li></ul>\n <!-- no -->"
            "<div>free &amp; open<p>para</p></div>tail<table><tr><td>1</td></tr></table></body></html>")
    pages = spark.createDataFrame([("s", 1, html), ("s", 2, "plain"), ("s", 3, ""), ("s", 4, None), ("s", 5, "a <ul> b")],
                                  "source string, page int, html string")
    got = sorted((r.page, r.elem_idx, r.category, r.text) for r in L.html_elements(pages).collect())
    assert got == [(1, 0, "Text", "lead in"), (1, 1, "Table", "x"), (1, 2, "Text", "free & open"), (1, 3, "Text", "para"),
                   (1, 4, "Text", "tail"), (1, 5, "Table", "1"), (2, 0, "Text", "plain"), (5, 0, "Text", "a  b")]
    text = {r.page: r.text for r in L.page_text_with_placeholders(L.html_elements(pages)).collect()}
    assert text[1] == "lead in\n[TABLEPLACEHOLDER 0]\nfree & open\npara\ntail\n[TABLEPLACEHOLDER 1]"


def test_markers_find_sparse_repeated_and_missing_numbers(spark):
    texts = spark.createDataFrame([("a", "<Table1>x<Table900>y<Table2><Table7>"), ("a", None), ("b", "<Table1>"), (None, "<Table1>"), ("a", "plain")], "source string, text string")
    tables = spark.createDataFrame([("a", 1, "one"), ("a", 2, "zwei"), ("a", 2, "two"), ("a", 900, "far"), ("a", 7, None), (None, 1, "none"), ("a", None, "void")],
                                   "source string, j int, html string")
    got = sorted((r.source or "", r.text or "") for r in X.insert_tables(texts, tables).collect())
    assert got == [("", "<Table1>"), ("a", ""), ("a", "onexfaryzwei<Table7>"), ("a", "plain"), ("b", "<Table1>")]


def test_prompt_of_many_tables(spark):
    n = 20_000
    tables = spark.range(n).select(F.lit("s").alias("name"), F.lit("f").alias("source"), F.col("id").alias("page"), F.lit(0).alias("table_no"),
                                   F.concat(F.lit("t"), F.col("id").cast("string")).alias("html"))
    start = time.monotonic()
    text = A.table_prompts(tables).first().text
    assert text.endswith(A.PROMPT_BETWEEN.join(f"t{i}" for i in range(n)) + A.PROMPT_END)
    assert time.monotonic() - start < 45  # over 55 s where every marker walks through all tables

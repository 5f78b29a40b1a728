"""Tables as stored rows in buckets: what is grouped by table is not moved; operators without joins keep their rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabloom.functions.numbers import with_parsed_number
from tabloom.operators import quant as Q
from tabloom.operators import tables as T
from tabloom.plans import table_plans as P
from tabloom.sources import driver

CELL = "source string, page long, table_no int, row_idx int, col_idx int, header string, cell string"


def shuffles(df) -> int:
    """Exchanges of rows by a hash, as planned."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    day = dt.datetime(1995, 3, 1)
    lines = [(k, 10 + n, 1, n, 5.0 + n, 1234.5, 0.05, 0.0 if n else 0.02, "R" if n else "N", "O", day) for k in range(40) for n in range(1 + k % 3)]
    lines += [lines[0], (None, 1, 1, 0, 1.0, 1.0, 0.0, 0.0, "N", "O", day)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in [*range(40), 3]], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(0, "a"), (1, "b"), (1, "b"), (2, None)], "doc_id long, source string").write.parquet(f"{d}/documents.parquet")
    return d


def test_stored_cells_equal_derived_ones(spark, sf):
    rows = lambda df: sorted(map(repr, df.collect()))
    stored = rows(driver.cells(spark, sf))
    assert stored == rows(driver.derive_cells(spark, sf)) == rows(driver.cells(spark, sf))
    # order 0 has one line twice, order 3 stands twice, page 1 twice, page 2 has no source
    n = {(r.page, r.table_no): r["n"] for r in driver.cells(spark, sf).where("col_idx = 0").groupBy("page", "table_no").agg(F.count("*").alias("n")).collect()}
    assert n[(0, 0)] == 2 and n[(0, 3)] == 2 and n[(0, 4)] == 2 and n[(1, 1)] == 4 and n[(2, 2)] == 3
    one = spark.createDataFrame([("a", 0, 4)], "source string, page long, table_no int")
    assert {(r.page, r.table_no) for r in driver.cells(spark, sf, only=one).collect()} == {(0, 4)}


@pytest.mark.parametrize("name", ["repair_tables", "drop_empty_rows", "render_tables_csv", "render_tables_html", "table_preview", "unique_headers"])
def test_stored_cells_are_not_moved(spark, sf, name):
    assert shuffles(getattr(P, f"q_{name}")(spark, sf)) == 0


def test_edits_meet_their_cells_unmoved(spark, sf):
    threshold = "spark.sql.autoBroadcastJoinThreshold"  # as with edits that are too large to broadcast
    was = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        edited = P.q_apply_edits(spark, sf)
        assert shuffles(edited) == 0
        got = sorted(map(repr, edited.collect()))
    finally:
        spark.conf.set(threshold, was)
    cell = F.when((F.col("col_idx") == 1) & (F.col("cell") == "R") & F.col("source").isNotNull(), P.EDIT_TEXT).otherwise(F.col("cell"))
    want = driver.derive_cells(spark, sf).withColumn("cell", cell)
    assert got == sorted(map(repr, want.collect())) and any(f"cell='{P.EDIT_TEXT}'" in r for r in got)


@pytest.mark.parametrize("aligned", [False, True])
def test_edits_of_repeated_and_null_positions(spark, aligned):
    cells = spark.createDataFrame([("a", 1, 0, 0, 0, "h", "x"), ("a", 1, 0, 0, 1, None, "y"), ("a", 1, 0, 0, 1, None, "z"), ("a", 1, 0, 1, 0, "h", None),
                                   ("b", 1, 0, 0, 0, "h", "x"), (None, 1, 0, 0, 0, "h", "n"), ("b", 2, 0, 0, None, "h", "c")], CELL)
    edits = spark.createDataFrame([("a", 1, 0, 0, 0, "X"), ("a", 1, 0, 0, 1, "Y1"), ("a", 1, 0, 0, 1, "Y2"), ("a", 1, 0, 1, 0, "new"), ("b", 1, 0, 0, 0, None),
                                   (None, 1, 0, 0, 0, "N"), ("b", 2, 0, 0, None, "C"), ("c", 1, 0, 0, 0, "no such cell")],
                                  "source string, page long, table_no int, row_idx int, col_idx int, new_cell string")
    # A cell stands once for each of its edits, an edit to null leaves it, and positions that hold a null match nothing.
    want = spark.createDataFrame([("a", 1, 0, 0, 0, "h", "X"), ("a", 1, 0, 1, 0, "h", "new"), ("b", 1, 0, 0, 0, "h", "x"), (None, 1, 0, 0, 0, "h", "n"),
                                ("b", 2, 0, 0, None, "h", "c"), *[("a", 1, 0, 0, 1, None, y) for y in ("Y1", "Y1", "Y2", "Y2")]], CELL)
    got = T.apply_edits(cells, edits, aligned=aligned)
    assert got.columns == cells.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_facts_and_answers_move_one_row_a_task(spark, sf):
    assert shuffles(T.to_facts(driver.cells(spark, sf))) == 0
    assert shuffles(P.q_facts_to_answers(spark, sf)) <= 2  # the totals and the rules, not the cells


def test_row_labels_match_within_whole_keys(spark):
    cells = spark.createDataFrame([
        ("a", 1, 0, 0, 0, "item", "CO2 (kg)"), ("a", 1, 0, 0, 0, "item", "again"), ("a", 1, 0, 0, 1, "2021", "1,200"), ("a", 1, 0, 0, 2, "Unit", "t"),
        (None, 1, 0, 0, 0, "item", "lost"), (None, 1, 0, 0, 1, "2021", "(5)"), ("a", 1, 0, 1, 1, "2021", "<3")], CELL)
    got = sorted(((r.source or "", r.row_idx, r.row_label or "", r.unit, r.value) for r in T.to_facts(cells).collect()), key=repr)
    assert got == sorted([("a", 0, "CO2 (kg)", "t", 1200.0), ("a", 0, "again", "t", 1200.0), ("", 0, "", None, -5.0), ("a", 1, "", None, None)], key=repr)


def test_tables_of_null_keys(spark):
    cells = spark.createDataFrame([(s, 1, 0, 0, c, h, "x") for s in ("a", None) for c, h in ((0, "H"), (1, "H"))], CELL)
    assert {r.source: r.csv for r in T.render_csv(cells).collect()} == {"a": "H;H\nx;x", None: "x;x"}
    assert sorted((r.source or "", r.preview) for r in T.table_preview(cells).collect()) == [("", "H;H"), ("", "x;x"), ("a", "H;H\nx;x")]
    assert {r.source for r in T.repair_table(cells).collect()} == {"a"}
    assert {(r.source, r.col_idx): r.header for r in T.unique_headers(cells).collect()} == {("a", 0): "H", ("a", 1): "H_1", (None, 0): None, (None, 1): None}


def test_preview_of_a_long_table(spark):
    cells = spark.createDataFrame([("a", 1, 0, r, 0, "h" if r < 40 else "z", str(r)) for r in range(50)] + [("b", 1, 0, 40, 0, None, "late")], CELL)
    got = {r.source: r.preview for r in T.table_preview(cells, n=4).collect()}
    assert got == {"a": "z\n0\n1\n2"}


def test_parsed_numbers_and_a_filter_on_them(spark):
    df = with_parsed_number(spark.createDataFrame([("12",), ("1-2",), ("n/a",), (None,), ("(3 %)",), (">=4,5",), ("~6",), ("x",)], "t string"), "t")
    got = {r.t: (r.lo, r.hi, r.op, r.is_pct) for r in df.collect()}
    assert got == {"12": (12.0, 12.0, "=", False), "1-2": (1.0, 2.0, "range", False), "n/a": (None, None, None, False), None: (None, None, None, False),
                   "(3 %)": (-3.0, -3.0, "=", True), ">=4,5": (4.5, None, ">=", False), "~6": (6.0, 6.0, "=", False), "x": (None, None, None, False)}
    assert {r.t for r in df.where("lo > 2").collect()} == {"12", ">=4,5", "~6"}


def test_noise_and_fences(spark):
    cells = spark.createDataFrame([(x,) for x in ("*1 §2|", "``a`b``", "`c`\n", None, " ■ ")], "cell string")
    assert [r.cell for r in T.clean_cells(cells).collect()] == ["1 2", "a`b", "c\n", None, ""]


def test_answers_in_one_pass(spark):
    f = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", None)], "company string, value double")
    got = {r.company: (r.total, r.highest) for r in Q.q_together(f, ["company"], total="sum", highest="max").collect()}
    assert got == {"a": (5.0, 4.0), "b": (None, None)}

"""Repeated keys, null texts and malformed rows have a defined result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tabloom.operators import context as X
from tabloom.operators import quant as Q
from tabloom.operators import tables as T
from tabloom.sources import files

CELLS = "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string"


def test_malformed_rows_raise_when_asked(spark, tmp_path):
    folder = tmp_path / "ACME"
    folder.mkdir()
    (folder / "1_0.csv").write_text("a;b\n1;2\n3;4;5\n")
    (folder / "1_1.csv").write_text("a;b\n1;2\n")
    assert files.read_tables(spark, str(tmp_path)).count() == 7
    assert files.read_tables(spark, str(tmp_path), on_bad="drop").count() == 4
    with pytest.raises(Exception, match="malformed table row"):
        files.read_tables(spark, str(tmp_path), on_bad="error").count()
    with pytest.raises(Exception, match="malformed table row"):
        files.read_tables(spark, str(tmp_path), on_bad="error").select("source").collect()
    (folder / "1_0.csv").unlink()
    assert files.read_tables(spark, str(tmp_path), on_bad="error").count() == 2


def test_repeated_cell_positions_keep_the_greatest(spark):
    cells = spark.createDataFrame([("s", 1, 0, 0, 0, "h", "a"), ("s", 1, 0, 0, 0, "h", "b"), ("s", 1, 0, 0, 0, "h", None),
                                   ("s", 1, 0, 0, 1, "k", "x"), ("s", 1, 0, 1, 0, "h", "y")], CELLS)
    got = {(r.row_idx, r.col_idx): r.cell for r in T.repair_table(cells).collect()}
    assert got == {(0, 0): "b", (0, 1): "x", (1, 0): "y", (1, 1): T.MISSING_CELL}
    assert T.repair_table(cells.where("cell is null")).first().cell == T.MISSING_CELL


def test_repeated_table_numbers_keep_the_greatest(spark):
    pages = spark.createDataFrame([("s", 1, "a [TABLEPLACEHOLDER 0] b [TABLEPLACEHOLDER 2]")], "source string, page int, text string")
    texts = spark.createDataFrame([("s", 1, 0, "one"), ("s", 1, 0, "two")], "source string, page int, table_no int, table_text string")
    assert X.fill_placeholders(pages, texts).first().text == "a \n[Table from page 1, num 0]\ntwo b "
    marks = spark.createDataFrame([("s", "<Table1> <Table2>")], "source string, text string")
    html = spark.createDataFrame([("s", 1, "<b>"), ("s", 1, "<a>")], "source string, j int, html string")
    assert X.insert_tables(marks, html).first().text == "<b> <Table2>"


def test_null_texts_are_empty_blocks_and_turns(spark):
    pages = spark.createDataFrame([("s", 1, None), ("s", 2, "two")], "source string, page int, text string")
    order = spark.createDataFrame([(7, "s", 1, 1), (7, "s", 2, 2)], "query_id int, source string, page int, ordinal int")
    for form in ("document", "sector"):
        text = X.build_context(pages, order, form=form).first().context
        assert "# Page 1\n\n\n---" in text and text.index("# Page 1") < text.index("two")
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, None, "x")], "conv_id long, turn long, role string, text string")
    assert X.render_conversation(conv).first().transcript == "user: q\nassistant: \n: x"


def test_one_rule_per_unit(spark):
    facts = spark.createDataFrame([("t", 2.0), ("kg", 5.0), ("lb", 1.0)], "unit string, value double")
    rules = spark.createDataFrame([("kg", "t", 0.001), ("kg", "t", 0.001), ("kg", "g", 1000.0)], "unit string, target string, factor double")
    got = sorted((r.status, r.unit, r.value or 0.0) for r in Q.normalize_units(facts, rules, "t").collect())
    assert got == [("no_rule", "lb", 0.0), ("ok", "t", 0.005), ("ok", "t", 2.0)]
    two = rules.unionByName(spark.createDataFrame([("kg", "t", 0.002)], rules.schema))
    with pytest.raises(Exception, match="several factors for unit kg"):
        Q.normalize_units(facts, two, "t").collect()
    assert Q.normalize_units(facts, rules.withColumn("factor", F.lit(None).cast("double")), "t").count() == 3

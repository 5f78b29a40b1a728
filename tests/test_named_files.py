"""Pages and tables written under the names that the readers expect."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabloom.sinks import named_files, writers
from tabloom.sources import files

CELLS = "source string, page int, table_no int, row_idx int, col_idx int, header string, cell string"
PAGES = "source string, page int, text string"
NAMES = ["plain", "a b+c", "100% ü", "x=y&z"]


def _tmp():
    return tempfile.mkdtemp(prefix="tabloom-named-")


def _listing(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))


def test_tables_come_back_whole(spark):
    data = [(s, p, n, r, c, f"h{c}", f"{s};\"{r}\"\n{c}") for s in NAMES for p in (1, 22) for n in (0, 3) for r in range(4) for c in range(2)]
    cells = spark.createDataFrame(data, CELLS)
    root = _tmp() + "/t"
    writers.write_tables(cells, root)
    assert _listing(root) == sorted([f"{s}/{p}_{n}.csv" for s in NAMES for p in (1, 22) for n in (0, 3)] + ["_SUCCESS"])
    back = files.read_tables(spark, root, on_bad="error").select(cells.columns)
    assert sorted(map(tuple, back.collect())) == sorted(data)


def test_pages_come_back_whole(spark):
    texts = ["one\nline", "", " \r\n日本 é", "x" * 300_000, None]
    data = [(s, i, t) for s in NAMES for i, t in enumerate(texts)]
    root = _tmp() + "/p"
    writers.write_pages(spark.createDataFrame(data, PAGES), root)
    want = {(s, i): t or "" for s, i, t in data}
    got = {(r.source, r.page): r.text for r in files.read_pages(spark, root).collect()}
    assert {k: got.get(k, "") for k in want} == want and set(got) <= set(want)
    assert all(os.path.exists(f"{root}/{s}/{i}.txt") for s, i in want)


def test_modes_and_repeated_pages(spark):
    root = _tmp() + "/p"
    writers.write_pages(spark.createDataFrame([("a", 1, "y"), ("a", 1, "x"), ("b", 1, "old")], PAGES), root)
    writers.write_pages(spark.createDataFrame([("b", 1, "new"), ("c", 1, "z")], PAGES), root, mode="append")
    assert {(r.source, r.text) for r in files.read_pages(spark, root).collect()} == {("a", "xy"), ("b", "new"), ("c", "z")}
    writers.write_pages(spark.createDataFrame([("d", 1, "z")], PAGES), root)
    assert _listing(root) == ["_SUCCESS", "d/1.txt"]
    writers.write_pages(spark.createDataFrame([], PAGES), root)
    assert _listing(root) == ["_SUCCESS"]
    with pytest.raises(ValueError):
        writers.write_pages(spark.createDataFrame([], PAGES), root, mode="ignore")


@pytest.mark.parametrize("source", [None, "", "../x", "a/b", ".hidden", "_hidden"])
def test_names_that_are_no_folder_end_the_job(spark, source):
    root = _tmp() + "/p"
    with pytest.raises(Exception, match="not a folder name"):
        writers.write_pages(spark.createDataFrame([(source, 1, "x")], PAGES), root)


def test_a_failed_task_leaves_no_half_file(spark):
    root = _tmp() + "/p"
    rows = spark.range(40_000, numPartitions=1).select(
        F.lit("s/1.txt").alias("file"), F.col("id").alias("line_no"),
        F.when(F.col("id") == 39_999, F.raise_error(F.lit("lost")).cast("string")).otherwise("some text\n").alias("piece"))
    rows.sparkSession.dataSource.register(named_files.NamedFiles)
    with pytest.raises(Exception, match="lost"):
        rows.select("file", "piece").write.format(named_files.FORMAT).mode("append").save(root)
    assert "s/1.txt" not in _listing(root) and "_SUCCESS" not in _listing(root)


def test_sector_folders(spark):
    pages = spark.createDataFrame([("d", 1, "t1"), ("d", 2, "t2"), ("e", 1, "t3")], PAGES)
    cells = spark.createDataFrame([("d", 1, 0, 0, 0, "k", "x"), ("d", 2, 0, 0, 0, "k", "y")], CELLS)
    hits = spark.createDataFrame([("oil", "d", 1), ("oil", "d", 1), ("gas", "d", 1), ("gas", "e", 1), ("gas", "f", 9)], "sector string, source string, page int")
    root = _tmp() + "/s"
    writers.export_sector(pages, cells, hits, root)
    assert _listing(root) == ["_SUCCESS", "gas/d/1.txt", "gas/d/1_0.csv", "oil/d/1.txt", "oil/d/1_0.csv"]

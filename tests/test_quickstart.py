"""End to end on a tiny on-disk dataset, following README's quick start."""

import os
import tempfile

from pyspark.sql import functions as F

from tabloom.operators import context as X
from tabloom.operators import link as L
from tabloom.operators import retrieve as R
from tabloom.operators import tables as T
from tabloom.sources import files


def _w(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_quickstart_flow(spark):
    root = tempfile.mkdtemp(prefix="tabloom-qs-")
    ds = f"{root}/table_dataset"
    _w(f"{ds}/eni/60.txt", "Energy consumption within the organization\n[TABLEPLACEHOLDER 0]\n")
    _w(f"{ds}/eni/60_0.csv", "Indicator;Units;2023;2022\nEnergy consumption;GJ;10,291;9,870\nFuel;GJ;(5);UP\n")
    _w(f"{ds}/eni/61.txt", "Water withdrawal by source\n[TABLEPLACEHOLDER 0]\n")
    _w(f"{ds}/eni/61_0.csv", "Indicator;Units;2023\nWater withdrawal;ML;1,200\n")
    _w(f"{root}/codes.json", '{"302-1": "Energy consumption within the organization", "303-3": "Water withdrawal"}')

    cells = files.read_tables(spark, ds)
    pages = files.read_pages(spark, ds)
    codes = files.read_codes(spark, f"{root}/codes.json")

    chunks = pages.withColumnRenamed("text", "content")
    model = R.tfidf_fit(chunks, ["source"], ["page"]).checkpoint()
    hits = R.sparse_topk(codes.selectExpr("code AS query_id", "description AS text"), model, k=1)
    refs = L.link_codes(codes, hits.withColumnRenamed("query_id", "code"), cells.select("source", "page", "table_no"))
    got = {(r.code, r.page) for r in refs.collect()}
    assert got == {("302-1", 60), ("303-3", 61)}

    verdicts = refs.select("source", "code", "page", "table_no", F.lit("YES").alias("verdict"))
    kept = L.prune_refs(refs, verdicts, cells)
    docs = cells.select("source", F.lit("Eni").alias("company_name")).distinct()
    report = X.findings_report(codes, kept, docs).collect()[0].report
    assert "GRI 302-1" in report and "60_0.csv" in report and "pag.61" in report

    facts = T.to_facts(T.repair_table(cells.drop("n_fields", "width")))
    f = {(r.row_label, r.year): r.value for r in facts.collect()}
    assert f[("Energy consumption", 2023)] == 10291.0 and f[("Fuel", 2023)] == -5.0 and f[("Fuel", 2022)] is None

"""Catalog listings and store scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.filters import any_sector, sectors_overlap

CHUNK_SCAN_COLS = ("source", "page", "content", "model_name", "company_name", "company_sectors")


def list_titles(store: DataFrame) -> DataFrame:
    """G1: distinct document titles (sorted on output by the caller)."""
    return store.select("title").where(F.col("title").isNotNull()).distinct()


def list_sectors(store: DataFrame, col: str = "company_sectors") -> DataFrame:
    """Distinct sectors; null arrays and null/empty values dropped."""
    s = store.where(F.col(col).isNotNull()).select(F.explode(col).alias("sector"))
    return s.where(F.col("sector").isNotNull() & (F.length("sector") > 0)).distinct()


def titles_in_sectors(store: DataFrame, sectors) -> DataFrame:
    """Titles of documents in any selected sector; no selection -> all titles."""
    return list_titles(any_sector(store, sectors))


def chunks_by_source(store: DataFrame, source: str, cols=CHUNK_SCAN_COLS) -> DataFrame:
    """One document's chunks, projected (filter and columns reach the scan)."""
    return store.where(F.col("source") == F.lit(source)).select(*cols)


def chunks_by_sectors(store: DataFrame, sectors, cols=CHUNK_SCAN_COLS) -> DataFrame:
    """Chunks whose sectors overlap the selection."""
    return any_sector(store, sectors).select(*cols)


def vectors_by_sectors(vecs: DataFrame, sectors, meta_col: str = "cmetadata") -> DataFrame:
    """Vectors whose JSON metadata lists any selected sector.

    The sector list is read with ``get_json_object`` + ``from_json`` so rows
    with other metadata keys pass through untouched.
    """
    sect = F.from_json(F.get_json_object(F.col(meta_col), "$.company_sectors"), "array<string>")
    v = vecs.withColumn("_sect", sect)
    return v.where(F.col("_sect").isNotNull() & sectors_overlap("_sect", sectors)).drop("_sect")


def list_table_sets(cells: DataFrame) -> DataFrame:
    """The table folders (documents) that hold tables."""
    return cells.select("source").distinct()


def list_tables(cells: DataFrame) -> DataFrame:
    """Per document its tables as ``page_table`` names, sorted; first is the default."""
    names = cells.select("source", F.struct("page", "table_no").alias("t")).distinct()
    agg = names.groupBy("source").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return agg.select("source", F.transform("ts", lambda t: F.concat_ws("_", t["page"].cast("string"),
                                                                        t["table_no"].cast("string")))
                      .alias("tables")).withColumn("default_table", F.col("tables")[0])


def with_summaries(companies: DataFrame, summaries: DataFrame, key: str = "company_name") -> DataFrame:
    """Attach a summary per company; a missing one is the empty string."""
    s = summaries.select(key, F.col("summary").alias("_summary"))
    return companies.join(s, key, "left").withColumn("summary", F.coalesce("_summary", F.lit(""))).drop("_summary")


def table_count(cells: DataFrame, by=("sector",)) -> DataFrame:
    """Number of distinct tables per group."""
    t = cells.select(*by, "source", "page", "table_no").distinct()
    return t.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tables"))

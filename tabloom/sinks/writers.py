"""Sinks (K1-K8): set-based writes of tables, pages, reference maps, stores, metrics.

Writers never loop over rows on the driver: every output is one DataFrame
write.  Tables and pages get the file names that the readers expect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.tables import csv_lines
from tabloom.sinks.named_files import filesystem, folder_name, number_name, write_named


def _table_rows(cells: DataFrame, sep: str) -> DataFrame:
    name = F.concat(folder_name(F.col("source")), F.lit("/"), number_name(F.col("page")), F.lit("_"), number_name(F.col("table_no")), F.lit(".csv"))
    return csv_lines(cells, sep=sep).select("source", "page", name.alias("file"), F.concat("line", F.lit("\n")).alias("piece"), "line_no")


def _page_rows(pages: DataFrame) -> DataFrame:
    name = F.concat(folder_name(F.col("source")), F.lit("/"), number_name(F.col("page")), F.lit(".txt"))
    return pages.select("source", "page", name.alias("file"), F.col("text").alias("piece"), F.lit(0).alias("line_no"))


def write_tables(cells: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    """K1: one ``{source}/{page}_{table_no}.csv`` per table, as ``read_tables`` reads it.

    Lines are streamed in order (header first) by a sort within partitions,
    never collected into one value, so a table of any size is written by
    the task that holds it without building it in memory.
    """
    write_named(_table_rows(cells, sep), path, ["line_no"], mode)


def write_pages(pages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: one ``{source}/{page}.txt`` per page, as ``read_pages`` reads it; texts of a repeated page are joined in text order."""
    write_named(_page_rows(pages), path, ["line_no", "piece"], mode)


def refs_json(refs: DataFrame) -> DataFrame:
    """K3: per document the JSON map code -> [[page, table_no], ...] in ordinal order."""
    r = refs.where(F.col("page").isNotNull())
    per_code = r.groupBy("source", "code").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", F.array(F.col("page").cast("int"),
                                                                F.col("table_no").cast("int")).alias("p"))))
        .alias("_l"))
    per_code = per_code.select("source", "code", F.transform("_l", lambda x: x["p"]).alias("pairs"))
    return per_code.groupBy("source").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "pairs"))))).alias("json"))


def write_refs(refs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: write the reference map of every document (one JSON text per source folder)."""
    refs_json(refs).write.mode(mode).partitionBy("source").text(path)


def _append(rows: DataFrame, store_path: str, partition_by) -> None:
    if partition_by:
        rows = rows.hint("rebalance", *partition_by)
    w = rows.sortWithinPartitions(*(partition_by or []), "source", "page").write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(store_path)


def append_chunks(new: DataFrame, store_path: str, partition_by=None) -> None:
    """K4: append new chunks to the sparse store with a load timestamp.

    Rows are clustered by source inside files so scans by source skip row
    groups through Parquet statistics; ``partition_by`` adds folder pruning
    when the key has modest cardinality.  Rows are dealt by that key first, so
    a folder gets a file or few and not one of every task; a rebalance, so a
    folder that holds much of the load is split over several tasks.
    """
    _append(new.withColumn("created_at", F.current_timestamp()), store_path, partition_by)


def append_vectors(new: DataFrame, store_path: str, partition_by=None) -> None:
    """K5: append vectors to the dense store, dealt as :func:`append_chunks` deals chunks."""
    _append(new, store_path, partition_by)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: predictions or metrics as CSV with a header, in as many files as the relation has partitions."""
    df.write.mode(mode).option("header", True).csv(path)


def export_sector(pages: DataFrame, cells: DataFrame, hits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K8: the hit pages and their tables below one folder per sector: ``{sector}/{source}/{page}.txt`` and
    ``{sector}/{source}/{page}_{n}.csv``.

    ``hits(sector, source, page)``; pages/tables outside the hits are not copied, nor are hit pages
    that lack a text or a table.
    """
    key = ["source", "page"]
    h = hits.select("sector", *key).distinct().join(pages, key, "left_semi").join(cells, key, "left_semi")
    t = _table_rows(cells.join(h, key, "left_semi"), ";")
    rows = _page_rows(pages).unionByName(t).join(h, key)
    file = F.concat(folder_name(F.col("sector")), F.lit("/"), F.col("file"))
    write_named(rows.withColumn("file", file), path, ["line_no", "piece"], mode)


def delete_from_store(spark, store_path: str, ids: DataFrame, staging_path: str) -> int:
    """I8 on a bucket-partitioned store: rewrite only the buckets that hold the ids.

    The surviving rows of the touched buckets are staged under
    ``staging_path`` (shared storage, e.g. below ``spark.checkpoint.dir``) and
    written back with dynamic partition overwrite, so untouched buckets keep
    their files; buckets left empty are removed, the staged rows last.  A
    delete that was interrupted once its rows were staged is finished by the
    next call with the same ``staging_path``, before that call's own work.
    Returns the number of buckets rewritten for ``ids``.  The driver only sees
    bucket numbers (at most the store's bucket count).
    """
    from pyarrow.fs import FileSelector

    from tabloom.plans.sizing import broadcast_if_bounded

    system, staging = filesystem(staging_path)
    if system.get_file_info(f"{staging}/touched/_SUCCESS").is_file:
        _write_back(spark, store_path, staging_path)
        if not any(i.base_name.startswith("bucket=") for i in system.get_file_info(FileSelector(filesystem(store_path)[1]))):
            return 0
    store = spark.read.parquet(store_path)
    keys = broadcast_if_bounded(ids.select("chunk_id").distinct())
    touched = [r["bucket"] for r in store.join(keys, "chunk_id", "left_semi").select("bucket").distinct().collect()]
    if not touched:
        return 0
    keep = store.where(F.col("bucket").isin(touched)).join(keys, "chunk_id", "left_anti")
    keep.write.mode("overwrite").partitionBy("bucket").parquet(f"{staging_path}/rows")
    # Written last: from here on the staged rows are complete.
    spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{staging_path}/touched")
    _write_back(spark, store_path, staging_path)
    return len(touched)


def _write_back(spark, store_path: str, staging_path: str) -> None:
    """Replace the touched buckets by the staged rows; repeating it gives the same store."""
    from pyarrow.fs import FileSelector, FileType

    system, store = filesystem(store_path)
    _, staging = filesystem(staging_path)
    touched = {r["bucket"] for r in spark.read.parquet(f"{staging_path}/touched").collect()}
    kept = {int(i.base_name.partition("=")[2]) for i in system.get_file_info(FileSelector(f"{staging}/rows")) if i.base_name.startswith("bucket=")}
    if kept:
        staged = spark.read.parquet(f"{staging_path}/rows")
        (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(store_path))
    for b in touched - kept:
        if system.get_file_info(f"{store}/bucket={b}").type != FileType.NotFound:
            system.delete_dir(f"{store}/bucket={b}")
    system.delete_dir(staging)

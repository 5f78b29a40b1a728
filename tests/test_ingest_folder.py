"""Streamed ingest of documents stored as one file or as a folder of part files."""

from __future__ import annotations

import pytest

from tabloom.plans import registry

DOCS = [(0, "first text", "en", "s0", 10), (1, "second text", "fr", "s1", 11), (2, None, "en", "s1", 0), (3, "second text", "fr", "s1", 11)]


def _write(spark, at, as_folder):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (2, [0.5, 1.0]), (3, None)], "vec_id long, embedding array<float>")
    for name, rows in (("documents", docs), ("labels", labels), ("embeddings", vectors)):
        if as_folder:
            rows.repartition(3).write.parquet(f"{at}/{name}.parquet")
        else:
            rows.toPandas().to_parquet(f"{at}/{name}.parquet")


@pytest.mark.parametrize("as_folder", [False, True])
def test_streamed_ingest_reads_a_file_or_a_folder(spark, tmp_path, as_folder):
    _write(spark, tmp_path, as_folder)
    run = lambda name: registry.queries()[name](spark, str(tmp_path)).collect()
    assert sorted(r.page for r in run("ingest_stream_store")) == [0, 1, 2, 3]
    assert sorted((r.store, r.page) for r in run("ingest_both_stores")) == [
        ("chunks", 0), ("chunks", 1), ("chunks", 2), ("chunks", 3), ("vectors", 0), ("vectors", 2)]

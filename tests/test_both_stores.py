"""One load of the sparse and the dense store; interrupted loads and deletes."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tabloom.operators import ingest
from tabloom.sinks import writers
from tabloom.streaming import ingest_stream as S

SCHEMA = "source string, page int, content string, embedding array<float>"


def _root():
    return tempfile.mkdtemp(prefix="tabloom-both-")


def _chunks(batch):
    b = batch.withColumns({"model_name": F.lit("m"), "company_name": F.col("source"), "company_sectors": F.array(F.lit("x"))})
    return ingest.with_chunk_id(b).select("chunk_id", "source", "page", "content")


def _vectors(batch):
    return _chunks(batch).join(batch.select("source", "page", "embedding").distinct(), ["source", "page"])


def _feed(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def _run(spark, root):
    schema = spark.read.parquet(f"{root}/in").schema
    S.ingest_both_stream(spark, f"{root}/in", schema, f"{root}/c", f"{root}/v", f"{root}/ckpt", _chunks, _vectors).awaitTermination()


def _held(spark, path):
    return sorted((r.source, r.page) for r in spark.read.parquet(path).collect())


def test_a_batch_that_fails_between_the_writes_is_completed(spark, monkeypatch):
    root = _root()
    _feed(spark, root, [("a", 1, "one", [1.0]), ("a", 2, "two", [2.0]), ("a", 2, "two", [2.0]), ("b", 1, "three", None)])
    monkeypatch.setattr(S, "append_vectors", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(Exception, match="lost driver"):
        _run(spark, root)
    assert _held(spark, f"{root}/c") == [("a", 1), ("a", 2), ("b", 1)] and not os.path.exists(f"{root}/v")
    monkeypatch.undo()
    _run(spark, root)
    _feed(spark, root, [("a", 2, "two", [2.0]), ("c", 1, "four", [4.0])])
    _run(spark, root)
    assert _held(spark, f"{root}/c") == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]
    assert _held(spark, f"{root}/v") == [("a", 1), ("a", 2), ("c", 1)]
    gaps = S.store_gaps(spark.read.parquet(f"{root}/c"), spark.read.parquet(f"{root}/v")).collect()
    assert [(r.source, r.page, r.missing) for r in gaps] == [("b", 1, "vectors")]


def test_gaps_both_ways_and_of_empty_stores(spark):
    df = spark.createDataFrame([(f"i{i}", "s", i) for i in range(6)], "chunk_id string, source string, page int")
    left, right = df.where("page < 4").unionByName(df.where("page = 0")), df.where("page > 1")
    got = sorted((r.chunk_id, r.missing) for r in S.store_gaps(left, right).collect())
    assert got == [("i0", "vectors"), ("i1", "vectors"), ("i4", "chunks"), ("i5", "chunks")]
    assert S.store_gaps(left.where("false"), right.where("false")).count() == 0


def test_an_interrupted_delete_is_finished(spark, monkeypatch):
    rows = [(f"id{i}", f"s{i % 7}", i) for i in range(70)]
    chunks = ingest.with_store_bucket(spark.createDataFrame(rows, "chunk_id string, source string, page int"), n=16)
    root = _root()
    writers.append_chunks(chunks, f"{root}/store", partition_by=["bucket"])
    whole = {r.bucket for r in chunks.where("source = 's1'").collect()}
    doomed = chunks.where(F.col("bucket").isin(list(whole)) | F.col("chunk_id").isin("id0", "id3")).select("chunk_id")
    gone = {r.chunk_id for r in doomed.collect()}
    monkeypatch.setattr(writers, "_write_back", lambda *a: (_ for _ in ()).throw(RuntimeError("lost driver")))
    with pytest.raises(RuntimeError):
        writers.delete_from_store(spark, f"{root}/store", doomed, f"{root}/stage")
    monkeypatch.undo()
    # The lost run had removed a touched bucket and not yet put its kept rows back.
    hit = chunks.where("chunk_id = 'id0'").first().bucket
    if hit not in whole:
        from pyarrow import fs
        fs.LocalFileSystem().delete_dir(f"{root}/store/bucket={hit}")
    assert writers.delete_from_store(spark, f"{root}/store", doomed, f"{root}/stage") == 0
    left = {r.chunk_id for r in spark.read.parquet(f"{root}/store").collect()}
    assert left == {r[0] for r in rows} - gone and not os.path.exists(f"{root}/stage")

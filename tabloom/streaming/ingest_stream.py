"""Incremental ingest as a Structured Streaming job.

New chunk files arriving in a folder are mapped to chunks, given content
ids, checked against the store (anti join) and appended.  The stream keeps
its progress in a checkpoint on shared storage, and the content-id anti join
makes every micro-batch idempotent: a batch replayed after an executor or
driver failure appends nothing twice.  One stream can feed the sparse and the
dense store (:func:`ingest_both_stream`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from tabloom.operators.ingest import split_new, with_store_bucket
from tabloom.sinks.writers import append_chunks, append_vectors


def _store_or_empty(spark: SparkSession, store_path: str, like: DataFrame) -> DataFrame:
    schema = like.select("bucket", "chunk_id").schema
    try:
        return spark.read.schema(schema).parquet(store_path)
    except AnalysisException as e:  # nothing was loaded yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def _load(spark: SparkSession, rows: DataFrame, store_path: str, append) -> None:
    """Append the rows whose ids the store lacks."""
    rows = with_store_bucket(rows)
    new, _ = split_new(rows, _store_or_empty(spark, store_path, rows), keys=("bucket", "chunk_id"))
    append(new, store_path, partition_by=["bucket"])


def _reader(spark: SparkSession, schema, glob: str | None, max_files_per_trigger: int | None):
    reader = spark.readStream.schema(schema).format("parquet")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader


def _start(raw: DataFrame, load_batch, checkpoint_path: str, available_now: bool):
    writer = raw.writeStream.foreachBatch(load_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()


def ingest_stream(spark: SparkSession, source_path: str, schema, store_path: str, checkpoint_path: str,
                  to_chunks: Callable[[DataFrame], DataFrame], glob: str | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the ingest stream; with ``available_now`` it drains the folder and stops.

    ``to_chunks`` maps a micro-batch of raw rows to chunk rows that carry
    ``chunk_id, source, page`` (and any other store columns).  The store is
    partitioned by a hash bucket of the source, and each batch probes only
    the buckets it touches (``split_new`` with dynamic partition pruning).
    """
    raw = _reader(spark, schema, glob, max_files_per_trigger).load(source_path)

    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        _load(spark, to_chunks(batch), store_path, append_chunks)

    return _start(raw, load_batch, checkpoint_path, available_now)


def ingest_both_stream(spark: SparkSession, source_path: str, schema, chunk_store: str, vector_store: str, checkpoint_path: str,
                       to_chunks: Callable[[DataFrame], DataFrame], to_vectors: Callable[[DataFrame], DataFrame],
                       glob: str | None = None, available_now: bool = True, max_files_per_trigger: int | None = None):
    """I7 with K4 and K5: one stream that loads the sparse and the dense store.

    ``to_chunks`` and ``to_vectors`` map the same micro-batch to rows with
    ``chunk_id, source, page``; hybrid retrieval needs both stores.  Each write
    stands behind its own store's ids, so a batch that failed between the two
    and is replayed adds to each store what that one lacks and nothing twice.
    Rows with a null id are not stored; a null embedding gives no vector.
    """
    raw = _reader(spark, schema, glob, max_files_per_trigger).load(source_path)

    def load_batch(batch: DataFrame, epoch_id: int) -> None:
        _load(spark, to_chunks(batch).where("chunk_id IS NOT NULL"), chunk_store, append_chunks)
        _load(spark, to_vectors(batch).where("chunk_id IS NOT NULL AND embedding IS NOT NULL"), vector_store, append_vectors)

    return _start(raw, load_batch, checkpoint_path, available_now)


def store_gaps(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(chunk_id, source, page, missing) of every id that only one of the two stores holds.

    ``missing`` is ``vectors`` or ``chunks``.  Both sides are grouped by id with partial aggregation, so a
    hot source is no hot key and an id that a store repeats counts once.
    """
    def tagged(df: DataFrame, store: str) -> DataFrame:
        return df.select("chunk_id", "source", "page", *(F.lit(int(store == s)).alias(s) for s in ("chunks", "vectors")))

    held = tagged(chunks, "chunks").unionByName(tagged(vectors, "vectors")).groupBy("chunk_id", "source", "page").agg(
        F.max("chunks").alias("c"), F.max("vectors").alias("v"))
    return held.where("c <> v").select("chunk_id", "source", "page", F.when(F.col("c") == 1, "vectors").otherwise("chunks").alias("missing"))

"""Derived tables stored once per corpus version below the shared checkpoint folder.

The reference refits TF-IDF for every question.  Here the fit, like the cells
that production would extract at ingest, is a table keyed by the input files it
was built from (path, size, modification time) and by the source of the code
that builds it, so it is built again exactly when either changes.

A build writes into a folder of its own below the key and is complete once
Spark's writer has committed its last table (``_SUCCESS``).  Readers take the
first complete build; nothing is renamed, so object stores are safe, a lost
build is never read, and two jobs that race only write the same rows twice.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.functions.text import TOKEN_PATTERN
from tabloom.operators.retrieve import TfidfModel, _idf, _weigh, tfidf_counts, tfidf_store
from tabloom.session import checkpoint_dir


def code_version(*functions) -> str:
    """Changes whenever the source of one of the functions does."""
    return hashlib.sha256("\n".join(inspect.getsource(f) for f in functions).encode()).hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, paths) -> str:
    """Hash of (path, size, modification time) of every file below the inputs."""
    seen = []
    for path in paths:
        p, fs = _fs(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            st = files.next()
            seen.append(f"{st.getPath().toString()}|{st.getLen()}|{st.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def _stored(spark: SparkSession, kind: str, name: str, inputs, version: str, last: str,
            write: Callable[[str], None]) -> str:
    """Folder of a complete build; ``write(folder)`` makes one, its table ``last`` at the end."""
    key = hashlib.sha256(f"{name}|{fingerprint(spark, inputs)}|{version}".encode()).hexdigest()[:24]
    base = f"{checkpoint_dir(spark).rstrip('/')}/{kind}/{name}-{key}"

    def complete() -> list[str]:
        p, fs = _fs(spark, f"{base}/*/{last}/_SUCCESS")
        return sorted(st.getPath().getParent().getParent().toString() for st in fs.globStatus(p) or ())

    if not complete():
        write(f"{base}/{uuid.uuid4().hex}")
    return complete()[0]


def stored_tfidf(spark: SparkSession, name: str, inputs, build_chunks: Callable[[], DataFrame],
                 group_cols, key_cols, text_col: str = "content", version: str = "") -> TfidfModel:
    """Load the index for (name, inputs, grouping) or fit and store it first.

    ``version`` covers the code behind ``build_chunks`` (see :func:`code_version`).
    """
    full = f"{list(group_cols)}|{list(key_cols)}|{text_col}|{code_version(tfidf_counts, _idf, _weigh, tfidf_store)}|{TOKEN_PATTERN}|{version}"
    path = _stored(spark, "indexes", name, inputs, full, "docs",
                   lambda at: tfidf_store(build_chunks(), at, group_cols, key_cols, text_col))
    return TfidfModel.load(spark, path, group_cols, key_cols)


def input_bytes(spark: SparkSession, paths) -> int:
    """Size of the files below the inputs."""
    return sum(fs.getContentSummary(p).getLength() for p, fs in (_fs(spark, path) for path in paths))


def stored_frame(spark: SparkSession, name: str, inputs, build: Callable[[], DataFrame], version: str, by: list[str],
                 buckets: int) -> DataFrame:
    """A derived table stored once per (inputs, version), in buckets of the columns ``by``.

    ``build()`` is best partitioned by them into as many parts.  Spark knows buckets by a table's
    definition, so each session defines an external one, which has no data of its own, over the files.
    """
    def write(at: str) -> None:
        made = f"{name}_{uuid.uuid4().hex}"
        build().write.bucketBy(buckets, *by).option("compression", "zstd").option("path", f"{at}/rows").saveAsTable(made)
        spark.sql(f"DROP TABLE {made}")

    path = _stored(spark, "tables", name, inputs, f"{version}|{by}|{buckets}", "rows", write) + "/rows"
    table = f"{name}_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    if not spark.catalog.tableExists(table):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({cols}) USING parquet CLUSTERED BY ({', '.join(by)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)

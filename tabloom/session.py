"""SparkSession construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the engine relies on. They are only *defaults*: a
# cluster submission that already sets a key keeps its own value.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Target size of a post-shuffle partition after AQE coalescing/splitting.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A partition 5x the median and over 256 MB is split (hot terms, hot sources).
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "tabloom",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the engine defaults.

    ``master`` is only set when given, so ``spark-submit`` decides on a
    cluster.  ``shuffle_partitions`` should be sized to the data (about
    128-256 MB per shuffle partition); AQE coalesces small ones at runtime.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    from pyspark import SparkConf
    submitted = SparkConf()  # holds what spark-submit / spark-defaults already set
    for key, value in DEFAULT_CONF.items():
        if not submitted.contains(key):
            builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is.
    Only when it is unset (local tests) a scratch folder is created and
    registered, so ``DataFrame.checkpoint()`` can cut lineage reliably.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        # The context may already have one (setCheckpointDir adds a run folder
        # below the configured path; its parent is the shared folder).
        ctx_dir = spark.sparkContext.getCheckpointDir()
        current = ctx_dir.rsplit("/", 1)[0] if ctx_dir else None
    if not current:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tabloom-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # a read-only runtime setting: the context path below still applies
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{os.getpid()}"


def shuffle_partitions_for(input_bytes: int, blowup: float = 3.0, target_bytes: int = 128 << 20,
                           minimum: int = 200) -> int:
    """Shuffle partitions for a job reading ``input_bytes``.

    ``blowup`` is the largest shuffle volume relative to the input (the
    tokenised (doc, term, count) rows of the TF-IDF fit are about 3x the
    compressed text); partitions target ``target_bytes`` so each fits in
    executor memory without spilling, and AQE coalesces what is smaller.
    E.g. 100 TB of text -> about 2.3M partitions; set it per job.
    """
    return max(minimum, int(input_bytes * blowup // target_bytes) + 1)

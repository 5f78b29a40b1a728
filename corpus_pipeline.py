"""Corpus pipeline: documents to clean, encoded text.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns
a DataFrame that is written as Parquet and read again as the next stage's ``docs``.  All but
the last return the columns of ``documents``.

1. ``quality_rules``: documents that the rules reject go.
2. ``ngram_jaccard_join``: one document of each class of near copies stays.
3. ``decontaminate``: documents that share ten words in a row with a benchmark item go.
4. ``pii``: personal data in the text is replaced by its kind.
5. ``sentencepiece``: doc_id, token count and digests of the ids and of the decoded text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, ngram_join, pii_spans, quality_llr, queries
from tabloom.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_llr.apply_rules(docs, queries.trusted(spark, sf_dir))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    return ngram_join.drop_near_copies(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_spans.mask(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontaminate", decontaminate_benchmark),
    ("pii", pii),
    ("sentencepiece", sentencepiece),
]

#: SQL has neither the hash functions of the rules nor the tokenizer: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written below the shared checkpoint folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{base}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""A TF-IDF index that is kept up to date (R2 with I7): counts are stored, weights are computed when reading.

Inverse document frequencies and norms of every document change with each new document, counts
do not.  So the store holds counts alone, as one Parquet table that is partitioned by ``batch``
and ``kind``: ``tf`` (a term's count in a document), ``doc`` (a document), ``df`` (by how many
documents a batch raises or lowers a term's frequency), ``gone`` (a removed document) and
``batch`` (one row, so that a batch without documents shows).  ``model()`` adds up the
frequencies and gives the same index as one fit over the documents at hand.

A batch is one Spark write that replaces the partitions of its own number only, and sees only
batches of lower numbers: run again after a failure, it stores the same rows.  Batch numbers
rise, as those of a stream do (``foreachBatch(lambda df, n: index.add(df, n))``); one writer at a
time.  Only the new documents are tokenised; known ones are found by key.

Defined cases: documents whose key the index holds are left out of a batch (remove them first to
replace them); a key repeated within a batch raises, as in a fit; null or empty texts are
documents without terms; unknown keys to remove are ignored; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.functions.text import tokenize
from tabloom.operators.retrieve import TEXT_BYTES, TfidfModel, tfidf_weights
from tabloom.plans.sizing import broadcast_if_bounded


@dataclass
class TermIndex:
    spark: SparkSession
    path: str
    group_cols: list
    key_cols: list

    @staticmethod
    def create(chunks: DataFrame, path: str, group_cols=("source",), key_cols=("page",), text_col: str = "content",
               batch: int = 0) -> "TermIndex":
        """A new index at ``path`` with the first documents."""
        index = TermIndex(chunks.sparkSession, path, list(group_cols), list(key_cols))
        index._write(index._counts(chunks, text_col), batch)
        return index

    def add(self, chunks: DataFrame, batch: int, text_col: str = "content") -> None:
        """Count the documents that the index does not hold yet."""
        self._write(self._counts(chunks, text_col, self._live("doc", batch)), batch)

    def remove(self, keys: DataFrame, batch: int) -> None:
        """Take documents out; ``keys`` holds their group and key columns."""
        keys = broadcast_if_bounded(keys.select(*self.group_cols, *self.key_cols).distinct())
        gone = self._match(self._live("doc", batch), keys, "left_semi")
        fewer = self._match(self._live("tf", batch), keys, "left_semi").groupBy(*self.group_cols, "term").agg(
            (-F.count(F.lit(1))).alias("n"))
        self._write([("gone", gone.withColumn("n", F.lit(1))), ("df", fewer)], batch)

    def model(self) -> TfidfModel:
        """The index over all documents at hand."""
        g, kk = self.group_cols, self.key_cols
        docs = self._live("doc").select(*g, *kk)
        dfreq = self._rows("df").groupBy(*g, "term").agg(F.sum("n").alias("df")).where("df > 0")
        n_docs = docs.groupBy(*g).agg(F.count(F.lit(1)).alias("n_docs"))
        tf = self._live("tf").select(*g, *kk, "term", F.col("n").alias("tf"))
        return tfidf_weights(tf, dfreq, n_docs, docs, g, kk)

    def compact(self, path: str) -> "TermIndex":
        """The documents at hand as one batch at another path."""
        out = TermIndex(self.spark, path, self.group_cols, self.key_cols)
        last = self._rows("batch").agg(F.max("batch")).first()[0]
        frequencies = self._rows("df").groupBy(*self.group_cols, "term").agg(F.sum("n").alias("n")).where("n > 0")
        out._write([("tf", self._live("tf")), ("doc", self._live("doc")), ("df", frequencies)], last)
        return out

    def _rows(self, kind: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path).where(F.col("kind") == kind)
        return rows if before is None else rows.where(F.col("batch") < before)

    def _live(self, kind: str, before: int | None = None) -> DataFrame:
        """Rows of documents that no later batch removed."""
        gone = self._rows("gone", before).groupBy(*self.group_cols, *self.key_cols).agg(F.max("batch").alias("gone_at"))
        # The rows of terms are many; they stay where they are unless very many documents were removed.
        return self._match(self._rows(kind, before), broadcast_if_bounded(gone), "left_anti", F.col("a.batch") < F.col("b.gone_at"))

    def _match(self, rows: DataFrame, keys: DataFrame, how: str, also=None) -> DataFrame:
        on = F.lit(True) if also is None else also
        for c in (*self.group_cols, *self.key_cols):
            on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        return rows.alias("a").join(keys.alias("b"), on, how)

    def _counts(self, chunks: DataFrame, text_col: str, known: DataFrame | None = None) -> list[tuple[str, DataFrame]]:
        """Counts of the chunks whose key is not ``known``.

        Texts move once, to the task of their key, in parts of bounded size; there known ones are
        left out and terms counted, so that no term rows, which are many times as long, move.
        """
        g, kk = self.group_cols, self.key_cols
        key = F.struct(*g, *kk).alias("_key")  # as one value its nulls are equal
        docs = chunks.select(key, F.col(text_col).alias("_text"))
        size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
        docs = docs.repartition(size // TEXT_BYTES + 1, "_key")
        if known is not None:
            docs = docs.join(known.select(key).hint("shuffle_hash"), "_key", "left_anti")
        columns = [F.col("_key")[c].alias(c) for c in (*g, *kk)]
        tf = docs.select("_key", F.explode(tokenize("_text")).alias("term")).groupBy("_key", "term").agg(F.count(F.lit(1)).alias("n"))
        df = docs.select(*columns[: len(g)], F.explode(F.array_distinct(tokenize("_text"))).alias("term")).groupBy(*g, "term").agg(F.count(F.lit(1)).alias("n"))
        doc = docs.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "n", F.when(F.col("n") > 1, F.raise_error(F.lit("several chunks share one key")).cast("long")).otherwise(F.col("n")))
        return [("tf", tf.select(*columns, "term", "n")), ("doc", doc.select(*columns, "n")), ("df", df)]

    def _write(self, parts: list[tuple[str, DataFrame]], batch: int) -> None:
        """All rows of a batch in one write, over what an earlier try of it left."""
        order = [*self.group_cols, *self.key_cols, "term", "n", "kind"]
        rows = None
        for kind, part in [*parts, ("batch", self.spark.range(1).select(F.lit(1).alias("n")))]:
            keep = [c for c in order if c in part.columns and c != "kind"]
            part = part.select(*keep, F.lit(kind).alias("kind")).withColumn("n", F.col("n").cast("long"))
            rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
        rows = rows.select(*order, F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "kind").parquet(self.path)

"""Hits of questions kept from one run to the next.

A store has three tables: the asked questions by digest (question vector and the
text of the filter they ran under), their best ``k`` documents with scores, and the
keys of all documents they were scored against.  A later run scores

* a known question against the documents that the store has not seen, merged
  into its stored list, whose order follows the same rules;
* a new question, or one that lost a stored document or asks for more than was
  kept, against all documents.

Cosine scores of old documents do not change when documents are added, so the
merged list equals a full run.  (Sparse scores do change, with the document
frequencies; their fit is stored instead, see ``plans.index_store``.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.retrieve import DEFAULT_K, RANK_DIGITS, _rank, chunk_keys, dense_topk


@dataclass
class Hits:
    """asked: digest, k; found: digest, <group>, <key>, score; known: <group>, <key>."""

    asked: DataFrame
    found: DataFrame
    known: DataFrame

    def save(self, path: str) -> None:
        """Write to a new folder of the caller's choice; the asked questions last, so a folder with them is complete."""
        self.found.write.parquet(f"{path}/found")
        self.known.write.parquet(f"{path}/known")
        self.asked.write.parquet(f"{path}/asked")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Hits":
        return Hits(*(spark.read.parquet(f"{path}/{t}") for t in ("asked", "found", "known")))


def digest(vector: str, filters: str):
    """Digest of a question's vector and the filter it runs under; null without a vector."""
    return F.sha2(F.concat_ws("|", F.lit(filters), F.to_json(F.struct(F.col(vector).alias("v")))), 256)


def ask(queries: DataFrame, vecs: DataFrame, stored: Hits | None = None, k: int = DEFAULT_K, group_cols=("source",), key_cols=None,
        query_col: str = "query_id", qvec_col: str = "embedding", vec_col: str = "embedding", score: str = "distance",
        filters: str = "") -> tuple[DataFrame, Hits]:
    """(ranked hits per query and group as :func:`dense_topk` gives them, the store after this run).

    ``filters`` names the filter that ``vecs`` went through.  Equal questions are scored once.
    """
    g, kk = list(group_cols), chunk_keys(vecs, key_cols)
    named = queries.select(F.col(query_col).alias("query_id"), digest(qvec_col, f"{score}|{filters}").alias("digest"), F.col(qvec_col).alias("v")).where(
        F.col("v").isNotNull())
    questions = named.groupBy("digest").agg(F.first("v").alias("embedding")).withColumnRenamed("digest", "query_id")
    rows = vecs.where(F.col(vec_col).isNotNull()).select(*g, *kk, F.col(vec_col).alias("embedding"))
    keys = rows.select(*g, *kk)

    def scored(q: DataFrame, docs: DataFrame) -> DataFrame:
        return dense_topk(q, docs, k, g, kk, score=score).select(F.col("query_id").alias("digest"), *g, *kk, "score")

    if stored is None:
        found = scored(questions, rows)
    else:
        lost = stored.found.join(keys, [*g, *kk], "left_anti").select("digest").distinct()
        kept = stored.asked.where(F.col("k") >= k).join(lost, "digest", "left_anti").select("digest")
        old = questions.join(kept.withColumnRenamed("digest", "query_id"), "query_id", "left_semi")
        fresh = questions.join(kept.withColumnRenamed("digest", "query_id"), "query_id", "left_anti")
        added = rows.join(stored.known, [*g, *kk], "left_anti")
        again = stored.found.join(old.select(F.col("query_id").alias("digest")), "digest", "left_semi")
        found = again.unionByName(scored(old, added)).unionByName(scored(fresh, rows))
    order = F.round("score", RANK_DIGITS)
    order = [order.desc() if score == "similarity" else order.asc(), *[F.col(c).asc() for c in kk]]
    best = _rank(found, ["digest", *g], order, k).checkpoint()
    out = named.drop("v").join(best, "digest").select("query_id", *g, *kk, "score", "rank")
    return out, Hits(questions.select(F.col("query_id").alias("digest"), F.lit(k).alias("k")), best.drop("rank"), keys)

"""Registered retrieval queries (R1-R12, W1, J1) over the driver tables.

Queries are all ``benchmark`` items; chunks are all ``documents``; vectors
are all ``embeddings`` that join a document.  Output columns:
query_id, source, page, rank, score (rounded to 6 dp).
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import hits
from tabloom.operators.filters import any_sector
from tabloom.operators.retrieve import DEFAULT_K, DEFAULT_LAMBDA, dense_topk, fuse, round_score, sparse_topk
from tabloom.operators.term_index import TermIndex
from tabloom.plans import sql_frags as S
from tabloom.plans.index_store import code_version, stored_tfidf
from tabloom.plans.registry import register
from tabloom.session import checkpoint_dir
from tabloom.sources import driver

# Sector selection used by the sector-form queries (two languages).
SECTOR_SELECTION = ("de", "es")
SELECTION_NAME = "de|es"
# Documents that the kept index loses and gets back.
REMOVED_SECTOR = ("fr",)


def _out(df, group="source"):
    return df.select(F.col("query_id").cast("long"), "source", F.col("page").cast("long"),
                     F.col("rank").cast("long"), round_score("score").alias("score"))


def _sector_chunks(spark, sf_dir):
    ch = any_sector(driver.chunks(spark, sf_dir), SECTOR_SELECTION)
    return ch.withColumn("selection", F.lit(SELECTION_NAME))


def _sector_vecs(spark, sf_dir):
    v = any_sector(driver.vectors(spark, sf_dir), SECTOR_SELECTION)
    return v.withColumn("selection", F.lit(SELECTION_NAME))


def _corpus_files(sf_dir):
    d = sf_dir.rstrip("/")
    return [f"{d}/documents.parquet", f"{d}/labels.parquet"]


def source_index(spark, sf_dir):
    """The per-document TF-IDF index, fitted once per corpus version and stored."""
    return stored_tfidf(spark, "by-source", _corpus_files(sf_dir), lambda: driver.chunks(spark, sf_dir),
                        ["source"], ["page"], version=code_version(driver.chunks))


def sector_index(spark, sf_dir):
    """The TF-IDF index of the sector selection (fitted on its union), stored likewise."""
    name = "sectors-" + "-".join(SECTOR_SELECTION)
    return stored_tfidf(spark, name, _corpus_files(sf_dir), lambda: _sector_chunks(spark, sf_dir),
                        ["selection"], ["source", "page"], version=code_version(driver.chunks, _sector_chunks))


def sparse_by_source(spark, sf_dir, k=DEFAULT_K):
    return sparse_topk(driver.text_queries(spark, sf_dir), source_index(spark, sf_dir), k)


def sparse_by_sectors(spark, sf_dir, k=DEFAULT_K):
    return sparse_topk(driver.text_queries(spark, sf_dir), sector_index(spark, sf_dir), k)


def dense_by_source(spark, sf_dir, k=DEFAULT_K):
    return dense_topk(driver.vector_queries(spark, sf_dir), driver.vectors(spark, sf_dir), k,
                      ["source"], ["page"], score="distance")


def dense_by_sectors(spark, sf_dir, k=DEFAULT_K):
    return dense_topk(driver.vector_queries(spark, sf_dir), _sector_vecs(spark, sf_dir), k,
                      ["selection"], ["source", "page"], score="similarity")


def hybrid_by_source(spark, sf_dir, k=DEFAULT_K, lmbd=DEFAULT_LAMBDA):
    return fuse(dense_by_source(spark, sf_dir, k), sparse_by_source(spark, sf_dir, k), k, lmbd,
                ["source"], ["page"], dense_score="distance")


def hybrid_by_sectors(spark, sf_dir, k=DEFAULT_K, lmbd=DEFAULT_LAMBDA):
    return fuse(dense_by_sectors(spark, sf_dir, k), sparse_by_sectors(spark, sf_dir, k), k, lmbd,
                ["selection"], ["source", "page"], dense_score="similarity")


_SECTOR_DOCS = f"""sp_docs AS (SELECT '{SELECTION_NAME}' AS grp, source, page, content FROM chunks
                WHERE list_has_any(company_sectors, {list(SECTOR_SELECTION)}))"""
_SOURCE_DOCS = "sp_docs AS (SELECT source AS grp, source, page, content FROM chunks)"
_SOURCE_VECS = "dn_vecs AS (SELECT source AS grp, source, page, embedding, vn FROM vecs)"
_SECTOR_VECS = f"""dn_vecs AS (SELECT '{SELECTION_NAME}' AS grp, source, page, embedding, vn FROM vecs
                WHERE list_has_any(company_sectors, {list(SECTOR_SELECTION)}))"""
_SELECT = "SELECT query_id, source, page, rank, " + S.rnd("score") + " AS score FROM {}_top"


def _sql(*ctes, final):
    return "WITH " + ",\n".join(ctes) + "\n" + final


SQL_SPARSE_SOURCE = _sql(S.CHUNKS, S.Q_TEXT, _SOURCE_DOCS, S.sparse_ctes("sp", DEFAULT_K),
                         final=_SELECT.format("sp"))
SQL_SPARSE_SECTORS = _sql(S.CHUNKS, S.Q_TEXT, _SECTOR_DOCS, S.sparse_ctes("sp", DEFAULT_K),
                          final=_SELECT.format("sp"))
SQL_DENSE_SOURCE = _sql(S.CHUNKS, S.Q_VEC, S.VECS, _SOURCE_VECS, S.dense_ctes("dn", DEFAULT_K),
                        final=_SELECT.format("dn"))
SQL_DENSE_SECTORS = _sql(S.CHUNKS, S.Q_VEC, S.VECS, _SECTOR_VECS,
                         S.dense_ctes("dn", DEFAULT_K, similarity=True), final=_SELECT.format("dn"))
HYBRID_SOURCE_CTES = ",\n".join([S.CHUNKS, S.Q_TEXT, S.Q_VEC, S.VECS, _SOURCE_DOCS, _SOURCE_VECS,
                                  S.sparse_ctes("sp", DEFAULT_K), S.dense_ctes("dn", DEFAULT_K),
                                  S.fuse_ctes("hy", "dn", "sp", DEFAULT_K, DEFAULT_LAMBDA)])
SQL_HYBRID_SOURCE = "WITH " + HYBRID_SOURCE_CTES + "\n" + _SELECT.format("hy")
HYBRID_SECTORS_CTES = ",\n".join([S.CHUNKS, S.Q_TEXT, S.Q_VEC, S.VECS, _SECTOR_DOCS, _SECTOR_VECS,
                                   S.sparse_ctes("sp", DEFAULT_K), S.dense_ctes("dn", DEFAULT_K, similarity=True),
                                   S.fuse_ctes("hy", "dn", "sp", DEFAULT_K, DEFAULT_LAMBDA, similarity=True)])
SQL_HYBRID_SECTORS = "WITH " + HYBRID_SECTORS_CTES + "\n" + _SELECT.format("hy")


@register("sparse_topk_by_source", SQL_SPARSE_SOURCE)
def q_sparse_topk_by_source(spark, sf_dir):
    return _out(sparse_by_source(spark, sf_dir))


@register("sparse_topk_by_sectors", SQL_SPARSE_SECTORS)
def q_sparse_topk_by_sectors(spark, sf_dir):
    return _out(sparse_by_sectors(spark, sf_dir))


@register("dense_topk_by_source", SQL_DENSE_SOURCE)
def q_dense_topk_by_source(spark, sf_dir):
    return _out(dense_by_source(spark, sf_dir))


@register("dense_topk_by_sectors", SQL_DENSE_SECTORS)
def q_dense_topk_by_sectors(spark, sf_dir):
    return _out(dense_by_sectors(spark, sf_dir))


@register("hybrid_topk_by_source", SQL_HYBRID_SOURCE)
def q_hybrid_topk_by_source(spark, sf_dir):
    return _out(hybrid_by_source(spark, sf_dir))


@register("hybrid_topk_by_sectors", SQL_HYBRID_SECTORS)
def q_hybrid_topk_by_sectors(spark, sf_dir):
    return _out(hybrid_by_sectors(spark, sf_dir))


@register("stored_dense_hits", SQL_DENSE_SOURCE)
def q_stored_dense_hits(spark, sf_dir):
    """Every question asked over the documents of a sector selection, then again once all are loaded."""
    asked = driver.vector_queries(spark, sf_dir)
    _, store = hits.ask(asked, _sector_vecs(spark, sf_dir).drop("selection"), None, DEFAULT_K, ["source"], ["page"])
    path = f"{checkpoint_dir(spark).rstrip('/')}/hits-{uuid.uuid4().hex}"
    store.save(path)
    again, _ = hits.ask(asked, driver.vectors(spark, sf_dir), hits.Hits.load(spark, path), DEFAULT_K, ["source"], ["page"])
    return _out(again)


@register("sparse_topk_grown_index", SQL_SPARSE_SOURCE)
def q_sparse_topk_grown_index(spark, sf_dir):
    """R2 with I7: an index that starts with one sector selection, takes in all documents, loses those of a language
    and takes in all again, asked like a full fit."""
    chunks = driver.chunks(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/terms-{uuid.uuid4().hex}"
    index = TermIndex.create(any_sector(chunks, SECTOR_SELECTION), path)
    index.add(chunks, 1)
    index.remove(any_sector(chunks, REMOVED_SECTOR).select("source", "page"), 2)
    index.add(chunks, 3)
    return _out(sparse_topk(driver.text_queries(spark, sf_dir), index.model().checkpoint(), DEFAULT_K))

"""Top-k retrieval for many queries at once: TF-IDF, dense cosine, fusion.

Shapes
------
chunks   : <group cols>, <key cols>, content
queries  : query_id, text            (sparse)   /  query_id, embedding (dense)
result   : query_id, <group cols>, <key cols>, rank (int, 1..k), score (double)

Plan shape (see README "Retrieval at scale"):
* documents are dealt into cells of bounded size (large groups over several
  cells, small groups together), queries into blocks of bounded size; every
  (block, cell) pair meets in one task, nothing passes the driver;
* a task scores its documents in key order and returns the best k of each
  (query, group), so rows out do not grow with the documents;
* sparse scoring skips document blocks, and terms within a block, that cannot
  reach the k-th score found so far (see ``scoring``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.text import tokenize
from tabloom.operators import scoring
from tabloom.operators.filters import apply_filters, validate_retrieval
from tabloom.plans.sizing import MAX_BROADCAST_BYTES
from tabloom.session import checkpoint_dir

# Fixed values that must equal the reference's behaviour.
DEFAULT_K = 5          # hits per retriever and after fusion
DEFAULT_LAMBDA = 0.3   # weight of the sparse score in fusion

# Scores are rounded before ranking so float noise (summation order) cannot
# reorder equal documents; ties then fall back to the key columns.
RANK_DIGITS = 9

# Bytes of a block of queries, and documents and bytes of vectors of a cell.
QUERY_BLOCK_BYTES = 4 << 20
CELL_DOCS, CELL_BYTES = 1 << 11, 32 << 20
# Bytes of text whose terms one task of a fit counts.
TEXT_BYTES = 8 << 20


def chunk_keys(df: DataFrame, key_cols=None) -> list:
    """The key columns of a chunk within its group: given ones, else page and, where there is one, chunk_no."""
    if key_cols is not None:
        return list(key_cols)
    return ["page", "chunk_no"] if "chunk_no" in df.columns else ["page"]


@dataclass
class TfidfModel:
    """A fitted TF-IDF index per group (one source, or one sector selection).

    weights : group, key, term, idf, wn   (wn = L2-normalised tf*idf of the doc)
    idf     : group, term, idf
    docs    : group, key                  (all docs, also those with no token)
    """

    weights: DataFrame
    idf: DataFrame
    docs: DataFrame
    group_cols: list
    key_cols: list

    def persist(self) -> "TfidfModel":
        """Keep the fit for reuse by several retrieval plans (lazy)."""
        for df in (self.weights, self.idf, self.docs):
            df.persist()
        return self

    def checkpoint(self) -> "TfidfModel":
        """Cut the lineage of the fit with a copy below ``spark.checkpoint.dir``.

        After this, a lost executor costs a re-read of the copy, not a re-tokenisation
        of the corpus.  It is Parquet, so the rows are a fraction of checkpointed ones.
        """
        spark = self.weights.sparkSession
        path = f"{checkpoint_dir(spark).rstrip('/')}/fits/{uuid.uuid4().hex}"
        for name, df in (("weights", self.weights), ("idf", self.idf), ("docs", self.docs)):
            df.write.parquet(f"{path}/{name}")
        return TfidfModel.load(spark, path, self.group_cols, self.key_cols)

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Store the fit as Parquet (weights clustered by group and term for pruned scans)."""
        self.weights.sortWithinPartitions(*self.group_cols, "term").write.mode(mode).parquet(f"{path}/weights")
        self.idf.sortWithinPartitions(*self.group_cols, "term").write.mode(mode).parquet(f"{path}/idf")
        self.docs.write.mode(mode).parquet(f"{path}/docs")

    @staticmethod
    def load(spark, path: str, group_cols, key_cols) -> "TfidfModel":
        return TfidfModel(spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/idf"),
                          spark.read.parquet(f"{path}/docs"), list(group_cols), list(key_cols))


def tfidf_fit(chunks: DataFrame, group_cols=("source",), key_cols=None,
              text_col: str = "content") -> TfidfModel:
    """R2: raw tf, smooth idf ``ln((1+N)/(1+df)) + 1``, L2-normalised doc vectors.

    ``N`` counts every document of the group, also those without tokens.  A
    key that several chunks share raises: their terms could not be told apart.
    """
    g, kk = list(group_cols), chunk_keys(chunks, key_cols)
    return tfidf_weights(*tfidf_counts(chunks, g, kk, text_col), g, kk)


def tfidf_counts(chunks: DataFrame, g: list, kk: list, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tf per document and term, df per term, documents per group, document keys).

    Texts move once, to the task of their key, where their term rows, which
    are many times as long, are counted.
    """
    docs = chunks.select(*g, *kk, F.col(text_col).alias("_text"))
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    terms = docs.repartition(size // TEXT_BYTES + 1, *g, *kk).select(*g, *kk, F.explode(tokenize("_text")).alias("term"))
    tf = terms.groupBy(*g, *kk, "term").agg(F.count(F.lit(1)).alias("tf"))
    per_key = docs.groupBy(*g, *kk).agg(F.count(F.lit(1)).alias("_n"))
    n_docs = per_key.groupBy(*g).agg(F.when(F.max("_n") > 1, F.raise_error(F.lit("several chunks share one key")).cast("long"))
                                     .otherwise(F.count(F.lit(1))).alias("n_docs"))
    # A key is one row, so its distinct terms are known without moving it.
    dfreq = docs.select(*g, F.explode(F.array_distinct(tokenize("_text"))).alias("term")).groupBy(*g, "term").agg(F.count(F.lit(1)).alias("df"))
    return tf, dfreq, n_docs, docs.select(*g, *kk)


def _idf(dfreq: DataFrame, n_docs: DataFrame, g: list) -> DataFrame:
    return dfreq.join(n_docs, g).select(
        *g, "term",
        (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)).alias("idf"))


def _weigh(tf: DataFrame, idf: DataFrame, g: list, kk: list) -> DataFrame:
    # Moved by document before the products are made: these would move with them.
    w = (tf.join(idf, g + ["term"]).select(*g, *kk, "term", "idf", "tf").repartition(*g, *kk)
         .select(*g, *kk, "term", "idf", (F.col("tf") * F.col("idf")).alias("w"), F.xxhash64(*g, *kk).alias("_h")))
    # Sorted by a hash first: a number that differs by document tells rows apart sooner than a group's name.
    doc_win = Window.partitionBy("_h", *g, *kk)
    return w.select(*g, *kk, "term", "idf",
                    (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(doc_win))).alias("wn"))


def tfidf_weights(tf: DataFrame, dfreq: DataFrame, n_docs: DataFrame, docs: DataFrame, g: list, kk: list) -> TfidfModel:
    """The model of term counts (``tf`` per document and term, ``df`` per term, ``n_docs`` per group)."""
    idf = _idf(dfreq, n_docs, g)
    # Hash join building on idf (one row per group and term, far smaller than
    # tf): no sort of the tf rows; AQE still splits a skewed hot-term partition.
    return TfidfModel(_weigh(tf, idf.hint("shuffle_hash"), g, kk), idf, docs, g, kk)


def tfidf_store(chunks: DataFrame, path: str, group_cols=("source",), key_cols=None, text_col: str = "content") -> None:
    """:func:`tfidf_fit` stored as :meth:`TfidfModel.save` does, the idf first, so that the weights read it."""
    g, kk = list(group_cols), chunk_keys(chunks, key_cols)
    tf, dfreq, n_docs, docs = tfidf_counts(chunks, g, kk, text_col)
    _idf(dfreq, n_docs, g).sortWithinPartitions(*g, "term").write.parquet(f"{path}/idf")
    idf = chunks.sparkSession.read.parquet(f"{path}/idf")
    _weigh(tf, idf.hint("shuffle_hash"), g, kk).sortWithinPartitions(*g, "term").write.parquet(f"{path}/weights")
    docs.write.parquet(f"{path}/docs")


def query_terms(queries: DataFrame, query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """(query_id, term, qtf): raw term counts of each query."""
    q = queries.select(F.col(query_col).alias("query_id"), F.explode(tokenize(text_col)).alias("term"))
    return q.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("qtf"))


def _rank(df: DataFrame, part_cols, order_cols, k: int) -> DataFrame:
    w = Window.partitionBy(*part_cols).orderBy(*order_cols)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _dealt(docs: DataFrame, keys: DataFrame, n_docs: int, group_cols, key_cols, cell_docs: int) -> tuple[DataFrame, int]:
    """``docs`` with a cell number, and the number of cells.

    ``keys`` has one row for each of ``n_docs`` documents.  A group of n documents spreads
    over ``ceil(n / cell_docs)`` parts by a hash of the key; parts are hashed to cells.
    """
    g, kk = list(group_cols), list(key_cols)
    if n_docs <= cell_docs:
        return docs.withColumn("_cell", F.lit(0)), 1
    # every document in group (hash) order; groups are matched null-safe through the hash
    group = F.xxhash64(*g) if g else F.lit(0).cast("long")
    sizes = keys.groupBy(group.alias("_g")).agg(F.ceil(F.count(F.lit(1)) / F.lit(cell_docs)).cast("int").alias("_parts"))
    n = -(-n_docs // cell_docs)
    part = F.pmod(F.xxhash64(*kk), F.col("_parts"))
    cell = F.pmod(F.xxhash64("_g", part), F.lit(n)).cast("int")
    return docs.withColumn("_g", group).join(sizes, "_g").withColumn("_cell", cell).drop("_g", "_parts"), n


def _meet(queries: DataFrame, docs: DataFrame, cells: int, query_bytes: int, score, schema: str) -> DataFrame:
    """``score(documents, queries)`` (Arrow tables) for every (query block, cell)."""
    blocks = -(-max(query_bytes, 1) // QUERY_BLOCK_BYTES)
    q = (queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
         .withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))))
    d = docs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else docs.withColumn("_block", F.lit(0))
    return d.groupBy("_block", "_cell").cogroup(q.groupBy("_block", "_cell")).applyInArrow(score, schema)


def _schema(queries: DataFrame, query_col: str, rows: DataFrame, score: str) -> str:
    kinds = [f"query_id {queries.schema[query_col].dataType.simpleString()}"]
    return ", ".join(kinds + [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + [f"{score} double"])


def sparse_topk(queries: DataFrame, model: TfidfModel, k: int = DEFAULT_K,
                query_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """cosine(query, doc) top-k per (query, group).

    Every query is scored against every group of the model (J1).  Documents
    sharing no term score 0; they only fill the lists of queries that have
    fewer than k positive hits in a group, taken in key order.

    The index rows of query terms are dealt by document, so a task holds all
    of a document's and sums its scores itself; exact block-max pruning (see
    ``scoring.sparse_cell``) leaves the best k of each (query, group) and cell.
    """
    g, kk = model.group_cols, model.key_cols
    qtf = query_terms(queries, query_col, text_col)
    every = queries.select(F.col(query_col).alias("query_id"))
    size = queries.agg(F.sum(F.octet_length(text_col) + 64)).first()[0] or 0
    if size * 16 <= MAX_BROADCAST_BYTES:  # a term of n bytes, with its row, takes less than 16 n
        qtf = F.broadcast(qtf)
        words = F.broadcast(qtf.select("term").distinct())
    else:
        words = qtf.select("term").distinct()
    postings = model.weights.join(words, "term", "left_semi").select(*g, *kk, "term", (F.col("wn") * F.col("idf")).alias("w"))
    none = (F.lit(None).cast("string").alias("term"), F.lit(None).cast("double"))
    docs, cells = _dealt(postings.unionByName(model.docs.select(*g, *kk, none[0], none[1].alias("w"))), model.docs, model.docs.count(), g, kk, CELL_DOCS)
    asked = qtf.unionByName(every.select("query_id", none[0], none[1].alias("qtf")))
    found = _meet(asked, docs, cells, size, scoring.sparse_cell(g, kk, k, RANK_DIGITS), _schema(queries, query_col, model.docs.select(*g, *kk), "raw"))
    # The query norm is constant within a (query, group), so ranking on the
    # raw dot product gives the cosine order.
    order = [F.round("raw", RANK_DIGITS).desc(), *[F.col(c).asc() for c in kk]]
    ranked = _rank(found, ["query_id", *g], order, k)
    # The query vector is normalised over the terms known to the group only.
    qnorm = (model.idf.join(qtf, "term")
             .groupBy("query_id", *g)
             .agg(F.sqrt(F.sum(F.pow(F.col("qtf") * F.col("idf"), 2))).alias("qnorm")))
    out = ranked.join(qnorm, ["query_id", *g], "left")
    score = F.when(F.col("raw") > 0, F.col("raw") / F.col("qnorm")).otherwise(F.lit(0.0))
    return out.select("query_id", *g, *kk, score.alias("score"), "rank")


def dense_topk(queries: DataFrame, vecs: DataFrame, k: int = DEFAULT_K,
               group_cols=("source",), key_cols=None,
               query_col: str = "query_id", qvec_col: str = "embedding",
               vec_col: str = "embedding", score: str = "distance") -> DataFrame:
    """Exact cosine top-k per (query, group).

    ``score='distance'`` returns ``1 - cos`` ascending (dense store default),
    ``score='similarity'`` returns ``cos`` descending.  Rows with a null
    embedding are dropped (S14), as are vectors without direction; equality
    filters go on ``vecs`` beforehand.

    Query blocks and vector cells of bounded bytes meet in tasks; a task
    multiplies them and returns the best k of each (query, group) of its cell.
    """
    if score not in ("distance", "similarity"):
        raise ValueError("score must be 'distance' or 'similarity'")
    g, kk = list(group_cols), chunk_keys(vecs, key_cols)
    desc = score == "similarity"
    q = queries.select(F.col(query_col).alias("query_id"), F.col(qvec_col).alias("v")).where(F.col("v").isNotNull())
    rows = vecs.where(F.col(vec_col).isNotNull()).select(*g, *kk, F.col(vec_col).alias("v"))
    size = q.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
    n_docs, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    docs, cells = _dealt(rows, rows, n_docs, g, kk, max(1, min(CELL_DOCS, CELL_BYTES // (8 * max(width or 1, 1)))))
    found = _meet(q, docs, cells, size, scoring.dense_cell(g, kk, k, RANK_DIGITS, desc), _schema(queries, query_col, rows.select(*g, *kk), "score"))
    order = F.round("score", RANK_DIGITS)
    return _rank(found, ["query_id", *g], [order.desc() if desc else order.asc(), *[F.col(c).asc() for c in kk]], k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int = DEFAULT_K, lmbd: float = DEFAULT_LAMBDA,
         part_cols=("source",), key_cols=None, dense_score: str = "distance") -> DataFrame:
    """Weighted fusion of two ranked lists.

    fused = -dense_distance + lmbd * sparse_score, summed per chunk identity;
    a side that misses a chunk adds 0.  Ties keep dense hits first, each
    side in its own rank order.  A similarity list is turned into a distance
    first (quirk Q4 of the reference).
    """
    p, kk = list(part_cols), chunk_keys(dense, key_cols)
    dscore = F.col("score") if dense_score == "distance" else (F.lit(1.0) - F.col("score"))
    d = dense.select("query_id", *p, *kk, (-dscore).alias("s"), F.lit(0).alias("side"), "rank")
    s = sparse.select("query_id", *p, *kk, (F.col("score") * F.lit(lmbd)).alias("s"),
                      F.lit(1).alias("side"), "rank")
    agg = (d.unionByName(s)
           .groupBy("query_id", *p, *kk)
           .agg(F.sum("s").alias("score"), F.min(F.struct("side", "rank")).alias("_first")))
    return _rank(agg, ["query_id", *p],
                 [F.round("score", RANK_DIGITS).desc(), F.col("_first.side"), F.col("_first.rank")],
                 k).drop("_first")


def head_k(ranked: DataFrame, k: int) -> DataFrame:
    """Keep the first k of an already ranked list."""
    return ranked.where(F.col("rank") <= k)


def hybrid_topk(queries_text: DataFrame, queries_vec: DataFrame, chunks: DataFrame, vecs: DataFrame,
                k: int = DEFAULT_K, lmbd: float = DEFAULT_LAMBDA, group_cols=("source",),
                key_cols=None, dense_score: str = "distance") -> DataFrame:
    """Dense top-k and sparse top-k per group, then fusion."""
    model = tfidf_fit(chunks, group_cols, key_cols)
    sparse = sparse_topk(queries_text, model, k)
    dense = dense_topk(queries_vec, vecs, k, group_cols, key_cols, score=dense_score)
    return fuse(dense, sparse, k, lmbd, group_cols, key_cols, dense_score=dense_score)


def retrieve(chunks: DataFrame, vecs: DataFrame, queries_text: DataFrame, queries_vec: DataFrame, filters=(),
             use_dense: bool = False, use_sparse: bool = False, use_ensemble: bool = False, k: int = DEFAULT_K,
             lmbd: float = DEFAULT_LAMBDA, with_scores: bool = True) -> DataFrame:
    """The retrieval call: checks its arguments (F3), filters both stores (F1) and runs one mode."""
    validate_retrieval(filters, use_dense, use_sparse, use_ensemble)
    chunks, vecs = apply_filters(chunks, filters), apply_filters(vecs, filters)
    if use_dense:
        found = dense_topk(queries_vec, vecs, k)
    elif use_sparse:
        found = sparse_topk(queries_text, tfidf_fit(chunks), k)
    else:
        found = hybrid_topk(queries_text, queries_vec, chunks, vecs, k, lmbd)
    return head_k(found, k) if with_scores else without_scores(head_k(found, k))


def without_scores(hits: DataFrame) -> DataFrame:
    """Drop the score column."""
    return hits.drop("score")


def round_score(col, digits: int = 6) -> Column:
    """Round for output; a rounded zero is always +0.0 (never -0.0)."""
    r = F.round(F.col(col) if isinstance(col, str) else col, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)

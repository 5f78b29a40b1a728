"""Ingest: chunking, enrichment, content ids, idempotent loads, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.packing import packed_chunks
from tabloom.functions.text import chunk_id, clean_key, company_from_source, title_from_source

# Fixed values that must equal the reference's behaviour.
DEFAULT_CHUNK_SIZE = 4000      # characters per chunk of the default splitter
DEFAULT_CHUNK_OVERLAP = 200    # characters shared by consecutive chunks
HEAD_PAGES = 4                 # pages read to name a company
NO_TEXT_STATUS = "no_text"
UNRESOLVED_ID = r"^Q\d+$"      # unresolved knowledge-base ids are not sectors

CHUNK_ID_FIELDS = ("content", "source", "page", "model_name", "company_name", "company_sectors")


def with_chunk_id(chunks: DataFrame, fields=CHUNK_ID_FIELDS) -> DataFrame:
    """Content id over the content and metadata values in a fixed order."""
    cols = [F.array_join(F.col(f), ",") if f == "company_sectors" else F.col(f) for f in fields]
    return chunks.withColumn("chunk_id", chunk_id(*cols))


def enrich(chunks: DataFrame, model_name: str, companies: DataFrame | None = None) -> DataFrame:
    """Stamp the model on every chunk; company and sectors from a dimension.

    ``companies(source, company_name, company_sectors)`` is a per-document
    dimension (one row per source); a value is only set when it is non-empty,
    otherwise the chunk keeps what it had.  Without a dimension, the company is
    derived from the file name (I2).
    """
    out = chunks.withColumn("model_name", F.lit(model_name))
    if companies is None:
        if "company_name" not in out.columns:
            out = out.withColumn("company_name", company_from_source("source"))
        return out
    dim = companies.select("source", F.col("company_name").alias("_cn"),
                           F.col("company_sectors").alias("_cs"))
    out = out.join(dim, "source", "left")
    name_ok = F.col("_cn").isNotNull() & (F.length("_cn") > 0)
    sect_ok = F.col("_cs").isNotNull() & (F.size("_cs") > 0)
    keep_name = F.col("company_name") if "company_name" in chunks.columns else F.lit(None).cast("string")
    keep_sect = (F.col("company_sectors") if "company_sectors" in chunks.columns
                 else F.lit(None).cast("array<string>"))
    return (out.withColumn("company_name", F.when(name_ok, F.col("_cn")).otherwise(keep_name))
            .withColumn("company_sectors", F.when(sect_ok, F.col("_cs")).otherwise(keep_sect))
            .drop("_cn", "_cs"))


def with_title(chunks: DataFrame) -> DataFrame:
    """title = base name of the source without its extension."""
    return chunks.withColumn("title", title_from_source("source"))


def with_lower(chunks: DataFrame, col: str = "content") -> DataFrame:
    """Lower-cased copy of the text kept beside the original."""
    return chunks.withColumn(f"{col}_lc", F.lower(F.col(col)))


STORE_BUCKETS = 1024  # folders of the chunk store (hash of the source)


def with_store_bucket(chunks: DataFrame, n: int = STORE_BUCKETS) -> DataFrame:
    """Bucket of the chunk store a chunk belongs to (store partition column)."""
    return chunks.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(n)).cast("int"))


def split_new(batch: DataFrame, store: DataFrame, keys=("chunk_id",)) -> tuple[DataFrame, DataFrame]:
    """(new chunks, skipped (source, page)) of a batch against a store.

    Duplicates inside the batch are removed too (quirk Q2 of the reference).
    The store is only *probed*: a semi join from the store to the batch's
    keys finds the ids that already exist, so a small batch never shuffles
    the whole store.  With ``keys=("bucket", "chunk_id")`` and a store
    partitioned by ``bucket``, dynamic partition pruning limits the scan to
    the buckets the batch touches.  The batch keys are broadcast only when
    their size is proven small.
    """
    from tabloom.plans.sizing import broadcast_if_bounded
    keys = list(keys)
    dedup = batch.dropDuplicates(["chunk_id"])
    batch_keys = broadcast_if_bounded(dedup.select(*keys))
    existing = store.select(*keys).join(batch_keys, keys, "left_semi")
    new = dedup.join(existing, keys, "left_anti")
    skipped = dedup.join(existing, keys, "left_semi").select("source", "page").distinct()
    return new, skipped


def delete_chunks(store: DataFrame, ids) -> DataFrame:
    """I8: the store without the given ids; ``'all'`` empties it.

    ``ids`` is a DataFrame with a ``chunk_id`` column (any size: anti join),
    a Python list of ids, or the string ``'all'``; other strings are errors.
    """
    if isinstance(ids, str):
        if ids != "all":
            raise ValueError(f"ids must be a list of ids or 'all', got {ids!r}")
        return store.limit(0)
    if isinstance(ids, DataFrame):
        return store.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    ids = list(ids)
    if not ids:
        return store
    return store.where(~F.col("chunk_id").isin(ids))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Start offsets (0-based) of fixed windows covering ``n`` characters."""
    step = size - overlap
    n_windows = F.lit(1) + F.ceil(F.greatest(n - F.lit(size), F.lit(0)) / F.lit(step)).cast("int")
    return F.sequence(F.lit(0), (n_windows - 1) * F.lit(step), F.lit(step))


def chunk_fixed(pages: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                text_col: str = "text", key_cols=("source", "page")) -> DataFrame:
    """Overlapping fixed windows of ``size`` chars, ``overlap`` shared.

    Windows are produced inside each row (``posexplode`` of a ``sequence``),
    so chunking never shuffles.  Empty texts yield no chunk (I11).
    """
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    kk = list(key_cols)
    t = F.col(text_col)
    base = pages.where(t.isNotNull() & (F.length(t) > 0))
    exploded = base.select(*kk, t.alias("_t"),
                           F.posexplode(window_starts(F.length(t), size, overlap)).alias("chunk_no", "_s"))
    return exploded.select(*kk, "chunk_no",
                           F.substring(F.col("_t"), F.col("_s") + 1, F.lit(size)).alias("content"))


def document_head(pages: DataFrame, n: int = HEAD_PAGES, doc_col: str = "source",
                  page_col: str = "page", text_col: str = "text") -> DataFrame:
    """Concatenated text of the first ``n`` pages of every document.

    ``status`` is ``'no_text'`` when that text is blank.  Pages are ordered
    by number inside the aggregate, so no global sort is needed.
    """
    first = pages.where(F.col(page_col) < n)
    parts = F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("p"), F.col(text_col).alias("t"))))
    head = first.groupBy(doc_col).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("head"))
    blank = F.length(F.trim(F.regexp_replace("head", r"\s+", " "))) == 0
    return head.withColumn("status", F.when(blank, F.lit(NO_TEXT_STATUS)).otherwise(F.lit("ok")))


def lookup_sectors(companies: DataFrame, dim: DataFrame, company_col: str = "company_name") -> DataFrame:
    """Company -> sorted distinct sectors from a local dimension.

    ``dim(company_name, sector)``.  Unresolved ids (``Q123``) and blanks are
    dropped; companies without any sector get an empty array.
    """
    good = dim.where(F.col("sector").isNotNull() & (F.length(F.trim("sector")) > 0)
                     & ~F.col("sector").rlike(UNRESOLVED_ID))
    sectors = good.groupBy(company_col).agg(F.array_sort(F.collect_set("sector")).alias("company_sectors"))
    return (companies.select(company_col).distinct()
            .join(sectors, company_col, "left")
            .select(company_col, F.coalesce("company_sectors", F.array().cast("array<string>"))
                    .alias("company_sectors")))


def chunk_packed(pages: DataFrame, size: int = DEFAULT_CHUNK_SIZE, overlap: int = DEFAULT_CHUNK_OVERLAP,
                 text_col: str = "text", key_cols=("source", "page")) -> DataFrame:
    """Recursive separator splitting with greedy packing, per document (see ``functions.packing``).

    Built-in functions only, no shuffle; a null or blank text has no chunk.
    """
    kk = list(key_cols)
    return pages.select(*kk, F.posexplode(packed_chunks(F.col(text_col), size, overlap)).alias("chunk_no", "content"))


def chunk_with_errors(pages: DataFrame, text_col: str = "text", key_cols=("source", "page"),
                      error_col: str = "error", **kw) -> tuple[DataFrame, DataFrame]:
    """Documents that failed upstream (non-null ``error``) or have no text yield
    no chunks; they are returned as a side output with their reason, the job goes on."""
    kk = list(key_cols)
    err = F.col(error_col) if error_col in pages.columns else F.lit(None).cast("string")
    reason = (F.when(err.isNotNull(), err)
              .when(F.col(text_col).isNull() | (F.length(F.trim(F.col(text_col))) == 0), F.lit("no text")))
    tagged = pages.withColumn("_reason", reason)
    ok = chunk_fixed(tagged.where(F.col("_reason").isNull()), text_col=text_col, key_cols=kk, **kw)
    failed = tagged.where(F.col("_reason").isNotNull()).select(*kk, F.col("_reason").alias("reason"))
    return ok, failed

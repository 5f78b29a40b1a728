"""Registered ingest, catalog, store-scan and filter queries (I, G, S, F, K4/K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.packing import WHITE
from tabloom.functions.text import clean_key, company_from_source, title_from_source
from tabloom.operators import catalog, ingest
from tabloom.operators.filters import apply_filters
from tabloom.plans import sql_frags as S
from tabloom.plans.registry import register
from tabloom.sources import driver

FILTERS = (("lang", "fr"), ("source", "src7"))
SCAN_SOURCE = "src3"
TITLE_SECTORS = ("toxic", "de")
CHUNK_SECTORS = ("toxic",)
VECTOR_SECTORS = ("hq", "toxic")

SQL_COMPANY = r"regexp_replace(string_split({x}, '-')[-1], '\.[^./]*$', '')"
SQL_TITLE = r"regexp_replace(string_split({x}, '/')[-1], '\.[^.]*$', '')"
SQL_CLEAN_KEY = (r"CASE WHEN {x} IS NULL OR length(trim({x})) = 0 THEN 'UNKNOWN' "
                 r"ELSE regexp_replace(trim({x}), '[^\p{{L}}\p{{N}}_-]', '_', 'g') END")

SQL_CHUNK_ROWS = S.CHUNKS + """,
ids AS (SELECT *, 'tf_idf' AS model_name,
               """ + SQL_COMPANY.format(x="source") + """ AS company_name,
               """ + SQL_TITLE.format(x="source") + """ AS title
        FROM chunks),
hashed AS (SELECT sha256(concat_ws(chr(31), coalesce(content, ''), coalesce(source, ''),
                                   coalesce(page::VARCHAR, ''), model_name, coalesce(company_name, ''),
                                   coalesce(array_to_string(company_sectors, ','), ''))) AS chunk_id, *
           FROM ids)"""


def _base_chunks(spark, sf_dir, docs=None):
    docs = docs if docs is not None else driver.table(spark, sf_dir, "documents")
    labels = driver.table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "source", F.col("doc_id").alias("page"), F.col("text").alias("content"), "lang",
        driver.sectors_col().alias("company_sectors"))


def enriched_chunks(spark, sf_dir, docs=None):
    base = _base_chunks(spark, sf_dir, docs)
    dim = base.select("source").distinct().select(
        "source", company_from_source("source").alias("company_name"),
        F.array().cast("array<string>").alias("company_sectors"))
    out = ingest.enrich(base, driver.MODEL_NAME, dim)
    return ingest.with_chunk_id(ingest.with_title(out))


@register("enrich_chunks", "WITH " + SQL_CHUNK_ROWS + """
SELECT chunk_id, title, source, page, model_name, company_name,
       array_to_string(company_sectors, ',') AS sectors FROM hashed""")
def q_enrich_chunks(spark, sf_dir):
    c = enriched_chunks(spark, sf_dir)
    return c.select("chunk_id", "title", "source", "page", "model_name", "company_name",
                    F.array_join("company_sectors", ",").alias("sectors"))


def _batch_and_store(spark, sf_dir):
    c = enriched_chunks(spark, sf_dir)
    store = c.where(F.col("lang") == "en")
    # The batch re-sends every chunk and repeats the French ones (in-batch duplicates).
    batch = c.unionByName(c.where(F.col("lang") == "fr"))
    return batch, store


@register("ingest_new_chunks", "WITH " + SQL_CHUNK_ROWS + """
SELECT DISTINCT chunk_id, source, page FROM hashed
WHERE chunk_id NOT IN (SELECT chunk_id FROM hashed WHERE lang = 'en')""")
def q_ingest_new_chunks(spark, sf_dir):
    batch, store = _batch_and_store(spark, sf_dir)
    new, _ = ingest.split_new(batch, store)
    return new.select("chunk_id", "source", "page")


@register("ingest_skipped_pages", "WITH " + SQL_CHUNK_ROWS + """
SELECT DISTINCT source, page FROM hashed WHERE lang = 'en'""")
def q_ingest_skipped_pages(spark, sf_dir):
    batch, store = _batch_and_store(spark, sf_dir)
    _, skipped = ingest.split_new(batch, store)
    return skipped


@register("delete_chunks_by_id", "WITH " + SQL_CHUNK_ROWS + """
SELECT chunk_id, source, page FROM hashed
WHERE page NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_delete_chunks_by_id(spark, sf_dir):
    c = enriched_chunks(spark, sf_dir)
    toxic = driver.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select(F.col("doc_id").alias("page"))
    ids = c.join(toxic, "page", "left_semi").select("chunk_id")
    return ingest.delete_chunks(c, ids).select("chunk_id", "source", "page")


@register("chunk_fixed_windows", f"""
WITH d AS (SELECT source, doc_id AS page, text, length(text) AS n FROM documents
           WHERE text IS NOT NULL AND length(text) > 0),
s AS (SELECT source, page, text,
             unnest(range(0, (1 + ceil(greatest(n - 4000, 0) / 3800.0)::BIGINT) * 3800, 3800)) AS st
      FROM d)
SELECT source, page, (st // 3800)::INTEGER AS chunk_no, substring(text, st + 1, 4000) AS content FROM s""")
def q_chunk_fixed_windows(spark, sf_dir):
    docs = driver.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return ingest.chunk_fixed(docs, ingest.DEFAULT_CHUNK_SIZE, ingest.DEFAULT_CHUNK_OVERLAP)


@register("document_head", """
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS head,
       CASE WHEN length(trim(regexp_replace(string_agg(text, '' ORDER BY turn), '\\s+', ' ', 'g'))) = 0
            THEN 'no_text' ELSE 'ok' END AS status
FROM conversations WHERE turn < 4 GROUP BY conv_id""")
def q_document_head(spark, sf_dir):
    conv = driver.table(spark, sf_dir, "conversations")
    return ingest.document_head(conv, 4, doc_col="conv_id", page_col="turn", text_col="text")


@register("list_titles", "WITH " + SQL_CHUNK_ROWS + " SELECT DISTINCT title FROM hashed")
def q_list_titles(spark, sf_dir):
    return catalog.list_titles(enriched_chunks(spark, sf_dir))


@register("list_sectors", "WITH " + S.CHUNKS + """
SELECT DISTINCT sector FROM (SELECT unnest(company_sectors) AS sector FROM chunks
                             WHERE company_sectors IS NOT NULL)
WHERE sector IS NOT NULL AND length(sector) > 0""")
def q_list_sectors(spark, sf_dir):
    return catalog.list_sectors(driver.chunks(spark, sf_dir))


@register("titles_in_sectors", "WITH " + SQL_CHUNK_ROWS + f"""
SELECT DISTINCT title FROM hashed WHERE list_has_any(company_sectors, {list(TITLE_SECTORS)})""")
def q_titles_in_sectors(spark, sf_dir):
    return catalog.titles_in_sectors(enriched_chunks(spark, sf_dir), TITLE_SECTORS)


@register("chunks_by_source", "WITH " + SQL_CHUNK_ROWS + f"""
SELECT source, page, content, model_name, company_name,
       array_to_string(company_sectors, ',') AS sectors
FROM hashed WHERE source = '{SCAN_SOURCE}'""")
def q_chunks_by_source(spark, sf_dir):
    c = catalog.chunks_by_source(enriched_chunks(spark, sf_dir), SCAN_SOURCE)
    return c.withColumn("sectors", F.array_join("company_sectors", ",")).drop("company_sectors")


@register("chunks_by_sectors", "WITH " + S.CHUNKS + f"""
SELECT source, page, lower(content) AS content_lc FROM chunks
WHERE list_has_any(company_sectors, {list(CHUNK_SECTORS)})""")
def q_chunks_by_sectors(spark, sf_dir):
    c = ingest.with_lower(catalog.chunks_by_sectors(driver.chunks(spark, sf_dir), CHUNK_SECTORS))
    return c.select("source", "page", "content_lc")


@register("vectors_by_sectors", "WITH " + S.CHUNKS + ", " + S.VECS + f"""
SELECT source, page, label, len(embedding) AS dim FROM vecs
WHERE list_has_any(company_sectors, {list(VECTOR_SECTORS)})""")
def q_vectors_by_sectors(spark, sf_dir):
    v = driver.vectors(spark, sf_dir)
    v = v.withColumn("cmetadata", F.to_json(F.struct("source", "page", "company_name", "company_sectors")))
    hit = catalog.vectors_by_sectors(v, VECTOR_SECTORS)
    return hit.select("source", "page", "label", F.size("embedding").cast("long").alias("dim"))


@register("filter_equalities", "WITH " + S.CHUNKS + """
SELECT source, page, lang FROM chunks WHERE lang = 'fr' AND source = 'src7'""")
def q_filter_equalities(spark, sf_dir):
    return apply_filters(driver.chunks(spark, sf_dir), FILTERS).select("source", "page", "lang")


@register("company_sector_lookup", "WITH " + S.CHUNKS + """,
dim AS (SELECT source AS company_name, unnest(company_sectors) AS sector FROM chunks
        UNION ALL SELECT source, 'Q' || page::VARCHAR FROM chunks WHERE lang = 'es'
        UNION ALL SELECT source, '' FROM chunks WHERE lang = 'de'),
good AS (SELECT company_name, sector FROM dim
         WHERE sector IS NOT NULL AND length(trim(sector)) > 0 AND NOT regexp_matches(sector, '^Q\\d+$'))
SELECT c.company_name, coalesce(array_to_string(list_sort(list_distinct(list(g.sector))), ','), '') AS sectors
FROM (SELECT DISTINCT source AS company_name FROM chunks) c LEFT JOIN good g USING (company_name)
GROUP BY c.company_name""")
def q_company_sector_lookup(spark, sf_dir):
    c = driver.chunks(spark, sf_dir)
    dim = (c.select(F.col("source").alias("company_name"), F.explode("company_sectors").alias("sector"))
           .unionByName(c.where(F.col("lang") == "es").select(
               F.col("source").alias("company_name"), F.concat(F.lit("Q"), F.col("page").cast("string")).alias("sector")))
           .unionByName(c.where(F.col("lang") == "de").select(
               F.col("source").alias("company_name"), F.lit("").alias("sector"))))
    companies = c.select(F.col("source").alias("company_name"))
    out = ingest.lookup_sectors(companies, dim)
    return out.select("company_name", F.array_join("company_sectors", ",").alias("sectors"))


@register("source_names", """
SELECT page_id, """ + SQL_TITLE.format(x="url") + """ AS title,
       """ + SQL_COMPANY.format(x="url") + """ AS company,
       """ + SQL_CLEAN_KEY.format(x="regexp_extract(html, '<title>(.*?)</title>', 1)") + """ AS company_key
FROM pages""")
def q_source_names(spark, sf_dir):
    p = driver.table(spark, sf_dir, "pages")
    name = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return p.select("page_id", title_from_source("url").alias("title"),
                    company_from_source("url").alias("company"), clean_key(name).alias("company_key"))


def documents_glob(sf_dir):
    """Stream source of the documents, one file or a folder of files (a file stream takes a single file only as a pattern)."""
    return f"{sf_dir.rstrip('/')}/documents.parque[t]"


@register("ingest_stream_store", "WITH " + SQL_CHUNK_ROWS + " SELECT DISTINCT chunk_id, source, page FROM hashed")
def q_ingest_stream_store(spark, sf_dir):
    """Stream the documents file into a fresh store twice (second run = replay)."""
    import uuid

    from tabloom.session import scratch_path
    from tabloom.streaming.ingest_stream import ingest_stream

    run = uuid.uuid4().hex[:12]
    store = scratch_path(spark, f"store-{run}")
    schema = driver.table(spark, sf_dir, "documents").schema

    def to_chunks(batch):
        return enriched_chunks(spark, sf_dir, batch).select("chunk_id", "title", "source", "page", "content",
                                                           "model_name", "company_name", "company_sectors")

    for attempt in ("a", "b"):
        q = ingest_stream(spark, documents_glob(sf_dir), schema, store, scratch_path(spark, f"ckpt-{run}-{attempt}"),
                          to_chunks)
        q.awaitTermination()
    return spark.read.parquet(store).select("chunk_id", "source", "page")


@register("ingest_both_stores", "WITH " + SQL_CHUNK_ROWS + """
SELECT DISTINCT 'chunks' AS store, chunk_id, source, page FROM hashed
UNION ALL
SELECT DISTINCT 'vectors', chunk_id, source, page FROM hashed JOIN embeddings ON vec_id = page WHERE embedding IS NOT NULL""")
def q_ingest_both_stores(spark, sf_dir):
    """The documents file streamed into fresh sparse and dense stores, twice (second run = replay)."""
    import uuid

    from tabloom.session import scratch_path
    from tabloom.streaming.ingest_stream import ingest_both_stream

    run = uuid.uuid4().hex[:12]
    stores = {name: scratch_path(spark, f"{name}-{run}") for name in ("chunks", "vectors")}
    emb = driver.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), "embedding")

    def to_chunks(batch):
        return enriched_chunks(spark, sf_dir, batch).select("chunk_id", "title", "source", "page", "content",
                                                           "model_name", "company_name", "company_sectors")

    def to_vectors(batch):
        return enriched_chunks(spark, sf_dir, batch).join(emb, "page").select(
            "chunk_id", "source", "page", "content", "company_name", "company_sectors", "embedding")

    for attempt in ("a", "b"):
        q = ingest_both_stream(spark, documents_glob(sf_dir), driver.table(spark, sf_dir, "documents").schema, stores["chunks"], stores["vectors"],
                               scratch_path(spark, f"ckpt-both-{run}-{attempt}"), to_chunks, to_vectors)
        q.awaitTermination()
    out = [spark.read.parquet(path).select(F.lit(name).alias("store"), "chunk_id", "source", "page") for name, path in stores.items()]
    return out[0].unionByName(out[1])


@register("store_gaps", "WITH " + SQL_CHUNK_ROWS + """,
vecs AS (SELECT chunk_id, source, page FROM hashed JOIN embeddings ON vec_id = page WHERE embedding IS NOT NULL),
held AS (SELECT DISTINCT 'chunks' AS store, chunk_id, source, page FROM hashed WHERE lang <> 'fr'
         UNION ALL SELECT DISTINCT 'vectors', chunk_id, source, page FROM vecs)
SELECT chunk_id, source, page, CASE WHEN min(store) = 'chunks' THEN 'vectors' ELSE 'chunks' END AS missing
FROM held GROUP BY chunk_id, source, page HAVING count(*) = 1""")
def q_store_gaps(spark, sf_dir):
    """Ids that one store lacks, between a sparse store without the French chunks and the full dense store."""
    from tabloom.streaming.ingest_stream import store_gaps

    c = enriched_chunks(spark, sf_dir)
    emb = driver.table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select(F.col("vec_id").alias("page"))
    return store_gaps(c.where("lang <> 'fr'"), c.join(emb, "page"))


def _sql_level(n: int, sep: str) -> str:
    """Pieces of the texts of ``lvl{n}`` at one separator, and the longer ones as ``lvl{n + 1}``."""
    return f"""
cut{n} AS (SELECT page, pos, unnest(ps) AS p, unnest(range(1, len(ps) + 1)) AS i
           FROM (SELECT page, pos, string_split(x, {sep}) AS ps FROM lvl{n})),
piece{n} AS (SELECT page, {n} AS lvl, pos AS parent, x,
                    pos + sum(length(x)) OVER up - length(x) AS s, pos + sum(length(x)) OVER up AS e,
                    sum((length(x) >= {ingest.DEFAULT_CHUNK_SIZE})::INT) OVER up AS run
             FROM (SELECT page, pos, i, CASE WHEN i > 1 THEN {sep} || p ELSE p END AS x FROM cut{n}) WHERE x <> ''
             WINDOW up AS (PARTITION BY page, pos ORDER BY i)),
lvl{n + 1} AS (SELECT page, s AS pos, x FROM piece{n} WHERE length(x) >= {ingest.DEFAULT_CHUNK_SIZE})"""


#: Every piece knows where a chunk that starts with it ends, and where the chunk behind one that ends before it starts;
#: chunks are a chain of such hops.
SQL_PACKED = """
WITH RECURSIVE lvl0 AS (SELECT doc_id AS page, 0::HUGEINT AS pos, text AS x FROM documents WHERE text IS NOT NULL),""" + ",".join(
    _sql_level(n, sep) for n, sep in enumerate(("chr(10) || chr(10)", "chr(10)", "' '"))) + f""",
letters AS (SELECT page, 3 AS lvl, pos AS parent, pos + unnest(range(0, length(x))) AS s FROM lvl3),
good AS (SELECT page, lvl, parent, run, s, e FROM piece0 WHERE e - s < {{size}}
         UNION ALL SELECT page, lvl, parent, run, s, e FROM piece1 WHERE e - s < {{size}}
         UNION ALL SELECT page, lvl, parent, run, s, e FROM piece2 WHERE e - s < {{size}}
         UNION ALL SELECT page, lvl, parent, 0, s, s + 1 FROM letters),
hop AS MATERIALIZED (SELECT page, lvl, parent, run, s::BIGINT AS s, s = min(s) OVER (PARTITION BY page, lvl, parent, run) AS is_first,
               max(e::BIGINT) OVER (PARTITION BY page, lvl, parent, run ORDER BY e::BIGINT
                            RANGE BETWEEN CURRENT ROW AND ({{size}} - (e - s))::BIGINT FOLLOWING) AS stop,
               min(s::BIGINT) OVER (PARTITION BY page, lvl, parent, run ORDER BY s::BIGINT
                            RANGE BETWEEN least({{overlap}}, {{size}} - (e - s))::BIGINT PRECEDING AND CURRENT ROW) AS back
        FROM good),
chain AS (SELECT page, lvl, parent, run, s, stop FROM hop WHERE is_first
          UNION ALL
          SELECT c.page, c.lvl, c.parent, c.run, b.s, b.stop FROM chain c
          JOIN hop n ON n.page = c.page AND n.lvl = c.lvl AND n.parent = c.parent AND n.run = c.run AND n.s = c.stop
          JOIN hop b ON b.page = c.page AND b.lvl = c.lvl AND b.parent = c.parent AND b.run = c.run AND b.s = n.back),
texts AS (SELECT d.source, c.page, c.s, trim(substring(d.text, c.s + 1, c.stop - c.s), {{white}}) AS content
          FROM chain c JOIN documents d ON d.doc_id = c.page)
SELECT source, page, (row_number() OVER (PARTITION BY page ORDER BY s) - 1)::INTEGER AS chunk_no, content
FROM texts WHERE content <> ''""".format(
    size=ingest.DEFAULT_CHUNK_SIZE, overlap=ingest.DEFAULT_CHUNK_OVERLAP, white=" || ".join(f"chr({ord(x)})" for x in WHITE))


@register("chunk_packed_windows", SQL_PACKED)
def q_chunk_packed_windows(spark, sf_dir):
    """I10 over every whole document."""
    docs = driver.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    return ingest.chunk_packed(docs)


@register("parse_embeddings", """
SELECT vec_id, len(embedding) AS dim,
       round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm
FROM embeddings WHERE embedding IS NOT NULL""")
def q_parse_embeddings(spark, sf_dir):
    """Embeddings arrive as JSON text; parse, drop nulls, report dimension and norm."""
    from tabloom.functions.vectors import norm, parse_embedding
    e = driver.table(spark, sf_dir, "embeddings").select("vec_id", F.to_json("embedding").alias("emb_text"))
    p = e.select("vec_id", parse_embedding("emb_text").alias("embedding")).where(F.col("embedding").isNotNull())
    return p.select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(norm("embedding"), 6).alias("norm"))


@register("list_tables", "WITH " + S.TABLE_INDEX + """
SELECT source, string_agg(page::VARCHAR || '_' || table_no::VARCHAR, ',' ORDER BY page, table_no) AS tables,
       min_by(page::VARCHAR || '_' || table_no::VARCHAR, page * 100000 + table_no) AS default_table
FROM ti GROUP BY source""")
def q_list_tables(spark, sf_dir):
    """Per document its tables (page_table names in order) and the default (first) one."""
    t = catalog.list_tables(driver.table_index(spark, sf_dir))
    return t.select("source", F.array_join("tables", ",").alias("tables"), "default_table")


@register("list_table_sets", "WITH " + S.TABLE_INDEX + " SELECT DISTINCT source FROM ti")
def q_list_table_sets(spark, sf_dir):
    return catalog.list_table_sets(driver.table_index(spark, sf_dir))


@register("company_summaries", "WITH " + S.CHUNKS + """,
comp AS (SELECT source AS company_name FROM chunks UNION SELECT n_name FROM nation),
summ AS (SELECT source AS company_name, arg_min(content, page) AS summary FROM chunks GROUP BY source)
SELECT c.company_name, coalesce(s.summary, '') AS summary FROM comp c LEFT JOIN summ s USING (company_name)""")
def q_company_summaries(spark, sf_dir):
    """Every company (sources, and nations, which have no text) with its summary text, '' when it has none."""
    ch = driver.chunks(spark, sf_dir)
    companies = (ch.select(F.col("source").alias("company_name"))
                 .union(driver.table(spark, sf_dir, "nation").select("n_name")).distinct())
    summaries = (ch.groupBy(F.col("source").alias("company_name"))
                 .agg(F.min_by("content", "page").alias("summary")))
    return catalog.with_summaries(companies, summaries)


@register("table_count_by_sector", "WITH " + S.CHUNKS + ", " + S.TABLE_INDEX + """
SELECT s.sector, count(DISTINCT ti.source || '/' || ti.page::VARCHAR || '/' || ti.table_no::VARCHAR) AS n_tables
FROM ti JOIN (SELECT source, page, unnest(company_sectors) AS sector FROM chunks) s USING (source, page)
GROUP BY s.sector""")
def q_table_count_by_sector(spark, sf_dir):
    """Number of distinct tables per sector (a page's sectors are its document's)."""
    sect = driver.chunks(spark, sf_dir).select("source", "page", F.explode("company_sectors").alias("sector"))
    t = driver.table_index(spark, sf_dir).join(sect, ["source", "page"])
    return catalog.table_count(t, ["sector"])


@register("chunk_errors", """
SELECT source, doc_id AS page, 'no text' AS reason FROM documents
WHERE text IS NULL OR length(trim(text)) = 0""")
def q_chunk_errors(spark, sf_dir):
    """Documents that yield no chunk, with the reason (side output of chunking)."""
    docs = driver.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    _, failed = ingest.chunk_with_errors(docs)
    return failed

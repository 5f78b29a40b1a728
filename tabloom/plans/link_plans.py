"""Registered linking queries.

Codes are the benchmark items ('B' || item_id, description = text); the
hits of a code in a document are its hybrid top-5 pages there; tables are
the lineitem tables (one per order) of those pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import link as L
from tabloom.plans import sql_frags as S
from tabloom.plans.registry import register
from tabloom.plans.retrieval_plans import (HYBRID_SECTORS_CTES, HYBRID_SOURCE_CTES, SECTOR_SELECTION,
                                           dense_by_source, hybrid_by_sectors, hybrid_by_source)
from tabloom.session import checkpoint_dir
from tabloom.sources import driver

KEY = ["source", "page", "table_no"]
RETIRED = "old-"            # prefix of codes that the dictionary does not have


def _as_code(df):
    return df.withColumn("code", F.concat(F.lit("B"), F.col("query_id").cast("string")))


def tables(spark, sf_dir):
    return driver.table_index(spark, sf_dir).select(*KEY, "o_orderkey")


def refs_before(spark, sf_dir, hits=None):
    """Table references of every code, computed once: a reliable checkpoint that all branches of a query read."""
    checkpoint_dir(spark)
    hits = _as_code(hits if hits is not None else hybrid_by_source(spark, sf_dir))
    return L.link_codes(driver.codes(spark, sf_dir), hits, tables(spark, sf_dir)).checkpoint()


def verdicts(spark, sf_dir, refs):
    o = driver.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    t = tables(spark, sf_dir).join(o, "o_orderkey")
    v = (F.when(F.col("o_orderstatus") == "F", F.lit("NO"))
         .when(F.col("o_orderstatus") == "O", F.lit(" yes")))
    return refs.join(t, KEY).select("source", "code", "page", "table_no", v.alias("verdict"))


def refs_after(spark, sf_dir, hits=None):
    before = refs_before(spark, sf_dir, hits)
    return L.prune_refs(before, verdicts(spark, sf_dir, before), tables(spark, sf_dir))


def _out(df):
    return df.select("source", "code", F.col("page").cast("long"), "table_no", F.col("ordinal").cast("long"))


SQL_REFS = HYBRID_SOURCE_CTES + ",\n" + S.TABLE_INDEX + """,
hits AS (SELECT 'B' || query_id::VARCHAR AS code, source, page, rank FROM hy_top),
found AS (SELECT h.code, h.source, h.page, ti.table_no,
                 row_number() OVER (PARTITION BY h.source, h.code ORDER BY h.rank, h.page, ti.table_no) - 1 AS ordinal
          FROM hits h JOIN ti ON ti.source = h.source AND ti.page = h.page),
pairs AS (SELECT DISTINCT code, source FROM hits),
refs AS (SELECT p.source, p.code, f.page, f.table_no, f.ordinal FROM pairs p LEFT JOIN found f USING (code, source)),
verd AS (SELECT r.source, r.code, r.page, r.table_no,
                CASE o.o_orderstatus WHEN 'F' THEN 'NO' WHEN 'O' THEN ' yes' END AS verdict
         FROM refs r JOIN ti USING (source, page, table_no) JOIN orders o ON o.o_orderkey = ti.o_orderkey),
kept AS (SELECT r.* FROM refs r JOIN verd v USING (source, code, page, table_no)
         WHERE coalesce(upper(trim(v.verdict)), 'YES') = 'YES')"""


@register("link_codes", "WITH " + SQL_REFS + " SELECT * FROM refs")
def q_link_codes(spark, sf_dir):
    return _out(refs_before(spark, sf_dir))


@register("prune_refs", "WITH " + SQL_REFS + " SELECT * FROM kept")
def q_prune_refs(spark, sf_dir):
    return _out(refs_after(spark, sf_dir))


@register("refs_stats", "WITH " + SQL_REFS + """,
st AS (SELECT source, 'before' AS stage, page, table_no, code FROM refs WHERE page IS NOT NULL
       UNION ALL SELECT source, 'after', page, table_no, code FROM kept)
SELECT source, stage, count(*) AS n_refs, count(DISTINCT page::VARCHAR || '_' || table_no::VARCHAR) AS n_tables,
       count(DISTINCT code) AS n_codes FROM st GROUP BY ALL""")
def q_refs_stats(spark, sf_dir):
    before = refs_before(spark, sf_dir)
    after = L.prune_refs(before, verdicts(spark, sf_dir, before), tables(spark, sf_dir))
    return L.refs_stats(before, "before").unionByName(L.refs_stats(after, "after"))


@register("orphan_pages", "WITH " + SQL_REFS + """
SELECT DISTINCT source, page FROM refs WHERE page IS NOT NULL
EXCEPT SELECT source, page FROM kept""")
def q_orphan_pages(spark, sf_dir):
    before = refs_before(spark, sf_dir)
    after = L.prune_refs(before, verdicts(spark, sf_dir, before), tables(spark, sf_dir))
    pages = before.where(F.col("page").isNotNull()).select("source", F.col("page").cast("long")).distinct()
    return L.orphan_pages(pages, after)


@register("orphan_tables", "WITH " + SQL_REFS + """
SELECT DISTINCT source, page, table_no FROM refs WHERE page IS NOT NULL
EXCEPT SELECT source, page, table_no FROM kept""")
def q_orphan_tables(spark, sf_dir):
    before = refs_before(spark, sf_dir)
    after = L.prune_refs(before, verdicts(spark, sf_dir, before), tables(spark, sf_dir))
    return L.orphan_tables(before, after)


@register("hits_with_tables", "WITH " + SQL_REFS + """
SELECT code, source, page, rank FROM hits h
WHERE EXISTS (SELECT 1 FROM chunks c WHERE c.source = h.source AND c.page = h.page)
  AND EXISTS (SELECT 1 FROM kept k WHERE k.source = h.source AND k.page = h.page)""")
def q_hits_with_tables(spark, sf_dir):
    checkpoint_dir(spark)
    found = hybrid_by_source(spark, sf_dir).checkpoint()
    hits = _as_code(found).select("code", "source", "page", F.col("rank").cast("long"))
    pages = driver.chunks(spark, sf_dir).select("source", "page")
    return L.hits_with_tables(hits, pages, refs_after(spark, sf_dir, found))


@register("with_description", "WITH " + SQL_REFS + f"""
SELECT k.source, k.code, k.page, k.table_no, coalesce(b.text, 'Description not found') AS description
FROM (SELECT source, code, page, table_no FROM kept
      UNION ALL SELECT source, '{RETIRED}' || code, page, table_no FROM kept) k
LEFT JOIN benchmark b ON 'B' || b.item_id::VARCHAR = k.code""")
def q_with_description(spark, sf_dir):
    kept = refs_after(spark, sf_dir).select("source", "code", F.col("page").cast("long"), "table_no")
    retired = kept.withColumn("code", F.concat(F.lit(RETIRED), F.col("code")))
    return L.with_description(kept.unionByName(retired), driver.codes(spark, sf_dir)).select(
        "source", "code", "page", "table_no", "description")


SQL_DENSE_REFS = """,
dhits AS (SELECT 'B' || query_id::VARCHAR AS code, source, page, rank FROM dn_top),
dfound AS (SELECT h.code, h.source, h.page, ti.table_no,
                  row_number() OVER (PARTITION BY h.source, h.code ORDER BY h.rank, h.page, ti.table_no) - 1 AS ordinal
           FROM dhits h JOIN ti ON ti.source = h.source AND ti.page = h.page)"""


@register("dedupe_refs", "WITH " + SQL_REFS + SQL_DENSE_REFS + """
SELECT source, code, page, table_no, min(ordinal) AS ordinal FROM (
  SELECT source, code, page, table_no, ordinal FROM refs WHERE page IS NOT NULL
  UNION ALL SELECT source, code, page, table_no, ordinal FROM dfound) GROUP BY ALL""")
def q_dedupe_refs(spark, sf_dir):
    both = refs_before(spark, sf_dir).unionByName(refs_before(spark, sf_dir, dense_by_source(spark, sf_dir)))
    return _out(L.dedupe_refs(both).select("source", "code", "page", "table_no", "ordinal"))


@register("dedupe_pages", "WITH " + SQL_REFS + """
SELECT source, page, min(ordinal) AS ordinal FROM refs WHERE page IS NOT NULL GROUP BY ALL""")
def q_dedupe_pages(spark, sf_dir):
    r = refs_before(spark, sf_dir).where(F.col("page").isNotNull())
    return L.dedupe_pages(r, ["source"]).select("source", F.col("page").cast("long"),
                                                  F.col("ordinal").cast("long"))


@register("merge_question_refs", "WITH " + SQL_REFS + SQL_DENSE_REFS + f""",
new AS (SELECT code AS question, source, page, table_no FROM dfound),
old AS (SELECT code AS question, source, page, table_no FROM refs
        UNION ALL SELECT '{RETIRED}' || code, source, page, table_no FROM refs)
SELECT * FROM old WHERE question NOT IN (SELECT question FROM new)
UNION ALL SELECT * FROM new""")
def q_merge_question_refs(spark, sf_dir):
    """K6, document form: a later answer replaces a question's stored references; questions that were not asked again keep theirs."""
    named = lambda r: r.select(F.col("code").alias("question"), "source", F.col("page").cast("long"), "table_no")
    asked = named(refs_before(spark, sf_dir))
    kept = asked.withColumn("question", F.concat(F.lit(RETIRED), F.col("question")))
    new = refs_before(spark, sf_dir, dense_by_source(spark, sf_dir)).where(F.col("page").isNotNull())
    return L.merge_question_refs(asked.unionByName(kept), named(new), "replace")


@register("extend_question_refs", "WITH " + SQL_REFS + SQL_DENSE_REFS + """
SELECT code AS question, source, page, table_no FROM refs
UNION ALL SELECT code, source, page, table_no FROM dfound""")
def q_extend_question_refs(spark, sf_dir):
    """K6, sector form: the references of a later answer are added to the stored ones."""
    named = lambda r: r.select(F.col("code").alias("question"), "source", F.col("page").cast("long"), "table_no")
    new = refs_before(spark, sf_dir, dense_by_source(spark, sf_dir)).where(F.col("page").isNotNull())
    return L.merge_question_refs(named(refs_before(spark, sf_dir)), named(new), "extend")


@register("pending_tables", "WITH " + SQL_REFS + """
SELECT source, page, table_no FROM ti EXCEPT SELECT source, page, table_no FROM kept""")
def q_pending_tables(spark, sf_dir):
    return L.pending_tables(tables(spark, sf_dir), refs_after(spark, sf_dir))


@register("noise_tables", "WITH " + SQL_REFS + """,
tg AS (SELECT DISTINCT code || ':' || page::VARCHAR || '_' || table_no::VARCHAR AS target_id, source, page, table_no
       FROM kept),
fst AS (SELECT source, page AS noise_page, table_no AS noise_table_no,
               row_number() OVER (PARTITION BY source ORDER BY page, table_no) AS r FROM ti QUALIFY r <= 3),
cand AS (SELECT t.target_id, t.source, f.noise_page, f.noise_table_no, f.r FROM tg t JOIN fst f USING (source)
         WHERE f.noise_page <> t.page OR f.noise_table_no <> t.table_no)
SELECT target_id, source, noise_page, noise_table_no,
       row_number() OVER (PARTITION BY target_id ORDER BY r) AS noise_rank FROM cand QUALIFY noise_rank <= 2""")
def q_noise_tables(spark, sf_dir):
    kept = refs_after(spark, sf_dir)
    tg = kept.select(F.concat_ws("", "code", F.lit(":"), F.col("page").cast("string"), F.lit("_"),
                                 F.col("table_no").cast("string")).alias("target_id"), *KEY).distinct()
    out = L.add_noise_tables(tg, tables(spark, sf_dir))
    return out.select("target_id", "source", F.col("noise_page").cast("long"), "noise_table_no",
                      F.col("noise_rank").cast("long"))


@register("group_hits", "WITH " + HYBRID_SECTORS_CTES + ",\n" + S.TABLE_INDEX + f""",
hs AS (SELECT DISTINCT s.sector, h.source, h.page FROM hy_top h
       JOIN (SELECT source, page, unnest(company_sectors) AS sector FROM chunks) s USING (source, page)
       WHERE s.sector IN {tuple(SECTOR_SELECTION)}),
pp AS (SELECT hs.sector, hs.source, hs.page, string_agg(ti.table_no::VARCHAR, ',' ORDER BY ti.table_no) AS t
       FROM hs JOIN ti USING (source, page) GROUP BY ALL)
SELECT sector, source, string_agg(page::VARCHAR || ':[' || t || ']', ';' ORDER BY page) AS pages FROM pp GROUP BY ALL""")
def q_group_hits(spark, sf_dir):
    h = hybrid_by_sectors(spark, sf_dir)
    sect = driver.chunks(spark, sf_dir).select("source", "page", F.explode("company_sectors").alias("sector"))
    hs = h.join(sect, ["source", "page"]).where(F.col("sector").isin(*SECTOR_SELECTION))
    return L.group_hits(hs, tables(spark, sf_dir))


_ELEM_RE = (r"(?s)<ul\b[^>]*>.*?</ul>|<table\b[^>]*>.*?</table>|<h1\b[^>]*>.*?</h1>|<h2\b[^>]*>.*?</h2>"
            r"|<h3\b[^>]*>.*?</h3>|<p\b[^>]*>.*?</p>")
_STRIP = r"""trim(replace(replace(replace(replace(replace(replace(
    regexp_replace({x}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', ''''), '&amp;', '&'))"""
_UNSHOWN = r"(?is)<!--.*?-->|<head\b[^>]*>.*?</head>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
SQL_ELEMENTS = f"""shown AS (SELECT page_id, regexp_replace(html, '{_UNSHOWN}', '', 'g') AS html FROM pages),
el AS (
  SELECT page_id, TRUE AS named, unnest(regexp_extract_all(html, '{_ELEM_RE}')) AS h,
         2 * unnest(range(0, len(regexp_extract_all(html, '{_ELEM_RE}')))) + 1 AS place FROM shown
  UNION ALL
  SELECT page_id, FALSE, unnest(regexp_split_to_array(html, '{_ELEM_RE}')),
         2 * unnest(range(0, len(regexp_split_to_array(html, '{_ELEM_RE}')))) FROM shown),
elements AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY place) - 1)::INTEGER AS elem_idx,
                    CASE WHEN named AND regexp_extract(h, '^<([a-z0-9]+)', 1) IN ('ul', 'table') THEN 'Table' ELSE 'Text' END
                      AS category, regexp_replace({_STRIP.format(x="h")}, '^\\s+|\\s+$', '', 'g') AS text FROM el
             WHERE named OR regexp_matches({_STRIP.format(x="h")}, '\\S'))"""


def elements(spark, sf_dir):
    p = driver.table(spark, sf_dir, "pages").select(F.lit("web").alias("source"),
                                                    F.col("page_id").alias("page"), "html")
    return L.html_elements(p)


@register("number_tables", "WITH " + SQL_ELEMENTS + """
SELECT page_id, elem_idx, (row_number() OVER (PARTITION BY page_id ORDER BY elem_idx) - 1)::INTEGER AS table_no
FROM elements WHERE category = 'Table'""")
def q_number_tables(spark, sf_dir):
    return L.number_tables(elements(spark, sf_dir)).select(
        F.col("page").alias("page_id"), "elem_idx", "table_no")


PLACEHOLDER_CTES = SQL_ELEMENTS + """,
parts AS (SELECT page_id, elem_idx,
                 CASE WHEN category = 'Table'
                      THEN '[TABLEPLACEHOLDER ' || (sum(CASE WHEN category = 'Table' THEN 1 ELSE 0 END)
                           OVER (PARTITION BY page_id ORDER BY elem_idx) - 1)::VARCHAR || ']'
                      ELSE text END AS part FROM elements),
ph AS (SELECT page_id, string_agg(part, chr(10) ORDER BY elem_idx) AS text FROM parts
       WHERE part IS NOT NULL AND length(trim(part)) > 0 GROUP BY page_id)"""


@register("page_placeholders", "WITH " + PLACEHOLDER_CTES + " SELECT * FROM ph")
def q_page_placeholders(spark, sf_dir):
    return L.page_text_with_placeholders(elements(spark, sf_dir)).select(F.col("page").alias("page_id"), "text")


VERDICT_THRESHOLD = 0.05
VERDICT_PREVIEW_LINES = 30


def _default_verdict_refs(spark, sf_dir):
    from tabloom.operators import tables as T
    before = refs_before(spark, sf_dir)
    kept_tables = before.where(F.col("page").isNotNull()).select(*KEY).distinct()
    previews = T.table_preview(driver.cells(spark, sf_dir, only=kept_tables), n=VERDICT_PREVIEW_LINES)
    return before, L.default_verdicts(before, driver.codes(spark, sf_dir), previews, VERDICT_THRESHOLD)


_TOKS = r"[\p{L}\p{N}_]{2,}"
SQL_DEFAULT_VERDICTS = SQL_REFS + ",\n" + S.CELLS[len(S.TABLE_INDEX) + 2:] + f""",
kt AS (SELECT DISTINCT source, page, table_no FROM refs WHERE page IS NOT NULL),
kc AS (SELECT c.* FROM cells c JOIN kt USING (source, page, table_no)),
hl AS (SELECT source, page, table_no, -1 AS row_idx,
              string_agg(CASE WHEN strpos(h, ';') > 0 OR strpos(h, '"') > 0 OR strpos(h, chr(10)) > 0
                              THEN '"' || replace(h, '"', '""') || '"' ELSE h END, ';' ORDER BY col_idx) AS line
       FROM (SELECT source, page, table_no, col_idx, max(header) AS h FROM kc WHERE header IS NOT NULL GROUP BY ALL)
       GROUP BY ALL),
bl AS (SELECT source, page, table_no, row_idx,
              string_agg(CASE WHEN strpos(c, ';') > 0 OR strpos(c, '"') > 0 OR strpos(c, chr(10)) > 0
                              THEN '"' || replace(c, '"', '""') || '"' ELSE c END, ';' ORDER BY col_idx) AS line
       FROM (SELECT source, page, table_no, row_idx, col_idx, coalesce(cell, '') AS c FROM kc) GROUP BY ALL),
pv AS (SELECT source, page, table_no, string_agg(line, chr(10) ORDER BY row_idx) AS preview
       FROM (SELECT * FROM hl UNION ALL SELECT * FROM bl) WHERE row_idx < {VERDICT_PREVIEW_LINES} - 1 GROUP BY ALL),
pt AS (SELECT DISTINCT source, page, table_no, unnest(regexp_extract_all(lower(preview), '{_TOKS}')) AS term FROM pv),
pn AS (SELECT source, page, table_no, count(*) AS n_p FROM pt GROUP BY ALL),
ct AS (SELECT DISTINCT 'B' || item_id::VARCHAR AS code, unnest(regexp_extract_all(lower(text), '{_TOKS}')) AS term
       FROM benchmark),
cn AS (SELECT code, count(*) AS n_c FROM ct GROUP BY code),
vpairs AS (SELECT DISTINCT source, code, page, table_no FROM refs WHERE page IS NOT NULL),
sh AS (SELECT p.source, p.code, p.page, p.table_no, count(*) AS s FROM vpairs p JOIN ct USING (code)
       JOIN pt ON pt.source = p.source AND pt.page = p.page AND pt.table_no = p.table_no AND pt.term = ct.term
       GROUP BY ALL),
dv AS (SELECT p.source, p.code, p.page, p.table_no,
              CASE WHEN coalesce(coalesce(sh.s, 0) / sqrt(cn.n_c * pn.n_p), 0.0) >= {VERDICT_THRESHOLD}
                   THEN 'YES' ELSE 'NO' END AS verdict
       FROM vpairs p LEFT JOIN sh USING (source, code, page, table_no) LEFT JOIN cn USING (code)
       LEFT JOIN pn USING (source, page, table_no))"""


@register("default_verdicts", "WITH " + SQL_DEFAULT_VERDICTS + " SELECT * FROM dv")
def q_default_verdicts(spark, sf_dir):
    """L4 default: a (code, table) is relevant when the token-overlap cosine of the
    code description and the table preview reaches the threshold."""
    _, v = _default_verdict_refs(spark, sf_dir)
    return v.select("source", "code", F.col("page").cast("long"), "table_no", "verdict")


MISSING_PAGE = -1  # a reference to a table that does not exist, appended to every question


def qa_corpus(spark, sf_dir):
    """Questions with list-valued table references, from the kept links (plus one dangling ref)."""
    kept = refs_after(spark, sf_dir)
    per_q = kept.groupBy("code").agg(F.array_sort(F.collect_list(
        F.struct("source", "ordinal", "page", "table_no"))).alias("_r"))
    refs = F.transform("_r", lambda x: F.struct(x["source"].alias("source"), x["page"].cast("int").alias("page"),
                                               x["table_no"].alias("table_no")))
    dangling = F.array(F.struct(F.element_at("_r", 1)["source"].alias("source"),
                                F.lit(MISSING_PAGE).alias("page"), F.lit(0).alias("table_no")))
    return per_q.select(F.expr("cast(substring(code, 2) as bigint)").alias("qid"),
                        F.concat(refs, dangling).alias("refs"))


@register("qa_tables", "WITH " + SQL_REFS + f""",
r AS (SELECT TRY_CAST(substring(code, 2) AS BIGINT) AS qid, source, page::INTEGER AS page, table_no,
             row_number() OVER (PARTITION BY code ORDER BY source, ordinal, page, table_no) - 1 AS ref_no
      FROM kept),
d AS (SELECT qid, max(ref_no) + 1 AS ref_no, arg_min(source, source || lpad(ref_no::VARCHAR, 12, '0')) AS source,
             {MISSING_PAGE} AS page, 0 AS table_no FROM r GROUP BY qid),
u AS (SELECT qid, ref_no, source, page, table_no FROM r UNION ALL SELECT qid, ref_no, source, page, table_no FROM d)
SELECT u.qid, u.ref_no::INTEGER AS ref_no, u.source, u.page, u.table_no,
       NOT EXISTS (SELECT 1 FROM ti WHERE ti.source = u.source AND ti.page = u.page AND ti.table_no = u.table_no)
         AS missing
FROM u""")
def q_qa_tables(spark, sf_dir):
    """Explode each question's refs and attach the table; dangling refs are flagged."""
    return L.qa_tables(qa_corpus(spark, sf_dir), tables(spark, sf_dir).select(
        "source", F.col("page").cast("int").alias("page"), "table_no"))

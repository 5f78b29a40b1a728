"""Registered context-assembly and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.text import after_last, company_label, strip_markdown
from tabloom.operators import assembly as A
from tabloom.operators import context as X
from tabloom.operators import link as L
from tabloom.operators import tables as T
from tabloom.plans import sql_frags as S
from tabloom.plans.link_plans import PLACEHOLDER_CTES, SQL_REFS, elements, refs_after
from tabloom.plans.registry import register
from tabloom.plans.retrieval_plans import (HYBRID_SECTORS_CTES, HYBRID_SOURCE_CTES, SELECTION_NAME,
                                           hybrid_by_sectors, hybrid_by_source)
from tabloom.plans.table_plans import LIST_CELLS_CTES
from tabloom.sources import driver

KEY = ["source", "page", "table_no"]
TAIL_MARKER = "###"


def _q(x: str) -> str:
    """SQL: CSV-quote a field like ``csv_quote``."""
    return (f"CASE WHEN strpos({x}, ',') > 0 OR strpos({x}, '\"') > 0 OR strpos({x}, chr(10)) > 0 "
            f"THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE {x} END")


def _list_tables(spark, sf_dir):
    p = driver.table(spark, sf_dir, "pages")
    c = T.html_tables_to_cells(p, "html", ["page_id"], table_tag="ul", row_tag="li", cell_tags=("a",))
    return c.select(F.lit("web").alias("source"), F.col("page_id").alias("page"), "table_no", "row_idx",
                    "col_idx", F.lit(None).cast("string").alias("header"), "cell")


def _placeholder_pages(spark, sf_dir):
    return L.page_text_with_placeholders(elements(spark, sf_dir))


_LIST_TT = LIST_CELLS_CTES + """,
lines AS (SELECT page_id, table_no, row_idx, string_agg(""" + _q("coalesce(cell, '')") + """, ',' ORDER BY col_idx) AS line
          FROM lc GROUP BY ALL),
tt AS (SELECT page_id, table_no, string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS table_text
       FROM lines GROUP BY ALL)"""


@register("fill_placeholders", "WITH " + PLACEHOLDER_CTES + "," + _LIST_TT + r""",
sp AS (SELECT page_id, regexp_split_to_array(text, '\[TABLEPLACEHOLDER\s*\d+]') AS parts,
              regexp_extract_all(text, '\[TABLEPLACEHOLDER\s*(\d+)]', 1) AS nums FROM ph),
pc AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, parts, nums FROM sp),
pj AS (SELECT page_id, i, parts[i] AS part, TRY_CAST(nums[i] AS INTEGER) AS num FROM pc)
SELECT pj.page_id AS page, string_agg(pj.part || coalesce(chr(10) || '[Table from page ' || pj.page_id::VARCHAR
         || ', num ' || tt.table_no::VARCHAR || ']' || chr(10) || tt.table_text, ''), '' ORDER BY pj.i) AS text
FROM pj LEFT JOIN tt ON tt.page_id = pj.page_id AND tt.table_no = pj.num GROUP BY pj.page_id""")
def q_fill_placeholders(spark, sf_dir):
    csv = T.render_csv(_list_tables(spark, sf_dir), sep=",").select(
        "source", "page", "table_no", F.concat(F.col("csv"), F.lit("\n")).alias("table_text"))
    return X.fill_placeholders(_placeholder_pages(spark, sf_dir), csv).select("page", "text")


@register("insert_tables", "WITH " + PLACEHOLDER_CTES + "," + LIST_CELLS_CTES + r""",
rows_h AS (SELECT page_id, table_no, row_idx, '<tr>' || string_agg('<td>' ||
             replace(replace(replace(coalesce(cell, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', ''
             ORDER BY col_idx) || '</tr>' AS line FROM lc GROUP BY ALL),
th AS (SELECT page_id, table_no, '<table>' || string_agg(line, '' ORDER BY row_idx) || '</table>' AS html
       FROM rows_h GROUP BY ALL),
mk AS (SELECT page_id, regexp_replace(text, '\[TABLEPLACEHOLDER\s*(\d+)]', '<Table\1>', 'g') AS text FROM ph),
sp AS (SELECT page_id, regexp_split_to_array(text, '<Table\d+>') AS parts,
              regexp_extract_all(text, '<Table(\d+)>', 1) AS marks FROM mk),
pc AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, parts, marks FROM sp),
pj AS (SELECT page_id, i, parts[i] AS part, marks[i] AS mark FROM pc)
SELECT pj.page_id AS page, string_agg(pj.part || coalesce(th.html, '<Table' || pj.mark || '>', ''), '' ORDER BY pj.i)
  AS text
FROM pj LEFT JOIN th ON th.page_id = pj.page_id AND th.table_no = TRY_CAST(pj.mark AS INTEGER) GROUP BY pj.page_id""")
def q_insert_tables(spark, sf_dir):
    html = T.render_html(_list_tables(spark, sf_dir)).select("source", F.col("page"), F.col("table_no").alias("j"),
                                                             "html")
    ph = _placeholder_pages(spark, sf_dir)
    texts = ph.select("source", "page", F.regexp_replace("text", r"\[TABLEPLACEHOLDER\s*(\d+)]", "<Table$1>")
                      .alias("text"))
    return X.insert_tables(texts, html, ["source", "page"]).select("page", "text")


@register("build_context", "WITH " + HYBRID_SOURCE_CTES + """
SELECT h.query_id, h.source, 'Company name: ' || h.source || chr(10) || chr(10)
       || string_agg(chr(10) || '---' || chr(10) || '# Page ' || h.page::VARCHAR || chr(10) || coalesce(c.content, '') || chr(10), ''
                     ORDER BY h.rank, h.source, h.page) || chr(10) || '---' || chr(10) AS context
FROM hy_top h JOIN chunks c USING (source, page) GROUP BY h.query_id, h.source""")
def q_build_context(spark, sf_dir):
    hits = hybrid_by_source(spark, sf_dir).select("query_id", "source", "page", F.col("rank").alias("ordinal"))
    pages = driver.chunks(spark, sf_dir).select("source", "page", F.col("content").alias("text"))
    return X.build_context(pages, hits, ["query_id", "source"], "source", "document")


@register("build_sector_context", "WITH " + HYBRID_SECTORS_CTES + f"""
SELECT h.query_id, 'Sector: {SELECTION_NAME}' || chr(10) || chr(10)
       || string_agg(chr(10) || '---' || chr(10) || '# Source: ' || h.source || chr(10) || '# Page '
                     || h.page::VARCHAR || chr(10) || coalesce(c.content, '') || chr(10), '' ORDER BY h.rank, h.source, h.page)
       || chr(10) || '---' || chr(10) AS context
FROM hy_top h JOIN chunks c USING (source, page) GROUP BY h.query_id""")
def q_build_sector_context(spark, sf_dir):
    hits = hybrid_by_sectors(spark, sf_dir).select("query_id", "selection", "source", "page",
                                                   F.col("rank").alias("ordinal"))
    pages = driver.chunks(spark, sf_dir).select("source", "page", F.col("content").alias("text"))
    return X.build_context(pages, hits, ["query_id", "selection"], "selection", "sector").drop("selection")


_CELLS_NO_TI = S.CELLS[len(S.TABLE_INDEX) + 2:]
_KEPT_CSV = SQL_REFS + ",\n" + _CELLS_NO_TI + """,
kt AS (SELECT DISTINCT source, page, table_no FROM kept),
kc AS (SELECT c.* FROM cells c JOIN kt USING (source, page, table_no)),
hl AS (SELECT source, page, table_no, -1 AS row_idx, string_agg(""" + _q("h") + """, ',' ORDER BY col_idx) AS line
       FROM (SELECT source, page, table_no, col_idx, max(header) AS h FROM kc WHERE header IS NOT NULL GROUP BY ALL)
       GROUP BY ALL),
bl AS (SELECT source, page, table_no, row_idx, string_agg(""" + _q("coalesce(cell, '')") + """, ',' ORDER BY col_idx)
         AS line FROM kc GROUP BY ALL),
tcsv AS (SELECT source, page, table_no, string_agg(line, chr(10) ORDER BY row_idx) || chr(10) AS csv
         FROM (SELECT * FROM hl UNION ALL SELECT * FROM bl) GROUP BY ALL)"""


def _kept(spark, sf_dir, *cols):
    """Kept references of the given columns, a few per code and source: worked out once for all that read them."""
    return refs_after(spark, sf_dir).select(*cols, *KEY).distinct().checkpoint()


def _kept_cells(spark, sf_dir):
    kept = _kept(spark, sf_dir)
    return driver.cells(spark, sf_dir, only=kept)


@register("company_context", "WITH " + _KEPT_CSV + """
SELECT source, 'Company: ' || source || chr(10) || chr(10) || chr(10)
       || string_agg('# Page ' || page::VARCHAR || ', Table ' || table_no::VARCHAR || chr(10) || chr(10) || chr(10)
                     || csv, chr(10) || chr(10) ORDER BY page, table_no) || chr(10) || '---' || chr(10) AS context
FROM tcsv GROUP BY source""")
def q_company_context(spark, sf_dir):
    csv = T.render_csv(_kept_cells(spark, sf_dir), sep=",").withColumn("csv", F.concat("csv", F.lit("\n")))
    return X.company_context(csv)


@register("findings_report", "WITH " + SQL_REFS + """,
dr AS (SELECT source, code, page, table_no, min(ordinal) AS ordinal FROM kept GROUP BY ALL),
pc AS (SELECT source, code, string_agg('        [pag.' || (page + 1)::VARCHAR || '](http://localhost:8080/viewer.html?file='
                                       || url_encode(source) || '.pdf#page=' || (page + 1)::VARCHAR || ')   -> '
                                       || page::VARCHAR || '_' || table_no::VARCHAR || '.csv  ', chr(10)
                                       ORDER BY ordinal, page, table_no) AS links
       FROM dr GROUP BY ALL),
cl AS (SELECT pc.source, b.item_id AS co, '   🔹**GRI ' || pc.code || '**: ' || b.text || '  ' || chr(10) || pc.links AS x
       FROM pc JOIN benchmark b ON 'B' || b.item_id::VARCHAR = pc.code)
SELECT source, '📁**' || source || '** -- company name **' || source || '** ' || chr(10) || ' ' || chr(10)
       || string_agg(x, chr(10) ORDER BY co) AS report FROM cl GROUP BY source""")
def q_findings_report(spark, sf_dir):
    docs = driver.chunks(spark, sf_dir).select("source", "company_name").distinct()
    return X.findings_report(driver.codes(spark, sf_dir), refs_after(spark, sf_dir), docs)


_LISTED = SQL_REFS + ",\n" + _CELLS_NO_TI + """,
kc AS (SELECT DISTINCT k.code, c.* FROM kept k JOIN cells c USING (source, page, table_no)),
hr AS (SELECT code, source, page, table_no, '<tr>' || string_agg('<th>' ||
          replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</th>', '' ORDER BY col_idx)
          || '</tr>' AS line, -1 AS row_idx
       FROM (SELECT code, source, page, table_no, col_idx, max(header) AS h FROM kc WHERE header IS NOT NULL
             GROUP BY ALL) GROUP BY ALL),
br AS (SELECT code, source, page, table_no, '<tr>' || string_agg('<td>' ||
          replace(replace(replace(coalesce(cell, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', ''
          ORDER BY col_idx) || '</tr>' AS line, row_idx FROM kc GROUP BY code, source, page, table_no, row_idx),
th AS (SELECT code, source, page, table_no, '<table>' || string_agg(line, '' ORDER BY row_idx) || '</table>' AS html
       FROM (SELECT * FROM hr UNION ALL SELECT * FROM br) GROUP BY ALL)"""


@register("table_listing", "WITH " + _LISTED + """
SELECT code, source, regexp_replace('Company name: ' || source || chr(10) || chr(10)
       || string_agg(html || chr(10) || chr(10), '' ORDER BY page, table_no), '^\\s+|\\s+$', '', 'g') AS listing
FROM th GROUP BY code, source""")
def q_table_listing(spark, sf_dir):
    kept = _kept(spark, sf_dir, "code")
    html = T.render_html(driver.cells(spark, sf_dir, only=kept))
    return X.table_listing(kept.join(html, KEY), ["code", "source"])


@register("sector_table_listing", "WITH " + _LISTED + """,
cs AS (SELECT th.code, d.lang, th.source, 'Company name: ' || th.source || chr(10) || chr(10)
              || string_agg(html || chr(10) || chr(10), '' ORDER BY page, table_no) AS t
       FROM th JOIN documents d ON d.doc_id = th.page GROUP BY th.code, d.lang, th.source),
ss AS (SELECT code, lang, 'The company below are inside the following sector: ' || lang || chr(10) || chr(10)
              || string_agg(t, '' ORDER BY source) AS t FROM cs GROUP BY code, lang)
SELECT code, regexp_replace(string_agg(t, '' ORDER BY lang), '^\\s+|\\s+$', '', 'g') AS listing FROM ss GROUP BY code""")
def q_sector_table_listing(spark, sf_dir):
    """X5 (sector form): per code the kept tables of each company below its sector (here a language)."""
    kept = _kept(spark, sf_dir, "code")
    html = T.render_html(driver.cells(spark, sf_dir, only=kept))
    lang = driver.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("sector"))
    return X.table_listing(kept.join(html, KEY).join(lang, "page"), ["code"], "sector")


@register("context_status", "WITH " + SQL_REFS + """,
req AS (SELECT DISTINCT 'B' || b.item_id::VARCHAR AS code, c.source FROM benchmark b CROSS JOIN
        (SELECT DISTINCT source FROM chunks) c),
hv AS (SELECT DISTINCT code, source FROM kept)
SELECT r.code, r.source, CASE WHEN hv.code IS NOT NULL THEN 'ok'
       ELSE '⚠️ No references found for query ''' || r.code || ''' in ' || r.source || chr(10) END AS status
FROM req r LEFT JOIN hv USING (code, source)""")
def q_context_status(spark, sf_dir):
    codes = driver.codes(spark, sf_dir).select("code")
    sources = driver.chunks(spark, sf_dir).select("source").distinct()
    return X.context_status(codes.crossJoin(sources), refs_after(spark, sf_dir))


def _caption_sql(place: str, num: int) -> str:
    return (f"coalesce((SELECT chr(10) || '[Table from ' || {place} || 'page ' || c.page::VARCHAR || ', num {num}]' || chr(10) || 'order' || chr(10) "
            f"|| ti.o_orderkey::VARCHAR || chr(10) FROM ti WHERE ti.source = c.source AND ti.page = c.page AND ti.table_no = {num}), '')")


def _filled_sql(place: str) -> str:
    return f"coalesce(c.content, '') || chr(10) || {_caption_sql(place, 0)} || chr(10) || {_caption_sql(place, 1)} || chr(10)"


def _assembly_inputs(spark, sf_dir):
    pages = driver.chunks(spark, sf_dir).select("source", "page", F.concat(
        F.coalesce("content", F.lit("")), F.lit("\n[TABLEPLACEHOLDER 0]\n[TABLEPLACEHOLDER 1]\n[TABLEPLACEHOLDER 99]")).alias("text"))
    tables = driver.table_index(spark, sf_dir).select("source", "page", "table_no", F.concat(
        F.lit("order\n"), F.col("o_orderkey").cast("string"), F.lit("\n")).alias("table_text"))
    return pages, tables


@register("assembled_context", "WITH " + SQL_REFS + """,
req AS (SELECT 'B' || b.item_id::VARCHAR AS code, b.text AS question, c.source AS name
        FROM benchmark b CROSS JOIN (SELECT DISTINCT source FROM chunks) c),
first AS (SELECT code, source, page, min(ordinal) AS ordinal FROM kept WHERE page IS NOT NULL GROUP BY ALL),
body AS (SELECT f.code, f.source AS name, string_agg(chr(10) || '---' || chr(10) || '# Page ' || f.page::VARCHAR || chr(10) || """
          + _filled_sql("''") + """ || chr(10), '' ORDER BY f.ordinal, f.page) AS body
         FROM first f JOIN chunks c USING (source, page) GROUP BY ALL),
parts AS (SELECT r.code, r.name, CASE WHEN b.name IS NULL
                 THEN '⚠️ No references found for query ''' || r.question || ''' in ' || r.name || chr(10)
                 ELSE 'Company name: ' || r.name || chr(10) || chr(10) || b.body || chr(10) || '---' || chr(10) END AS part,
                 r.name NOT IN (SELECT source FROM ti) AS unknown
          FROM req r LEFT JOIN body b USING (code, name))
SELECT code AS query_id, CASE WHEN NOT bool_or(unknown) THEN string_agg(part, '' ORDER BY name) END AS context,
       '⚠️ No metadata.json found for ' || min(name) FILTER (WHERE unknown) AS reply
FROM parts GROUP BY code""")
def q_assembled_context(spark, sf_dir):
    """X1, X2, X9 (document form): every question to every file, filled pages and messages in one text."""
    refs = refs_after(spark, sf_dir).select(F.col("code").alias("query_id"), F.col("source").alias("name"), "source",
                                            F.col("page").cast("long").alias("page"), "ordinal")
    ti = driver.table_index(spark, sf_dir)
    codes = driver.codes(spark, sf_dir).select(F.col("code").alias("query_id"), F.col("description").alias("question"))
    sources = driver.chunks(spark, sf_dir).select(F.col("source").alias("name"), F.lit(0).alias("ordinal")).distinct()
    return A.assemble_context(codes.crossJoin(sources), ti.select(F.col("source").alias("name")), refs,
                              *_assembly_inputs(spark, sf_dir), form="document")


@register("assembled_sector_context", "WITH " + HYBRID_SECTORS_CTES + ",\n" + S.TABLE_INDEX + """,
body AS (SELECT h.query_id, string_agg(chr(10) || '---' || chr(10) || '# Source: ' || h.source || chr(10) || '# Page '
                || h.page::VARCHAR || chr(10) || """ + _filled_sql("c.source || ' - '") + """ || chr(10), '' ORDER BY h.rank, h.source, h.page) AS body
         FROM hy_top h JOIN chunks c USING (source, page) GROUP BY h.query_id)
SELECT b.item_id AS query_id, CASE WHEN y.query_id IS NULL
         THEN '⚠️  No reference found for query “' || b.text || '” in sector '''""" + f""" || '{SELECTION_NAME}' || '''' || chr(10)
         ELSE 'Sector: {SELECTION_NAME}' || chr(10) || chr(10) || y.body || chr(10) || '---' || chr(10) END
       || '⚠️No metadata found for the sector ''unlisted''' || chr(10)
       || '⚠️  No reference found for query “' || b.text || '” in sector ''unread''' || chr(10) AS context,
       NULL::VARCHAR AS reply
FROM benchmark b LEFT JOIN body y ON y.query_id = b.item_id""")
def q_assembled_sector_context(spark, sf_dir):
    """X1, X2, X9 (sector form): every question to a sector with references, one unknown and one without references."""
    refs = hybrid_by_sectors(spark, sf_dir).select("query_id", F.col("selection").alias("name"), "source", "page", F.col("rank").alias("ordinal"))
    asked = spark.createDataFrame([(SELECTION_NAME, 0), ("unlisted", 1), ("unread", 2)], "name string, ordinal int")
    items = driver.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return A.assemble_context(items.crossJoin(asked), asked.where("name <> 'unlisted'").select("name"), refs,
                              *_assembly_inputs(spark, sf_dir), form="sector")


_KEPT_HTML = SQL_REFS + ",\n" + _CELLS_NO_TI + """,
kt AS (SELECT DISTINCT source, page, table_no FROM kept),
kc AS (SELECT c.* FROM cells c JOIN kt USING (source, page, table_no)),
hl AS (SELECT source, page, table_no, -1 AS row_idx, '<tr>' || string_agg('<th>' ||
          replace(replace(replace(h, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</th>', '' ORDER BY col_idx) || '</tr>' AS line
       FROM (SELECT source, page, table_no, col_idx, max(header) AS h FROM kc WHERE header IS NOT NULL GROUP BY ALL) GROUP BY ALL),
bl AS (SELECT source, page, table_no, row_idx, '<tr>' || string_agg('<td>' ||
          replace(replace(replace(coalesce(cell, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>', '' ORDER BY col_idx) || '</tr>' AS line
       FROM kc GROUP BY ALL),
th AS (SELECT source, page, table_no, '<table>' || string_agg(line, '' ORDER BY row_idx) || '</table>' AS html
       FROM (SELECT * FROM hl UNION ALL SELECT * FROM bl) GROUP BY ALL)"""


def _kept_html(spark, sf_dir):
    return T.render_html(_kept_cells(spark, sf_dir))


@register("file_table_prompts", "WITH " + _KEPT_HTML + """
SELECT source AS name, 'File: ' || source || chr(10) || 'Consider the data shown in the following tables'
       || string_agg(html, ' e ' ORDER BY page, table_no) || '. Analyse the main values to answer the question.' AS text
FROM th GROUP BY source""")
def q_file_table_prompts(spark, sf_dir):
    """X3 (document form): marker texts of every file with kept tables, each marker replaced by its table."""
    return A.table_prompts(_kept_html(spark, sf_dir).withColumn("name", F.col("source")))


@register("sector_table_prompts", "WITH " + _KEPT_HTML + """,
st AS (SELECT d.lang AS name, th.* FROM th JOIN documents d ON d.doc_id = th.page)
SELECT name, 'Sector: ' || name || chr(10) || 'The following reports were analysed: '
       || (SELECT string_agg(s.source, ', ' ORDER BY s.source) FROM (SELECT DISTINCT name, source FROM st) s WHERE s.name = st.name)
       || '.' || chr(10) || 'Consider the data shown in the following tables: '
       || string_agg(html, ' e ' ORDER BY source, page, table_no) || '. Analyse the main values to answer the question.' AS text
FROM st GROUP BY name""")
def q_sector_table_prompts(spark, sf_dir):
    """X3 (sector form): marker numbers run over all files of a sector (here a language)."""
    lang = driver.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.col("lang").alias("name"))
    return A.table_prompts(_kept_html(spark, sf_dir).join(lang, "page"), form="sector")


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


def _md_sql(x: str) -> str:
    for pat, rep in ((r"```[^\n]*\n([\s\S]*?)```", r"\1"), (r"`([^`]*)`", r"\1"), (r"\*\*(.*?)\*\*", r"\1"),
                     (r"\*(.*?)\*", r"\1"), (r"(?m)^>\s?", "")):
        x = f"regexp_replace({x}, '{pat}', '{rep}', 'g')"
    return f"regexp_replace(replace({x}, 'python', ''), '^\\s+|\\s+$', '', 'g')"


def _tail_sql(x: str) -> str:
    return (f"CASE WHEN strpos(lower({x}), '{TAIL_MARKER}') = 0 THEN {x} ELSE regexp_replace(right({x}, "
            f"length(string_split(lower({x}), '{TAIL_MARKER}')[-1])), '^\\s+|\\s+$', '', 'g') END")


_MD, _TAIL = _md_sql(_TITLE), _tail_sql(_TITLE)
# Whole documents as an answer would hold them: fenced, quoted and with inline marks.
_ANSWER = ("('```python' || chr(10) || coalesce(text, '') || chr(10) || '```' || chr(10) || '> **' || source || '** `' "
           "|| lang || '`')")


@register("strip_markdown_texts", f"SELECT doc_id, {_md_sql(_ANSWER)} AS plain, {_tail_sql('coalesce(text, chr(32))')} AS tail FROM documents")
def q_strip_markdown_texts(spark, sf_dir):
    d = driver.table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    answer = F.concat(F.lit("```python\n"), text, F.lit("\n```\n> **"), F.col("source"), F.lit("** `"), F.col("lang"), F.lit("`"))
    return d.select("doc_id", strip_markdown(answer).alias("plain"), after_last(F.coalesce("text", F.lit(" ")), TAIL_MARKER).alias("tail"))


@register("strip_markdown_titles", f"SELECT page_id, {_MD} AS plain, {_TAIL} AS tail FROM pages")
def q_strip_markdown_titles(spark, sf_dir):
    p = driver.table(spark, sf_dir, "pages")
    t = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    return p.select("page_id", strip_markdown(t).alias("plain"), after_last(t, TAIL_MARKER).alias("tail"))


@register("company_labels", r"""
SELECT doc_id, regexp_replace(regexp_replace(
  CASE lang WHEN 'en' THEN source || '_2023.pdf' WHEN 'fr' THEN source || '.pdf' WHEN 'de' THEN source || '_2023'
            ELSE source END, '\.pdf$', ''), '_2023$', '') AS label FROM documents""")
def q_company_labels(spark, sf_dir):
    d = driver.table(spark, sf_dir, "documents")
    name = (F.when(F.col("lang") == "en", F.concat("source", F.lit("_2023.pdf")))
            .when(F.col("lang") == "fr", F.concat("source", F.lit(".pdf")))
            .when(F.col("lang") == "de", F.concat("source", F.lit("_2023"))).otherwise(F.col("source")))
    return d.select("doc_id", company_label(name).alias("label"))


def _new_turns(conv):
    first = conv.where(F.col("turn") == 0).select("conv_id", F.lit(0).alias("seq"), F.lit("user").alias("role"), "text")
    last_t = conv.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    last = conv.join(last_t, ["conv_id", "turn"]).select("conv_id", F.lit(1).alias("seq"),
                                                         F.lit("assistant").alias("role"), "text")
    return first.unionByName(last)


_APPEND_SQL = """appended AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT n.conv_id, coalesce(m.mx, -1) + row_number() OVER (PARTITION BY n.conv_id ORDER BY n.seq) AS turn, n.role, n.text
  FROM (SELECT conv_id, 0 AS seq, 'user' AS role, text FROM conversations WHERE turn = 0
        UNION ALL
        SELECT c.conv_id, 1, 'assistant', c.text FROM conversations c
        JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY conv_id) l USING (conv_id, turn)) n
  LEFT JOIN (SELECT conv_id, max(turn) AS mx FROM conversations GROUP BY conv_id) m USING (conv_id))"""


@register("append_turns", "WITH " + _APPEND_SQL + " SELECT * FROM appended")
def q_append_turns(spark, sf_dir):
    conv = driver.table(spark, sf_dir, "conversations")
    return X.append_turns(conv, _new_turns(conv))


@register("render_conversation", "WITH " + _APPEND_SQL + """
SELECT conv_id, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM appended GROUP BY conv_id""")
def q_render_conversation(spark, sf_dir):
    conv = driver.table(spark, sf_dir, "conversations")
    return X.render_conversation(X.append_turns(conv, _new_turns(conv)))

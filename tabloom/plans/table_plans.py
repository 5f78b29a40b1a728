"""Registered table queries (T1-T12, L5) over the lineitem tables and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions.numbers import format_answer, parse_number_sql_ctes, with_parsed_number
from tabloom.operators import quant as Q
from tabloom.operators import tables as T
from tabloom.plans import sql_frags as S
from tabloom.plans.registry import register
from tabloom.sources import driver

KEY = ["source", "page", "table_no"]
PREVIEW_N = 30
SLICE_ROWS = (0, 2)
SLICE_COLS = (0, 3)
EDIT_TEXT = "returned"


@register("clean_cells", "WITH " + S.CELLS + r"""
SELECT source, page, table_no, row_idx, col_idx, header,
       trim(regexp_replace(regexp_replace(cell, '[*#§¤•■□▪►|]', '', 'g'), '^`+|`+$', '', 'g')) AS cell
FROM cells""")
def q_clean_cells(spark, sf_dir):
    return T.clean_cells(driver.cells(spark, sf_dir))


_SQL_REPAIRED = S.CELLS + """,
widths AS (SELECT source, page, table_no, max(col_idx) + 1 AS width FROM cells GROUP BY ALL),
hdr AS (SELECT source, page, table_no, col_idx, max(header) AS header FROM cells
        WHERE header IS NOT NULL GROUP BY ALL),
rowsx AS (SELECT DISTINCT source, page, table_no, row_idx FROM cells),
grid AS (SELECT r.source, r.page, r.table_no, r.row_idx, unnest(range(0, w.width)) AS col_idx
         FROM rowsx r JOIN widths w USING (source, page, table_no)),
repaired AS (SELECT g.source, g.page, g.table_no, g.row_idx, g.col_idx::INTEGER AS col_idx, h.header,
                    coalesce(c.cell, 'NaN') AS cell
             FROM grid g
             LEFT JOIN cells c ON c.source = g.source AND c.page = g.page AND c.table_no = g.table_no
                              AND c.row_idx = g.row_idx AND c.col_idx = g.col_idx
             LEFT JOIN hdr h ON h.source = g.source AND h.page = g.page AND h.table_no = g.table_no
                            AND h.col_idx = g.col_idx)"""


@register("repair_tables", "WITH " + _SQL_REPAIRED + " SELECT * FROM repaired")
def q_repair_tables(spark, sf_dir):
    return T.repair_table(driver.cells(spark, sf_dir))


# One more row per table with nothing but a blank or NaN in it.
_SQL_DIRTY = _SQL_REPAIRED.replace("FROM cells", "FROM dirty").replace("JOIN cells", "JOIN dirty").replace(
    "widths AS", """dirty AS (SELECT source, page, table_no, row_idx, col_idx, header, cell FROM cells UNION ALL
SELECT source, page, table_no, max(row_idx) + 1, 0, NULL, CASE WHEN page % 2 = 0 THEN 'NaN' ELSE ' ' END FROM cells
GROUP BY source, page, table_no),
widths AS""", 1)


@register("drop_empty_rows", "WITH " + _SQL_DIRTY + """,
kept AS (SELECT *, max(CASE WHEN cell IS NULL OR trim(cell) = '' OR lower(trim(cell)) = 'nan' THEN 0 ELSE 1 END)
                   OVER (PARTITION BY source, page, table_no, row_idx) AS filled FROM repaired)
SELECT source, page, table_no, row_idx, col_idx, header, cell FROM kept WHERE filled = 1""")
def q_drop_empty_rows(spark, sf_dir):
    c = driver.cells(spark, sf_dir)
    # The blank row follows a table's last cell, so that no cell is moved.
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("row_idx"))) == 1
    own = F.struct("row_idx", "col_idx", "header", "cell")
    blank = F.struct((F.col("row_idx") + 1).alias("row_idx"), F.lit(0).alias("col_idx"), F.lit(None).cast("string").alias("header"),
                     F.when(F.col("page") % 2 == 0, "NaN").otherwise(" ").alias("cell"))
    dirty = c.withColumn("_last", last).select(*KEY, F.explode(F.when(F.col("_last"), F.array(own, blank)).otherwise(F.array(own))).alias("_c"))
    return T.drop_empty_rows(T.repair_table(dirty.select(*KEY, "_c.*")))


@register("unique_headers", "WITH " + S.CELLS + """,
h AS (SELECT source, page, table_no, col_idx, max(header) AS hh FROM cells WHERE header IS NOT NULL GROUP BY ALL),
b AS (SELECT *, CASE WHEN trim(hh) = '' THEN 'col_' || col_idx::VARCHAR ELSE trim(hh) END AS base FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY source, page, table_no, lower(base) ORDER BY col_idx) - 1 AS k FROM b)
SELECT source, page, table_no,
       string_agg(CASE WHEN k = 0 THEN base ELSE base || '_' || k::VARCHAR END, '|' ORDER BY col_idx) AS headers
FROM n GROUP BY ALL""")
def q_unique_headers(spark, sf_dir):
    u = T.unique_headers(driver.cells(spark, sf_dir))
    h = u.where(F.col("header").isNotNull()).select(*KEY, "col_idx", "header").distinct()
    return (h.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("col_idx", "header"))).alias("_h"))
            .select(*KEY, F.array_join(F.transform("_h", lambda x: x["header"]), "|").alias("headers")))


@register("parse_cells", "WITH " + S.CELLS + ", src AS (SELECT * FROM cells),"
          + parse_number_sql_ctes("src", "cell") + """
SELECT source, page, table_no, row_idx, col_idx, cell, lo, hi, op, is_pct FROM pn6""")
def q_parse_cells(spark, sf_dir):
    return T.parse_cells(driver.cells(spark, sf_dir)).select(*KEY, "row_idx", "col_idx", "cell", "lo", "hi", "op", "is_pct")


# Number texts in every shape the parser knows, derived from each order.
_FORMS_SQL = """forms AS (
  SELECT o_orderkey,
         CASE o_orderpriority
           WHEN '1-URGENT' THEN '<' || format('{:,.2f}', o_totalprice)
           WHEN '2-HIGH' THEN '(' || o_totalprice::DECIMAL(18,2)::VARCHAR || ')'
           WHEN '3-MEDIUM' THEN replace(o_totalprice::DECIMAL(18,2)::VARCHAR, '.', ',')
           WHEN '4-NOT SPECIFIED' THEN o_custkey::VARCHAR || '-' || (o_custkey + 10)::VARCHAR
           ELSE CASE o_orderstatus WHEN 'F' THEN 'na' WHEN 'O' THEN '>-' || (o_custkey % 100)::VARCHAR || ' %'
                                   ELSE 'UP' END
         END AS txt
  FROM orders)"""


def _forms(spark, sf_dir):
    o = driver.table(spark, sf_dir, "orders")
    dec = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    txt = (F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("<"), F.format_number("o_totalprice", 2)))
           .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("("), dec, F.lit(")")))
           .when(F.col("o_orderpriority") == "3-MEDIUM", F.replace(dec, F.lit("."), F.lit(",")))
           .when(F.col("o_orderpriority") == "4-NOT SPECIFIED",
                 F.concat(F.col("o_custkey").cast("string"), F.lit("-"), (F.col("o_custkey") + 10).cast("string")))
           .when(F.col("o_orderstatus") == "F", F.lit("na"))
           .when(F.col("o_orderstatus") == "O",
                 F.concat(F.lit(">-"), (F.col("o_custkey") % 100).cast("string"), F.lit(" %")))
           .otherwise(F.lit("UP")))
    return o.select("o_orderkey", txt.alias("txt"))


@register("parse_number_forms", "WITH " + _FORMS_SQL + "," + parse_number_sql_ctes("forms", "txt") + """
SELECT o_orderkey, txt, lo, hi, op, is_pct FROM pn6""")
def q_parse_number_forms(spark, sf_dir):
    return with_parsed_number(_forms(spark, sf_dir), "txt")


_SQL_LINES = S.CELLS + """,
hl AS (SELECT source, page, table_no, -1 AS row_idx,
              string_agg(CASE WHEN strpos(h, ';') > 0 OR strpos(h, '"') > 0 OR strpos(h, chr(10)) > 0
                              THEN '"' || replace(h, '"', '""') || '"' ELSE h END, ';' ORDER BY col_idx) AS line
       FROM (SELECT source, page, table_no, col_idx, max(header) AS h FROM cells WHERE header IS NOT NULL GROUP BY ALL)
       GROUP BY ALL),
bl AS (SELECT source, page, table_no, row_idx,
              string_agg(CASE WHEN strpos(c, ';') > 0 OR strpos(c, '"') > 0 OR strpos(c, chr(10)) > 0
                              THEN '"' || replace(c, '"', '""') || '"' ELSE c END, ';' ORDER BY col_idx) AS line
       FROM (SELECT source, page, table_no, row_idx, col_idx, coalesce(cell, '') AS c FROM cells) GROUP BY ALL),
lines AS (SELECT * FROM hl UNION ALL SELECT * FROM bl)"""


@register("render_tables_csv", "WITH " + _SQL_LINES + """
SELECT source, page, table_no, string_agg(line, chr(10) ORDER BY row_idx) AS csv FROM lines GROUP BY ALL""")
def q_render_tables_csv(spark, sf_dir):
    return T.render_csv(driver.cells(spark, sf_dir))


@register("table_preview", "WITH " + _SQL_LINES + f"""
SELECT source, page, table_no, string_agg(line, chr(10) ORDER BY row_idx) AS preview FROM lines
WHERE row_idx < {PREVIEW_N} - 1 GROUP BY ALL""")
def q_table_preview(spark, sf_dir):
    return T.table_preview(driver.cells(spark, sf_dir), n=PREVIEW_N)


_ESC = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@register("render_tables_html", "WITH " + S.CELLS + """,
hl AS (SELECT source, page, table_no, -1 AS row_idx,
              '<tr>' || string_agg('<th>' || """ + _ESC.format(x="h") + """ || '</th>', '' ORDER BY col_idx) || '</tr>' AS line
       FROM (SELECT source, page, table_no, col_idx, max(header) AS h FROM cells WHERE header IS NOT NULL GROUP BY ALL)
       GROUP BY ALL),
bl AS (SELECT source, page, table_no, row_idx,
              '<tr>' || string_agg('<td>' || """ + _ESC.format(x="coalesce(cell, '')") + """ || '</td>', '' ORDER BY col_idx) || '</tr>' AS line
       FROM cells GROUP BY ALL)
SELECT source, page, table_no, '<table>' || string_agg(line, '' ORDER BY row_idx) || '</table>' AS html
FROM (SELECT * FROM hl UNION ALL SELECT * FROM bl) GROUP BY ALL""")
def q_render_tables_html(spark, sf_dir):
    return T.render_html(driver.cells(spark, sf_dir))


def _selection(spark, sf_dir):
    ti = driver.table_index(spark, sf_dir)
    o = driver.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    s = ti.join(o, "o_orderkey")
    rows = F.array(*[F.lit(r) for r in SLICE_ROWS])
    cols = F.array(*[F.lit(c) for c in SLICE_COLS])
    full = s.where(F.col("o_orderstatus") == "F").select(*KEY, rows.alias("rows"), cols.alias("cols"))
    bad = s.where((F.col("o_orderstatus") != "F") & (F.col("o_orderpriority") == "5-LOW")).select(
        *KEY, F.lit(None).cast("array<int>").alias("rows"), cols.alias("cols"))
    return full.unionByName(bad)


@register("slice_tables", "WITH " + S.CELLS + f""",
sel AS (SELECT ti.source, ti.page, ti.table_no,
               CASE WHEN o.o_orderstatus = 'F' THEN {list(SLICE_ROWS)} ELSE NULL END AS rws,
               {list(SLICE_COLS)} AS cls
        FROM ti JOIN orders o USING (o_orderkey)
        WHERE o.o_orderstatus = 'F' OR o.o_orderpriority = '5-LOW')
SELECT c.source, c.page, c.table_no, c.row_idx, c.col_idx, c.header, c.cell,
       CASE WHEN s.cls IS NOT NULL AND s.rws IS NULL THEN 'error' ELSE 'ok' END AS status
FROM cells c LEFT JOIN sel s USING (source, page, table_no)
WHERE s.cls IS NULL OR s.rws IS NULL OR (list_contains(s.rws, c.row_idx) AND list_contains(s.cls, c.col_idx))""")
def q_slice_tables(spark, sf_dir):
    return T.slice_tables(driver.cells(spark, sf_dir), _selection(spark, sf_dir))


@register("apply_edits", "WITH " + S.CELLS + f"""
SELECT source, page, table_no, row_idx, col_idx, header,
       CASE WHEN col_idx = 1 AND cell = 'R' THEN '{EDIT_TEXT}' ELSE cell END AS cell
FROM cells""")
def q_apply_edits(spark, sf_dir):
    c = driver.cells(spark, sf_dir)
    edits = c.where((F.col("col_idx") == 1) & (F.col("cell") == "R")).select(
        *KEY, "row_idx", "col_idx", F.lit(EDIT_TEXT).alias("new_cell"))
    # The edits come from the stored cells, so they lie in the same buckets.
    return T.apply_edits(c, edits, aligned=True).select(*KEY, "row_idx", "col_idx", "header", "cell")


_STRIP = r"""trim(replace(replace(replace(replace(replace(replace(
    regexp_replace({x}, '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
    '&#39;', ''''), '&amp;', '&'))"""


LIST_CELLS_CTES = r"""
lc_t AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul\b[^>]*>(.*?)</ul>', 1)) AS tbl,
                unnest(range(0, len(regexp_extract_all(html, '(?s)<ul\b[^>]*>(.*?)</ul>', 1)))) AS table_no
         FROM pages),
lc_r AS (SELECT page_id, table_no, unnest(regexp_extract_all(tbl, '(?s)<li\b[^>]*>(.*?)</li>', 1)) AS rw,
                unnest(range(0, len(regexp_extract_all(tbl, '(?s)<li\b[^>]*>(.*?)</li>', 1)))) AS row_idx FROM lc_t),
lc_c AS (SELECT page_id, table_no, row_idx,
                unnest(regexp_extract_all(rw, '(?s)<(?:a)\b[^>]*>(.*?)</(?:a)>', 1)) AS cl,
                unnest(range(0, len(regexp_extract_all(rw, '(?s)<(?:a)\b[^>]*>(.*?)</(?:a)>', 1)))) AS col_idx
         FROM lc_r),
lc AS (SELECT page_id, table_no::INTEGER AS table_no, row_idx::INTEGER AS row_idx, col_idx::INTEGER AS col_idx,
              """ + _STRIP.format(x="cl") + """ AS cell FROM lc_c)"""


@register("html_list_cells", "WITH " + LIST_CELLS_CTES + " SELECT * FROM lc")
def q_html_list_cells(spark, sf_dir):
    p = driver.table(spark, sf_dir, "pages")
    return T.html_tables_to_cells(p, "html", ["page_id"], table_tag="ul", row_tag="li", cell_tags=("a",))


_SQL_FACTS = ("WITH " + S.CELLS + """,
lbl AS (SELECT source, page, table_no, row_idx, cell AS row_label FROM cells WHERE col_idx = 0),
dat AS (SELECT * FROM cells WHERE col_idx <> 0 AND NOT regexp_matches(coalesce(header, ''), '(?i)^units?$')),"""
          + parse_number_sql_ctes("dat", "cell") + r"""
SELECT p.source, p.page, p.table_no, p.row_idx, p.col_idx, l.row_label, p.header AS column_label,
       CAST(NULL AS VARCHAR) AS unit,
       CASE WHEN regexp_extract(coalesce(p.header, ''), '\b((?:19|20)[0-9]{2})\b', 1) <> ''
            THEN regexp_extract(coalesce(p.header, ''), '\b((?:19|20)[0-9]{2})\b', 1)::INTEGER END AS year,
       p.lo AS value, p.is_pct
FROM pn6 p LEFT JOIN lbl l USING (source, page, table_no, row_idx)""")


@register("table_facts", _SQL_FACTS)
def q_table_facts(spark, sf_dir):
    """Every lineitem table unpivoted to facts (row label, column label, unit, year, value)."""
    return T.to_facts(driver.cells(spark, sf_dir))


# Money is reported in cents: the columns that hold it, and the rule that brings it to whole units.
MONEY_COLUMN = "value"


@register("facts_to_answers", f"""
WITH tf AS ({_SQL_FACTS}),
f AS (SELECT source AS company, column_label AS metric, value / 100 AS value FROM tf
      WHERE column_label = '{MONEY_COLUMN}' AND value IS NOT NULL)
SELECT company, metric, CAST(round(sum(value)::DECIMAL(38,6), 2) AS DECIMAL(38,2))::VARCHAR AS total,
       CAST(round(max(value)::DECIMAL(38,12), 2) AS DECIMAL(38,2))::VARCHAR AS highest
FROM f GROUP BY ALL""")
def q_facts_to_answers(spark, sf_dir):
    """T10 -> A20 -> A1 and A8: facts read from the tables, brought to one unit, then answered."""
    facts = T.to_facts(driver.cells(spark, sf_dir)).where((F.col("column_label") == MONEY_COLUMN) & F.col("value").isNotNull())
    reported = facts.select(F.col("source").alias("company"), F.col("column_label").alias("metric"),
                            F.lit("cent").alias("unit"), "value")
    rules = spark.range(1).select(F.lit("cent").alias("unit"), F.lit("unit").alias("target"), F.lit(0.01).alias("factor"))
    same = Q.normalize_units(reported, rules, "unit").where("status = 'ok'")
    by = ["company", "metric"]
    found = Q.q_together(same, by, total="sum", highest="max").dropna(subset=by)
    return found.select(*by, F.round(F.col("total").cast("decimal(38,6)"), 2).cast("decimal(38,2)").cast("string").alias("total"),
                        format_answer("highest").alias("highest"))

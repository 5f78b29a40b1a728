"""Shared DuckDB SQL fragments for the oracle queries.

They restate the driver-table mapping of ``tabloom.sources.driver`` in SQL.
"""

TOK = r"[\p{L}\p{N}_]{2,}"


def rnd(expr: str, digits: int = 6) -> str:
    """Output rounding; a rounded zero is +0.0."""
    return f"(CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END)"

CHUNKS = """chunks AS (
  SELECT d.source AS source, d.doc_id AS page, d.text AS content, d.lang AS lang,
         list_filter([d.lang, CASE WHEN l.quality = 1 THEN 'hq' END,
                      CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS company_sectors
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

Q_TEXT = "q_text AS (SELECT item_id AS query_id, text FROM benchmark)"

Q_VEC = """q_vec AS (
  SELECT b.item_id AS query_id, e.embedding AS qvec,
         sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS qn
  FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"""

VECS = """vecs AS (
  SELECT c.source, c.page, c.company_sectors, e.label, e.embedding,
         sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS vn
  FROM embeddings e JOIN chunks c ON c.page = e.vec_id
  WHERE e.embedding IS NOT NULL)"""


def sparse_ctes(p: str, k: int) -> str:
    """TF-IDF top-k per (query, grp) over CTE ``{p}_docs(grp, source, page, content)``."""
    return f"""
{p}_dt AS (SELECT grp, source, page, unnest(regexp_extract_all(lower(content), '{TOK}')) AS term FROM {p}_docs),
{p}_tf AS (SELECT grp, source, page, term, count(*) AS tf FROM {p}_dt GROUP BY ALL),
{p}_n AS (SELECT grp, count(*) AS n_docs FROM {p}_docs GROUP BY grp),
{p}_idf AS (SELECT t.grp, t.term, ln((1.0 + n.n_docs) / (1.0 + count(*))) + 1.0 AS idf
            FROM {p}_tf t JOIN {p}_n n USING (grp) GROUP BY t.grp, t.term, n.n_docs),
{p}_w AS (SELECT t.grp, t.source, t.page, t.term, i.idf, t.tf * i.idf AS w
          FROM {p}_tf t JOIN {p}_idf i USING (grp, term)),
{p}_wn AS (SELECT grp, source, page, term, idf,
                  w / sqrt(sum(w * w) OVER (PARTITION BY grp, source, page)) AS wn FROM {p}_w),
{p}_qtf AS (SELECT query_id, term, count(*)::DOUBLE AS qtf FROM
            (SELECT query_id, unnest(regexp_extract_all(lower(text), '{TOK}')) AS term FROM q_text)
            GROUP BY ALL),
{p}_qn AS (SELECT q.query_id, i.grp, sqrt(sum((q.qtf * i.idf) * (q.qtf * i.idf))) AS qnorm
           FROM {p}_qtf q JOIN {p}_idf i USING (term) GROUP BY ALL),
{p}_raw AS (SELECT q.query_id, w.grp, w.source, w.page, sum(w.wn * q.qtf * w.idf) AS raw
            FROM {p}_wn w JOIN {p}_qtf q USING (term) GROUP BY ALL),
{p}_all AS (SELECT q.query_id, d.grp, d.source, d.page, coalesce(r.raw, 0.0) AS raw,
                   coalesce(r.raw / n.qnorm, 0.0) AS score
            FROM q_text q CROSS JOIN {p}_docs d
            LEFT JOIN {p}_raw r ON r.query_id = q.query_id AND r.grp = d.grp
                               AND r.source = d.source AND r.page = d.page
            LEFT JOIN {p}_qn n ON n.query_id = q.query_id AND n.grp = d.grp),
{p}_top AS (SELECT query_id, grp, source, page, score,
                   row_number() OVER (PARTITION BY query_id, grp ORDER BY round(raw, 9) DESC, source, page) AS rank
            FROM {p}_all QUALIFY rank <= {k})"""


def dense_ctes(p: str, k: int, similarity: bool = False) -> str:
    """Exact cosine top-k per (query, grp) over CTE ``{p}_vecs(grp, source, page, embedding, vn)``."""
    val = "sim" if similarity else "1.0 - sim"
    order = "DESC" if similarity else "ASC"
    return f"""
{p}_all AS (SELECT q.query_id, v.grp, v.source, v.page,
                   least(greatest(list_sum(list_transform(range(1, len(v.embedding) + 1),
                            lambda i: v.embedding[i]::DOUBLE * q.qvec[i]::DOUBLE)) / (v.vn * q.qn), -1.0), 1.0) AS sim
            FROM q_vec q CROSS JOIN {p}_vecs v WHERE v.vn > 0 AND q.qn > 0),
{p}_top AS (SELECT query_id, grp, source, page, {val} AS score,
                   row_number() OVER (PARTITION BY query_id, grp ORDER BY round({val}, 9) {order}, source, page) AS rank
            FROM {p}_all QUALIFY rank <= {k})"""


def fuse_ctes(p: str, dense: str, sparse: str, k: int, lmbd: float, similarity: bool = False) -> str:
    dscore = "(1.0 - score)" if similarity else "score"
    return f"""
{p}_u AS (SELECT query_id, grp, source, page, -{dscore} AS s, 0 AS side, rank FROM {dense}_top
          UNION ALL
          SELECT query_id, grp, source, page, score * {lmbd} AS s, 1 AS side, rank FROM {sparse}_top),
{p}_g AS (SELECT query_id, grp, source, page, sum(s) AS score, min(side * 1000000 + rank) AS first_pos
          FROM {p}_u GROUP BY ALL),
{p}_top AS (SELECT query_id, grp, source, page, score,
                   row_number() OVER (PARTITION BY query_id, grp ORDER BY round(score, 9) DESC, first_pos) AS rank
            FROM {p}_g QUALIFY rank <= {k})"""


TABLE_INDEX = """ti AS (
  SELECT d.source, o.o_orderkey // 15 AS page, (o.o_orderkey % 15)::INTEGER AS table_no, o.o_orderkey
  FROM orders o JOIN documents d ON d.doc_id = o.o_orderkey // 15)"""

CELLS = TABLE_INDEX + """,
li AS (SELECT ti.source, ti.page, ti.table_no,
              (row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
                  l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus,
                  l.l_shipdate) - 1)::INTEGER AS row_idx, l.*
       FROM lineitem l JOIN ti ON ti.o_orderkey = l.l_orderkey),
cells AS (
  SELECT source, page, table_no, row_idx, 0 AS col_idx, 'item' AS header, 'part ' || l_partkey::VARCHAR AS cell FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 1, 'flag', l_returnflag FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 2, 'value', l_quantity::BIGINT::VARCHAR FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 3, 'value', format('{:,.2f}', l_extendedprice) FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 4, 'discount', round(l_discount * 100)::INTEGER::VARCHAR || '%' FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 5, 'tax', replace(printf('%.2f', l_tax), '.', ',') FROM li WHERE l_tax > 0
  UNION ALL SELECT source, page, table_no, row_idx, 6, ' ', year(l_shipdate)::VARCHAR FROM li
  UNION ALL SELECT source, page, table_no, row_idx, 7, NULL, '** R' FROM li WHERE l_returnflag = 'R')"""

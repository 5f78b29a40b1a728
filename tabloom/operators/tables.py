"""Table operators on the long cell relation.

cells: <table key cols>, row_idx, col_idx, header, cell

All heterogeneous tables share that one schema; a table is pivoted to a
wide form only at the edge (rendering).  Table-wide facts (width, header
list) are computed with combinable aggregations and joined back, so a huge
table is never pulled into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.maps import let, map_of_greatest
from tabloom.functions.numbers import with_parsed_number
from tabloom.functions.text import tokenize

TABLE_KEY = ("source", "page", "table_no")

# Fixed values that must equal the reference's behaviour.
MISSING_CELL = "NaN"          # filler of padded cells
PREVIEW_LINES = 30            # lines of a table shown for relevance checks
BLANK_HEADER_PREFIX = "col_"  # name of a blank header: col_<position>
# OCR noise removed from cells (symbols only, never letters or digits).
NOISE_CHARS = "*#§¤•■□▪►|"
#: A header cell that is a year, and a row label that only names the period.
HEADER_YEAR_RE = r"^(?i:fy ?)?(?:19|20)[0-9]{2}$"
PERIOD_LABEL_RE = r"(?i)^(?:(?:fiscal|financial|reporting) )?(?:year|years|period)$"
YEAR_RE = r"\b((?:19|20)[0-9]{2})\b"

_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _key(key_cols):
    return list(key_cols)


def strip_tags(text: Column) -> Column:
    """Remove tags, decode the common entities, trim."""
    t = F.regexp_replace(text, r"<[^>]*>", "")
    for ent, ch in _ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    return F.trim(t)


def html_tables_to_cells(df: DataFrame, html_col: str = "html", key_cols=("source", "page"),
                         table_tag: str = "table", row_tag: str = "tr",
                         cell_tags=("td", "th")) -> DataFrame:
    """Every table -> its rows -> the text of its cells, all positions kept.

    Runs row-local (``posexplode`` three times), no shuffle.  Tags are
    configurable so lists (``ul/li``) parse the same way as tables.
    """
    kk = _key(key_cols)
    cell_alt = "|".join(cell_tags)
    t_re = rf"(?s)<{table_tag}\b[^>]*>(.*?)</{table_tag}>"
    r_re = rf"(?s)<{row_tag}\b[^>]*>(.*?)</{row_tag}>"
    c_re = rf"(?s)<(?:{cell_alt})\b[^>]*>(.*?)</(?:{cell_alt})>"
    t = df.select(*kk, F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(t_re), 1))
                  .alias("table_no", "_tbl"))
    r = t.select(*kk, "table_no", F.posexplode(F.regexp_extract_all("_tbl", F.lit(r_re), 1))
                 .alias("row_idx", "_row"))
    c = r.select(*kk, "table_no", "row_idx", F.posexplode(F.regexp_extract_all("_row", F.lit(c_re), 1))
                 .alias("col_idx", "_cell"))
    return c.select(*kk, "table_no", "row_idx", "col_idx", strip_tags(F.col("_cell")).alias("cell"))



def _whole_key(kk) -> Column:
    """No key column is null: as in a join, a table whose key holds a null matches nothing of its own."""
    whole = F.lit(True)
    for k in kk:
        whole = whole & F.col(k).isNotNull()
    return whole


def _row_summaries(cells: DataFrame, kk) -> DataFrame:
    """One row per (table, row): its cells as a map, its header pairs, its widths.

    The single pass over the cells every table operator starts from.  Of a
    repeated cell position the greatest text stays.
    """
    has_h = F.col("header").isNotNull()
    return cells.groupBy(*kk, "row_idx").agg(
        map_of_greatest(F.collect_list(F.struct("col_idx", "cell"))).alias("_m"),
        F.collect_list(F.when(has_h, F.struct("col_idx", "header"))).alias("_h"),
        F.max("col_idx").alias("_rw"))


def _made_once(rows: DataFrame, kk, name: str, make) -> DataFrame:
    """Column ``name``, which is the same in all rows of a table, as ``make`` of it: worked out at one of the rows."""
    table = Window.partitionBy(*kk)
    first = F.row_number().over(table.orderBy(F.lit(0))) == 1
    rows = rows.withColumn("_first", first).withColumn(name, F.when(F.col("_first"), let(F.col(name), make)))
    return rows.withColumn(name, F.max(name).over(table)).drop("_first")


def _headers(pairs: Column) -> Column:
    """Of (col_idx, header) pairs the greatest header of each column, in column order."""
    def last(p: Column) -> Column:
        same = lambda x, i: (i + 1 < F.size(p)) & F.get(p, i + 1)["col_idx"].eqNullSafe(x["col_idx"])
        return F.filter(p, lambda x, i: ~same(x, i))

    return let(F.array_sort(pairs), last)


def repair_table(cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """T5: every row gets as many cells as the widest row has; missing ones are 'NaN'.

    Cells right of the header and tables without any header are kept (header
    null).  One aggregation per row (a map col_idx -> cell, bounded by the
    row's own width), then a window over a table's row summaries (width, and
    the distinct header lists of its rows, which may spill), expanded.  Cells
    that are partitioned by table, or by part of its key, are not moved.
    """
    kk = _key(key_cols)
    table = Window.partitionBy(*kk)
    rows = _row_summaries(cells, kk).where(_whole_key(kk))
    rows = rows.withColumns({"_w": F.max("_rw").over(table), "_hs": F.collect_set("_h").over(table)})
    rows = _made_once(rows, kk, "_hs", lambda hs: _headers(F.flatten(hs))).withColumn("_hm", F.map_from_entries("_hs"))
    made = F.transform(F.sequence(F.lit(0), F.col("_w")), lambda i: F.struct(
        i.alias("col_idx"), F.try_element_at("_hm", i).alias("header"),
        F.coalesce(F.try_element_at("_m", i), F.lit(MISSING_CELL)).alias("cell")))
    grid = rows.select(*kk, "row_idx", F.explode(made).alias("_c"))
    return grid.select(*kk, "row_idx", "_c.col_idx", "_c.header", "_c.cell")


def is_blank(cell: Column) -> Column:
    t = F.trim(cell)
    return t.isNull() | (t == "") | (F.lower(t) == "nan")


def drop_empty_rows(cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """Drop rows whose cells are all empty or NaN.

    A window per row (bounded by the row's width) decides in one pass.
    """
    kk = _key(key_cols)
    w = Window.partitionBy(*kk, "row_idx")
    anyv = F.max((~is_blank(F.col("cell"))).cast("int")).over(w)
    return cells.withColumn("_any", anyv).where(F.col("_any") == 1).drop("_any")


def unique_headers(cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """Trimmed headers; blanks -> col_<i>; repeats -> the first free of name_1, name_2, ...

    A table's names are made once, at one of its cells, and reach the others
    by a window; cells that are partitioned by table are not moved.
    """
    kk = _key(key_cols)
    table = Window.partitionBy(*kk)
    pairs = F.collect_set(F.when(F.col("header").isNotNull(), F.struct("col_idx", "header"))).over(table)

    def place(acc, x):
        low = F.lower(x["_b"])
        used = F.transform(acc["out"], lambda y: F.lower(y["_u"]))
        taken = lambda name: F.array_contains(used, name) | F.array_contains(acc["all"], name)
        tries = F.transform(F.sequence(F.lit(1), F.size(acc["all"]) * 2), lambda n: F.concat_ws("_", x["_b"], n.cast("string")))
        free = F.element_at(F.filter(tries, lambda t: ~taken(F.lower(t))), 1)
        name = F.when(F.array_contains(used, low), free).otherwise(x["_b"])
        return F.struct(F.concat(acc["out"], F.array(F.struct(x["col_idx"].alias("col_idx"), name.alias("_u")))).alias("out"),
                        acc["all"].alias("all"))

    def names(given):
        base = lambda x: F.trim(x["header"])
        heads = F.transform(given, lambda x: F.struct(x["col_idx"].alias("col_idx"), F.when(
            base(x) == "", F.concat(F.lit(BLANK_HEADER_PREFIX), x["col_idx"].cast("string"))).otherwise(base(x)).alias("_b")))
        # Names in column order, bounded by the table's width: a repeat takes the first
        # suffix that no header of the table, original or made, has.
        start = lambda hs: F.struct(F.array().cast("array<struct<col_idx:int,_u:string>>").alias("out"),
                                    F.transform(hs, lambda x: F.lower(x["_b"])).alias("all"))
        return let(heads, lambda hs: F.aggregate(hs, start(hs), place)["out"])

    named = _made_once(cells.withColumn("_n", pairs), kk, "_n", lambda p: names(_headers(p)))
    own = F.get(F.filter("_n", lambda n: n["col_idx"] == F.col("col_idx")), 0)["_u"]
    return (named.withColumn("header", F.when(_whole_key(kk), own))
            .drop("_n"))


def clean_cells(cells: DataFrame) -> DataFrame:
    """Remove OCR noise symbols and code-fence backticks from cells."""
    c = F.translate("cell", NOISE_CHARS, "")
    c = F.when(c.contains("`"), F.regexp_replace(c, r"^`+|`+$", "")).otherwise(c)
    return cells.withColumn("cell", F.trim(c))


def parse_cells(cells: DataFrame) -> DataFrame:
    """T9 over a cell relation: adds lo, hi, op, is_pct."""
    return with_parsed_number(cells, "cell")


def slice_tables(cells: DataFrame, selection: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """Keep the selected rows and columns of each table.

    ``selection(<key>, rows array<int>, cols array<int>)``; a null ``rows`` or
    ``cols`` marks an unparsable selection: the table stays whole with
    ``status='error'``.  Tables without a selection stay whole ('ok').
    """
    kk = _key(key_cols)
    sel = selection.select(*kk, F.col("rows").alias("_rows"), F.col("cols").alias("_cols"),
                           F.lit(True).alias("_has"))
    j = cells.join(sel, kk, "left")
    bad = F.col("_has") & (F.col("_rows").isNull() | F.col("_cols").isNull())
    take = (F.col("_has").isNull() | bad
            | (F.array_contains("_rows", F.col("row_idx")) & F.array_contains("_cols", F.col("col_idx"))))
    return (j.where(take)
            .withColumn("status", F.when(bad, F.lit("error")).otherwise(F.lit("ok")))
            .drop("_rows", "_cols", "_has"))


def select_cells(questions: DataFrame, cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """T4 default selection: rows whose label and columns whose header share a token with the question.

    ``questions(question_id, question, <key>)`` -> one row per question with
    ``rows``, ``row_names`` (row order) and ``cols``; empty arrays when none.
    """
    kk = _key(key_cols)
    qt = questions.select("question_id", *kk, F.explode(F.array_distinct(tokenize("question"))).alias("term"))
    labels = cells.where(F.col("col_idx") == 0).select(*kk, "row_idx", F.col("cell").alias("label"))
    lt = labels.select(*kk, "row_idx", "label", F.explode(F.array_distinct(tokenize("label"))).alias("term"))
    rows = (qt.join(lt, [*kk, "term"]).select("question_id", *kk, "row_idx", "label").distinct()
            .groupBy("question_id", *kk)
            .agg(F.array_sort(F.collect_list(F.struct("row_idx", "label"))).alias("_r")))
    heads = (cells.where(F.col("header").isNotNull()).select(*kk, "col_idx", "header").distinct()
             .select(*kk, "col_idx", F.explode(F.array_distinct(tokenize("header"))).alias("term")))
    cols = (qt.join(heads, [*kk, "term"]).select("question_id", *kk, "col_idx").distinct()
            .groupBy("question_id", *kk).agg(F.array_sort(F.collect_list("col_idx")).alias("cols")))
    base = questions.select("question_id", *kk)
    out = base.join(rows, ["question_id", *kk], "left").join(cols, ["question_id", *kk], "left")
    empty_i = F.array().cast("array<int>")
    return out.select("question_id", *kk,
                      F.coalesce(F.transform("_r", lambda x: x["row_idx"]), empty_i).alias("rows"),
                      F.coalesce(F.transform("_r", lambda x: x["label"]),
                                 F.array().cast("array<string>")).alias("row_names"),
                      F.coalesce("cols", empty_i).alias("cols"))


def index_table(cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """Positional form used for row/column selection.

    The header becomes row -1, a leading column 0 holds the row index (the
    header row's label is 'index'), data columns shift right by one, and the
    headers are replaced by their positions.
    """
    kk = _key(key_cols)
    heads = (cells.where(F.col("header").isNotNull()).groupBy(*kk, "col_idx").agg(F.max("header").alias("cell"))
             .select(*kk, F.lit(-1).alias("row_idx"), "col_idx", "cell"))
    body = cells.select(*kk, "row_idx", "col_idx", "cell")
    shifted = heads.unionByName(body).withColumn("col_idx", F.col("col_idx") + 1)
    idx = body.select(*kk, "row_idx").distinct().select(*kk, "row_idx", F.lit(0).alias("col_idx"),
                                                        F.col("row_idx").cast("string").alias("cell"))
    idx_head = heads.select(*kk).distinct().select(*kk, F.lit(-1).alias("row_idx"), F.lit(0).alias("col_idx"),
                                                   F.lit("index").alias("cell"))
    out = shifted.unionByName(idx).unionByName(idx_head)
    return out.withColumn("header", F.col("col_idx").cast("string"))


def csv_quote(cell: Column, sep: str = ";") -> Column:
    """Quote a CSV field when it holds the separator, a quote or a newline."""
    needs = cell.contains(sep) | cell.contains('"') | cell.contains("\n")
    return F.when(needs, F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _rendered(cells: DataFrame, kk, cell_fmt, head_fmt, row_open="", row_close="", sep="", before: int | None = None) -> DataFrame:
    """Per table: the header line and the body lines in row order, from one pass.

    Rows are aggregated first (cells in column order, plus their header
    pairs); the table aggregate then collects the row lines and the distinct
    header lists.  Only rows below ``before`` become lines.  Cells that are
    partitioned by table, or by part of its key, are not moved.  Returns
    (<key>, _head string or null, _lines array<string>).
    """
    has_h = F.col("header").isNotNull()
    shown = F.lit(True) if before is None else F.col("row_idx") < before
    rows = cells.groupBy(*kk, "row_idx").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("c"))))).alias("_cs"),
        F.collect_list(F.when(has_h, F.struct("col_idx", "header"))).alias("_h"))
    rows = rows.select(*kk, "row_idx", "_h", F.concat(
        F.lit(row_open), F.array_join(F.transform("_cs", lambda x: cell_fmt(x["c"])), sep), F.lit(row_close))
        .alias("line"))
    t = rows.groupBy(*kk).agg(F.array_sort(F.collect_list(F.when(shown, F.struct("row_idx", "line")))).alias("_ls"),
                              _headers(F.flatten(F.collect_set("_h"))).alias("_hp"))
    names = F.transform("_hp", lambda x: head_fmt(x["header"]))
    head = F.when(F.size("_hp") > 0, F.concat(F.lit(row_open), F.array_join(names, sep), F.lit(row_close)))
    return t.select(*kk, head.alias("_head"), F.transform("_ls", lambda x: x["line"]).alias("_lines"))


def render_csv(cells: DataFrame, key_cols=TABLE_KEY, sep: str = ";", max_lines: int | None = None) -> DataFrame:
    """A table as ';'-separated text, header line first.  ``max_lines`` gives L5's preview.

    The text of one table is one value; for writing very large tables use
    ``csv_lines`` (one row per line) with ``sinks.writers.write_tables``.
    """
    kk = _key(key_cols)
    q = lambda c: csv_quote(c, sep)
    # Preview: only the rows that can appear become lines (at most max_lines - 1
    # per table); the header comes from the whole table.
    r = _rendered(cells, kk, q, q, sep=sep, before=None if max_lines is None else max_lines - 1)
    head = F.when(F.col("_head").isNotNull(), F.array(F.col("_head"))).otherwise(F.array())
    if max_lines is None:
        lines = F.concat(F.when(_whole_key(kk), head).otherwise(F.array()), F.col("_lines"))
        return r.select(*kk, F.array_join(lines, "\n").alias("csv"))
    # Of a table whose key holds a null, header and body are two rows.
    parts = F.when(_whole_key(kk), F.array(F.concat(head, F.col("_lines")))).otherwise(F.array(head, F.col("_lines")))
    r = r.select(*kk, F.explode(parts).alias("_ls")).where(F.size("_ls") > 0)
    return r.select(*kk, F.array_join(F.slice("_ls", 1, max_lines), "\n").alias("csv"))


def csv_lines(cells: DataFrame, key_cols=TABLE_KEY, sep: str = ";") -> DataFrame:
    """T11 as lines: (<key>, line_no, line) with the header as line 0; no per-table collect."""
    kk = _key(key_cols)
    q = lambda c: csv_quote(c, sep)
    rows = cells.groupBy(*kk, "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", F.coalesce("cell", F.lit("")).alias("c")))).alias("_cs"))
    body = rows.select(*kk, (F.col("row_idx") + 1).alias("line_no"),
                       F.array_join(F.transform("_cs", lambda x: q(x["c"])), sep).alias("line"))
    heads = (cells.where(F.col("header").isNotNull()).groupBy(*kk, "col_idx").agg(F.max("header").alias("h"))
             .groupBy(*kk).agg(F.array_sort(F.collect_list(F.struct("col_idx", "h"))).alias("_hs")))
    head = heads.select(*kk, F.lit(0).alias("line_no"),
                        F.array_join(F.transform("_hs", lambda x: q(x["h"])), sep).alias("line"))
    return head.unionByName(body)


def _esc(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def render_html(cells: DataFrame, key_cols=TABLE_KEY) -> DataFrame:
    """A table as an HTML ``<table>`` with a header row."""
    kk = _key(key_cols)
    r = _rendered(cells, kk, lambda c: F.concat(F.lit("<td>"), _esc(c), F.lit("</td>")),
                  lambda c: F.concat(F.lit("<th>"), _esc(c), F.lit("</th>")), "<tr>", "</tr>")
    body, head = F.array_join(F.col("_lines"), ""), F.when(_whole_key(kk), F.col("_head"))
    return r.select(*kk, F.concat(F.lit("<table>"), F.coalesce(head, F.lit("")), body,
                                  F.lit("</table>")).alias("html"))


def apply_edits(cells: DataFrame, edits: DataFrame, key_cols=TABLE_KEY, aligned: bool = False) -> DataFrame:
    """Edited cells replace stored ones; ``edits(<key>, row_idx, col_idx, new_cell)``.

    ``aligned`` says that the edits are partitioned as the cells are, by table
    or by part of its key: both then stay where they are and meet in a window
    per cell position, whose sort may spill.  Otherwise they are joined, which
    broadcasts few edits and moves the cells for many.
    """
    kk = _key(key_cols)
    at = [*kk, "row_idx", "col_idx"]
    e = edits.select(*at, F.col("new_cell").alias("_new"))
    if not aligned:
        return cells.join(e, at, "left").withColumn("cell", F.coalesce("_new", "cell")).drop("_new")
    # Under new names, as a union of columns that are still known by their stored table loses its partitioning.
    pos, rest = [F.col(c).alias(f"_{c}") for c in at], [c for c in cells.columns if c not in at]
    # As in a join, an edit whose position holds a null matches no cell, and a cell stands once for each of its edits.
    both = cells.select(*pos, *rest).unionByName(
        e.where(_whole_key(at)).select(*pos, F.struct("_new").alias("_e")), allowMissingColumns=True)
    both = both.withColumn("_es", F.collect_list("_e").over(Window.partitionBy(*[f"_{c}" for c in at])))
    made = both.where(F.col("_e").isNull()).select(*[F.col(f"_{c}").alias(c) for c in at], *rest, F.explode_outer("_es").alias("_e"))
    return made.withColumn("cell", F.coalesce("_e._new", "cell")).drop("_e")


def merge_header_rows(cells: DataFrame, key_cols=TABLE_KEY, label_col: int = 0) -> DataFrame:
    """Leading rows that are further header lines; their texts join the headers.

    A leading row is a header line when it has no label (or one that only
    names the period) and no number; years count as header texts as long as
    the body has other numbers to tell them from.  A name that spans columns
    is carried to the right, into blank cells of its line whose column has a
    text in a lower header line; the label column spans nothing.

    Decisions are aggregates per row and per table, and the windows run over
    header lines only.
    """
    kk = _key(key_cols)
    text = F.trim("cell")
    value = (F.col("col_idx") != label_col) & ~is_blank(F.col("cell"))
    year = text.rlike(HEADER_YEAR_RE)
    any_of = lambda c: F.max(F.when(c, 1).otherwise(0))
    rows = cells.groupBy(*kk, "row_idx").agg(
        any_of((F.col("col_idx") == label_col) & ~is_blank(F.col("cell")) & ~text.rlike(PERIOD_LABEL_RE)).alias("_label"),
        any_of(value & ~year & text.rlike("[0-9]")).alias("_number"), any_of(value & year).alias("_year"))
    body = rows.groupBy(*kk).agg(F.max("_number").alias("_numbers"))
    data = (F.col("_label") + F.col("_number") > 0) | ((F.col("_year") > 0) & (F.col("_numbers") == 0))
    first = rows.join(body, kk).where(data).groupBy(*kk).agg(F.min("row_idx").alias("_first"))
    marked = cells.join(first, kk, "left").withColumn("_lead", F.coalesce(F.col("row_idx") < F.col("_first"), F.lit(False)))
    lead = marked.where("_lead").select(*kk, "row_idx", "col_idx", F.when(~is_blank(F.col("cell")), text).alias("t"))
    top = (cells.join(lead.select(*kk).distinct(), kk, "left_semi").groupBy(*kk, "col_idx")
           .agg(F.max("header").alias("_h")).select(*kk, F.lit(-1).alias("row_idx"), "col_idx", F.when(~is_blank(F.col("_h")), F.trim("_h")).alias("t")))
    left = Window.partitionBy(*kk, "row_idx").orderBy("col_idx")
    column = Window.partitionBy(*kk, "col_idx")
    lines = (lead.unionByName(top)
             .withColumn("_span", F.last(F.when(F.col("col_idx") != label_col, F.col("t")), ignorenulls=True).over(left))
             .withColumn("_deep", F.max(F.when(F.col("t").isNotNull(), F.col("row_idx"))).over(column))
             .withColumn("t", F.when(F.col("t").isNull() & (F.col("row_idx") < F.col("_deep")) & (F.col("col_idx") != label_col), F.col("_span"))
                         .otherwise(F.col("t"))))
    full = (lines.where(F.col("t").isNotNull()).groupBy(*kk, "col_idx")
            .agg(F.array_sort(F.collect_list(F.struct("row_idx", "t"))).alias("_l"), F.max("row_idx").alias("_deep"))
            .where(F.col("_deep") >= 0).select(*kk, "col_idx", F.array_join(F.transform("_l", lambda x: x["t"]), " ").alias("_full")))
    joined = marked.where(~F.col("_lead")).join(full, [*kk, "col_idx"], "left")
    return joined.withColumn("header", F.coalesce("_full", "header")).select(*cells.columns)


def to_facts(cells: DataFrame, key_cols=TABLE_KEY, label_col: int = 0,
             unit_header_re: str = r"(?i)^units?$") -> DataFrame:
    """Unpivot to facts (row_label, column_label, unit, year, value).

    The row label is the cell of column ``label_col``.  The unit of a row is
    the cell of the column whose header matches ``unit_header_re``, else the
    bracketed cell of a column without header, else what brackets hold at the
    end of the label.  The year is the first 19xx/20xx in the header; value =
    parsed lower bound.
    """
    kk = _key(key_cols)
    row = Window.partitionBy(*kk, "row_idx")
    no_header, bracketed = F.trim(F.coalesce("header", F.lit(""))) == "", r"^\s*\(([^()]+)\)\s*$"
    is_label, named = F.col("col_idx") == label_col, F.coalesce("header", F.lit("")).rlike(unit_header_re)
    in_brackets = F.when((named | (no_header & ~is_label)) & F.col("cell").rlike(bracketed), F.regexp_extract("cell", bracketed, 1))
    # A row's labels and unit reach its cells by a window, bounded by the row's width.
    known = cells.withColumns({"_labels": F.collect_list(F.when(is_label, F.struct("cell"))).over(row),
                               "_unit": F.coalesce(F.max(F.when(named, F.col("cell"))).over(row), F.max(in_brackets).over(row))})
    known = known.where(~is_label & ~named)
    whole = _whole_key([*kk, "row_idx"])
    labels = F.when(whole & (F.size("_labels") > 0), F.col("_labels")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("cell"))))
    data = known.select(*kk, "row_idx", "col_idx", "header", "cell", F.when(whole, F.col("_unit")).alias("unit"), F.explode(labels).alias("_label"))
    of_label = F.when(F.col("row_label").rlike(r"\([^()]+\)\s*$"), F.regexp_extract("row_label", r"\(([^()]+)\)\s*$", 1))
    year = F.regexp_extract(F.coalesce(F.col("header"), F.lit("")), YEAR_RE, 1)
    facts = with_parsed_number(data.withColumn("row_label", F.col("_label.cell")), "cell")
    return facts.select(*kk, "row_idx", "col_idx", "row_label", F.col("header").alias("column_label"), F.coalesce("unit", of_label).alias("unit"),
                        F.when(year != "", year.cast("int")).alias("year"), F.col("lo").alias("value"), "is_pct")


def table_preview(cells: DataFrame, key_cols=TABLE_KEY, n: int = PREVIEW_LINES) -> DataFrame:
    """The first ``n`` lines (header included) of every table as text."""
    return render_csv(cells, key_cols, max_lines=n).withColumnRenamed("csv", "preview")

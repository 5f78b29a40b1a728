"""Context assembly and text operators.

Every context string is built by an ordered aggregate over a bounded group
(the pages a question retrieved, the tables a code kept), never by pulling
rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.maps import let, map_of_greatest
from tabloom.functions.text import url_quote

# Fixed values that must equal the reference's behaviour.
PLACEHOLDER_RE = r"\[TABLEPLACEHOLDER\s*(\d+)]"
PLACEHOLDER_SPLIT_RE = r"\[TABLEPLACEHOLDER\s*\d+]"
TABLE_CAPTION = "\n[Table from page {page}, num {num}]\n"
SOURCE_CAPTION = "\n[Table from {source} - page {page}, num {num}]\n"
TABLE_MARKER_RE = r"<Table(\d+)>"
# Findings report lines (document header, code line, one link line per table):
#   "📁**{doc}** -- company name **{company}** \n "
#   "   🔹**GRI {code}**: {description}  "
#   "        [pag.{page+1}](http://{host}:8080/viewer.html?file={doc}.pdf#page={page+1})   -> {page}_{num}.csv  "


def ordered_join(items: Column, sep: str) -> Column:
    """Join the ``x`` fields of an array of (k..., x) structs sorted by k."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["x"]), sep)


def fill_placeholders(pages: DataFrame, table_texts: DataFrame, key_cols=("source", "page"),
                      caption: str = TABLE_CAPTION) -> DataFrame:
    """Replace ``[TABLEPLACEHOLDER n]`` by the caption + table text; missing -> ''.

    ``table_texts(<key>, table_no, table_text)``; of several texts of one
    number the greatest stays.  The tables of a page are
    gathered into one map (bounded by the page's table count) and joined to
    the page, then the text is re-assembled from its split parts in order.
    """
    kk = list(key_cols)
    cap = F.concat(*_caption_parts(caption))
    tt = table_texts.select(*kk, "table_no", F.concat(cap, F.col("table_text")).alias("_tt"))
    maps = tt.groupBy(*kk).agg(map_of_greatest(F.collect_list(F.struct("table_no", "_tt"))).alias("_m"))
    p = pages.join(maps, kk, "left")
    parts = F.split(F.col("text"), PLACEHOLDER_SPLIT_RE, -1)
    nums = F.regexp_extract_all(F.col("text"), F.lit(PLACEHOLDER_RE), 1)
    filled = F.array_join(F.transform(parts, lambda part, i: F.concat(
        part, F.coalesce(F.try_element_at(F.col("_m"), F.try_element_at(nums, i + 1).cast("int")), F.lit("")))), "")
    return p.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(filled)).drop("_m")


def _caption_parts(caption: str):
    """Caption template with {page}/{num}/{source} -> list of Columns for concat."""
    out, rest = [], caption
    names = {"{page}": F.col("page").cast("string"), "{num}": F.col("table_no").cast("string"),
             "{source}": F.col("source").cast("string")}
    while rest:
        pos = [(rest.find(k), k) for k in names if rest.find(k) >= 0]
        if not pos:
            out.append(F.lit(rest))
            break
        i, k = min(pos)
        if i:
            out.append(F.lit(rest[:i]))
        out.append(names[k])
        rest = rest[i + len(k):]
    return out


def build_context(pages: DataFrame, order: DataFrame, group_cols=("query_id", "source"),
                  header_col: str = "source", form: str = "document") -> DataFrame:
    """One context text per group: header, then each page once in rank order.

    ``pages(source, page, text)``; ``order(<group>, source, page, ordinal)``.
    ``form='document'`` writes '# Page p' blocks under 'Company name: ...';
    ``form='sector'`` writes '# Source'/'# Page' blocks under 'Sector: ...'.
    Pages are de-duplicated on (source, page) inside the group (G5); a page
    with null text is an empty block.
    """
    g = list(group_cols)
    first = (order.groupBy(*g, *[c for c in ("source", "page") if c not in g])
             .agg(F.min("ordinal").alias("ordinal")))
    j = first.join(pages.select("source", "page", "text"), ["source", "page"])
    text = F.coalesce("text", F.lit(""))
    if form == "document":
        block = F.concat(F.lit("\n---\n# Page "), F.col("page").cast("string"), F.lit("\n"),
                         text, F.lit("\n"))
        header = F.concat(F.lit("Company name: "), F.col(header_col), F.lit("\n"))
    else:
        block = F.concat(F.lit("\n---\n# Source: "), F.col("source"), F.lit("\n# Page "),
                         F.col("page").cast("string"), F.lit("\n"), text, F.lit("\n"))
        header = F.concat(F.lit("Sector: "), F.col(header_col), F.lit("\n"))
    agg = j.groupBy(*g).agg(
        ordered_join(F.collect_list(F.struct("ordinal", "source", "page", block.alias("x"))), "").alias("_body"),
        F.first(header).alias("_h"))
    return agg.select(*g, F.concat("_h", F.lit("\n"), "_body", F.lit("\n---\n")).alias("context"))


def insert_tables(texts: DataFrame, tables: DataFrame, key_cols=("source",)) -> DataFrame:
    """Replace ``<Tablej>`` (1-based) by the j-th table's HTML; unmatched markers stay.

    ``texts(<key>, text)``, ``tables(<key>, j, html)``; of several tables of one
    number the greatest text stays.  Texts without tables pass through unchanged.
    """
    kk = list(key_cols)
    # A text may hold as many markers as a sector has tables: each number is looked up by halving the sorted ones.
    found = tables.select(*kk, F.col("j").cast("int").alias("j"), "html").where("j IS NOT NULL").groupBy(*kk, "j").agg(F.max("html").alias("html")).groupBy(*kk).agg(
        F.array_sort(F.collect_list(F.struct("j", "html"))).alias("_t"))
    t = texts.join(found, kk, "left")
    parts = F.split(F.col("text"), r"<Table\d+>", -1)
    marks = F.regexp_extract_all(F.col("text"), F.lit(TABLE_MARKER_RE), 1)

    def html(x: Column, mark: Column) -> Column:
        n = F.coalesce(F.size(x["t"]), F.lit(0))

        def halve(at: Column, _: Column) -> Column:
            mid = ((at["lo"] + at["hi"]) / 2).cast("int")
            below = F.get(x["t"], mid)["j"] < mark
            return F.when(at["lo"] >= at["hi"], at).when(below, F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(
                F.struct(at["lo"].alias("lo"), mid.alias("hi")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
        place = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve)["lo"]
        hit = let(place, lambda at: F.get(x["t"], at))
        return F.when(hit["j"] == mark, hit["html"])

    def rebuild(x: Column) -> Column:
        return F.array_join(F.transform(x["parts"], lambda part, i: let(F.get(x["marks"], i), lambda mark: F.concat(part, F.coalesce(
            html(x, mark.cast("int")), F.concat(F.lit("<Table"), mark, F.lit(">")), F.lit(""))))), "")

    rebuilt = let(F.struct(parts.alias("parts"), marks.alias("marks"), F.col("_t").alias("t")), rebuild)
    return t.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(rebuilt)).drop("_t")


def company_context(table_csv: DataFrame, name_col: str = "source") -> DataFrame:
    """X4: 'Company: c' then '# Page p, Table n' + CSV for each table, in (page, table) order."""
    items = F.collect_list(F.struct(
        "page", "table_no",
        F.concat(F.lit("# Page "), F.col("page").cast("string"), F.lit(", Table "),
                 F.col("table_no").cast("string"), F.lit("\n\n\n"), F.col("csv")).alias("x")))
    agg = table_csv.groupBy(name_col).agg(ordered_join(items, "\n\n").alias("_t"))
    return agg.select(name_col, F.concat(F.lit("Company: "), F.col(name_col), F.lit("\n\n\n"), F.col("_t"),
                                         F.lit("\n---\n")).alias("context"))


def table_listing(table_html: DataFrame, group_cols=("code", "source"), sector_col: str | None = None) -> DataFrame:
    """Prompt body listing companies' tables as HTML, each company under its name.

    ``table_html(<group>, source, page, table_no, html)``.  With ``sector_col`` (not of the group) companies
    stand below their sector, which is named once above them; sectors and companies follow their names.
    """
    g = list(group_cols)
    outer = [sector_col] if sector_col else []
    company = [*dict.fromkeys([*g, *outer, "source"])]
    items = F.collect_list(F.struct("page", "table_no", F.concat(F.col("html"), F.lit("\n\n")).alias("x")))
    text = table_html.groupBy(*company).agg(ordered_join(items, "").alias("_t")).withColumn(
        "_t", F.concat(F.lit("Company name: "), F.col("source"), F.lit("\n\n"), F.col("_t")))
    if sector_col:
        text = text.groupBy(*g, sector_col).agg(ordered_join(F.collect_list(F.struct("source", F.col("_t").alias("x"))), "").alias("_t"))
        text = text.withColumn("_t", F.concat(
            F.lit("The company below are inside the following sector: "), F.col(sector_col), F.lit("\n\n"), F.col("_t")))
    inner = F.struct(sector_col or "source", F.col("_t").alias("x"))
    agg = text.groupBy(*g).agg(ordered_join(F.collect_list(inner), "").alias("_t"))
    return agg.select(*g, F.regexp_replace("_t", r"^\s+|\s+$", "").alias("listing"))


def findings_report(codes: DataFrame, refs: DataFrame, docs: DataFrame, host: str = "localhost") -> DataFrame:
    """Per document, every code with refs and its distinct refs as viewer links.

    ``codes(code, description, ordinal)``, ``refs(source, code, page, table_no, ordinal)``,
    ``docs(source, company_name)``.  Codes without refs are omitted (J7).
    """
    r = (refs.where(F.col("page").isNotNull())
         .groupBy("source", "code", "page", "table_no").agg(F.min("ordinal").alias("ordinal")))
    link = F.concat(
        F.lit("        [pag."), (F.col("page") + 1).cast("string"), F.lit(f"](http://{host}:8080/viewer.html?file="),
        url_quote(F.col("source")), F.lit(".pdf#page="), (F.col("page") + 1).cast("string"), F.lit(")   -> "),
        F.col("page").cast("string"), F.lit("_"), F.col("table_no").cast("string"), F.lit(".csv  "))
    per_code = (r.select("source", "code", "ordinal", link.alias("x"))
                .groupBy("source", "code").agg(ordered_join(F.collect_list(F.struct("ordinal", "x")), "\n")
                                               .alias("_links")))
    c = codes.select("code", F.col("description"), F.col("ordinal").alias("_co"))
    per_code = per_code.join(c, "code").select(
        "source", "_co", F.concat(F.lit("   🔹**GRI "), F.col("code"), F.lit("**: "), F.col("description"),
                                  F.lit("  \n"), F.col("_links")).alias("x"))
    body = per_code.groupBy("source").agg(ordered_join(F.collect_list(F.struct("_co", "x")), "\n").alias("_b"))
    d = docs.select("source", "company_name")
    return body.join(d, "source", "left").select("source", F.concat(
        F.lit("📁**"), F.col("source"), F.lit("** -- company name **"), F.coalesce("company_name", F.lit("")),
        F.lit("** \n \n"), F.col("_b")).alias("report"))


def context_status(requests: DataFrame, refs: DataFrame, group_cols=("code", "source"),
                   query_col: str = "code", name_col: str = "source") -> DataFrame:
    """Per requested (question, document) an 'ok' or the reference's missing-refs message."""
    g = list(group_cols)
    have = refs.where(F.col("page").isNotNull()).select(*g).distinct().withColumn("_ok", F.lit(True))
    j = requests.select(*g).distinct().join(have, g, "left")
    msg = F.concat(F.lit("⚠️ No references found for query '"), F.col(query_col), F.lit("' in "),
                   F.col(name_col), F.lit("\n"))
    return j.select(*g, F.when(F.col("_ok"), F.lit("ok")).otherwise(msg).alias("status"))


def append_turns(conv: DataFrame, new: DataFrame) -> DataFrame:
    """X11: append new turns after each conversation's last turn, in their given order.

    ``new(conv_id, seq, role, text)``; turn numbers continue from max(turn).
    """
    last = conv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    w = Window.partitionBy("conv_id").orderBy("seq")
    n = (new.join(last, "conv_id", "left")
         .withColumn("turn", (F.coalesce(F.col("_last"), F.lit(-1)) + F.row_number().over(w)).cast("long"))
         .select("conv_id", "turn", "role", "text"))
    return conv.select("conv_id", "turn", "role", "text").unionByName(n)


def render_conversation(conv: DataFrame) -> DataFrame:
    """X11: a conversation as 'role: text' lines in turn order; a null role or text is empty."""
    items = F.collect_list(F.struct("turn", F.concat(
        F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("x")))
    return conv.groupBy("conv_id").agg(ordered_join(items, "\n").alias("transcript"))

"""Linking disclosure codes to tables, pruning, and the join family (L, J, G4-G5, W5, K6, U3).

refs: source, code, page, table_no, ordinal   (ordinal = position in the code's list)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.tables import strip_tags

# Fixed values that must equal the reference's behaviour.
PLACEHOLDER = "[TABLEPLACEHOLDER {n}]"
TABLE_CATEGORY = "Table"
NO_DESCRIPTION = "Description not found"
DEFAULT_VERDICT = "YES"        # a failed relevance check keeps the table
MAX_NOISE_TABLES = 2           # distractor tables per target

TABLE_KEY = ["source", "page", "table_no"]



def link_codes(codes: DataFrame, hits: DataFrame, tables: DataFrame) -> DataFrame:
    """L1: code x document -> tables on its top-k pages.

    ``codes(code, description, ordinal)``, ``hits(code, source, page, rank)``
    (from a retriever run with the codes' descriptions as queries),
    ``tables(source, page, table_no)``.  A (code, document) pair whose pages
    hold no table keeps one row with null page/table_no (an empty list).
    The ordinal orders refs by hit rank, then table number.  The hits are
    read once: one left join, then windows over each (document, code) list
    (bounded by k pages x their tables).
    """
    h = hits.select("code", "source", "page", "rank").join(codes.select("code"), "code", "left_semi")
    j = h.join(tables.select(*TABLE_KEY), ["source", "page"], "left")
    lst = Window.partitionBy("source", "code")
    ordered = lst.orderBy(F.col("table_no").isNull(), "rank", "page", "table_no")
    j = j.withColumns({"_has": F.max(F.col("table_no").isNotNull().cast("int")).over(lst),
                       "_n": F.row_number().over(ordered) - 1})
    found = F.col("table_no").isNotNull()
    keep = found | ((F.col("_has") == 0) & (F.col("_n") == 0))
    return j.where(keep).select(
        "source", "code", F.when(found, F.col("page")).alias("page"), "table_no",
        F.when(found, F.col("_n")).alias("ordinal"))


def number_tables(elements: DataFrame) -> DataFrame:
    """L2: number the Table elements of a page in reading order, from 0."""
    t = elements.where(F.col("category") == TABLE_CATEGORY)
    w = Window.partitionBy("source", "page").orderBy("elem_idx")
    return t.withColumn("table_no", F.row_number().over(w) - 1)


def page_text_with_placeholders(elements: DataFrame) -> DataFrame:
    """L3: page text with each table replaced by ``[TABLEPLACEHOLDER n]``.

    Blank text parts are dropped; parts are joined by newlines in element
    order.  One aggregate per page; the table numbers come from a running
    count inside the same ordered list, so no extra join is needed.
    """
    w = Window.partitionBy("source", "page").orderBy("elem_idx")
    is_table = (F.col("category") == TABLE_CATEGORY).cast("int")
    e = elements.withColumn("_tn", F.sum(is_table).over(w) - 1)
    part = F.when(F.col("category") == TABLE_CATEGORY,
                  F.format_string(PLACEHOLDER.replace("{n}", "%d"), F.col("_tn"))).otherwise(F.col("text"))
    e = e.select("source", "page", "elem_idx", part.alias("part")).where(
        F.col("part").isNotNull() & (F.length(F.trim("part")) > 0))
    agg = e.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("elem_idx", "part"))).alias("_p"))
    return agg.select("source", "page", F.array_join(F.transform("_p", lambda x: x["part"]), "\n").alias("text"))


# Parts of an HTML page that show no text.
UNSHOWN_RE = r"(?is)<!--.*?-->|<head\b[^>]*>.*?</head>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"


def html_elements(pages: DataFrame, key_cols=("source", "page"), html_col: str = "html",
                  table_tags=("ul", "table"), text_tags=("h1", "h2", "h3", "p")) -> DataFrame:
    """Page elements in reading order from HTML: tables/lists are 'Table', the rest 'Text'.

    Text between the named elements is an element of its own where it is not
    blank, so no shown text of the page is lost; what a page does not show
    (head, scripts, styles, comments) is left out first.
    """
    pat = "(?s)" + "|".join(rf"<{t}\b[^>]*>.*?</{t}>" for t in (*table_tags, *text_tags))
    kk = list(key_cols)
    shown = pages.select(*kk, F.regexp_replace(F.col(html_col), UNSHOWN_RE, "").alias("_h"))
    named = shown.select(*kk, F.split("_h", pat, -1).alias("_gaps"), F.regexp_extract_all("_h", F.lit(pat), 0).alias("_els"))
    # A gap stands before each element and after the last one.
    items = F.flatten(F.transform("_gaps", lambda gap, i: F.array(
        F.struct(F.lit(False).alias("named"), gap.alias("x")), F.struct(F.lit(True).alias("named"), F.try_element_at("_els", i + 1).alias("x")))))
    items = F.filter(items, lambda e: F.when(e["named"], e["x"].isNotNull()).otherwise(strip_tags(e["x"]).rlike(r"\S")))
    e = named.select(*kk, F.posexplode(items).alias("elem_idx", "_e"))
    tag = F.regexp_extract("_e.x", r"^<([a-z0-9]+)", 1)
    return e.select(*kk, "elem_idx",
                    F.when(F.col("_e.named") & tag.isin(*table_tags), F.lit(TABLE_CATEGORY)).otherwise(F.lit("Text")).alias("category"),
                    F.regexp_replace(strip_tags(F.col("_e.x")), r"^\s+|\s+$", "").alias("text"), F.col("_e.x").alias("html"))


def normalize_verdict(v: Column) -> Column:
    return F.coalesce(F.upper(F.trim(v)), F.lit(DEFAULT_VERDICT))


def prune_refs(refs: DataFrame, verdicts: DataFrame, tables: DataFrame) -> DataFrame:
    """Keep refs whose table exists and whose verdict is YES.

    ``verdicts(source, code, page, table_no, verdict)``; a missing or null
    verdict counts as YES (the reference keeps a table when the check
    fails).  Empty-list rows (null page) disappear, so do codes left empty.
    """
    existing = refs.join(tables.select(*TABLE_KEY), TABLE_KEY, "left_semi")
    v = verdicts.select("source", "code", "page", "table_no", F.col("verdict").alias("_v"))
    j = existing.join(v, ["source", "code", "page", "table_no"], "left")
    return j.where(normalize_verdict(F.col("_v")) == DEFAULT_VERDICT).drop("_v")


def default_verdicts(refs: DataFrame, codes: DataFrame, previews: DataFrame, threshold: float) -> DataFrame:
    """Deterministic stand-in for the relevance check: token-overlap cosine of
    the code description and the table preview (binary term vectors) >= threshold."""
    from tabloom.functions.text import tokenize
    pairs = refs.where(F.col("page").isNotNull()).select("source", "code", "page", "table_no").distinct()
    ct = codes.select("code", F.explode(F.array_distinct(tokenize("description"))).alias("term"))
    cn = ct.groupBy("code").agg(F.count(F.lit(1)).alias("_cn"))
    pt = previews.select(*TABLE_KEY, F.explode(F.array_distinct(tokenize("preview"))).alias("term"))
    pn = pt.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("_pn"))
    shared = (pairs.join(ct, "code").join(pt, [*TABLE_KEY, "term"])
              .groupBy("source", "code", "page", "table_no").agg(F.count(F.lit(1)).alias("_s")))
    scored = (pairs.join(shared, ["source", "code", "page", "table_no"], "left")
              .join(cn, "code", "left").join(pn, TABLE_KEY, "left"))
    cos = F.coalesce(F.col("_s"), F.lit(0)) / F.sqrt(F.col("_cn") * F.col("_pn"))
    return scored.select("source", "code", "page", "table_no",
                         F.when(F.coalesce(cos, F.lit(0.0)) >= threshold, F.lit("YES")).otherwise(F.lit("NO"))
                         .alias("verdict"))


def refs_stats(refs: DataFrame, label: str) -> DataFrame:
    """Per document the number of refs, distinct tables and codes."""
    r = refs.where(F.col("page").isNotNull())
    return r.groupBy("source").agg(
        F.lit(label).alias("stage"),
        F.count(F.lit(1)).alias("n_refs"),
        F.count_distinct("page", "table_no").alias("n_tables"),
        F.count_distinct("code").alias("n_codes"))


def orphan_pages(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Text pages that have no table left (to be dropped)."""
    return pages.join(tables.select("source", "page").distinct(), ["source", "page"], "left_anti")



def orphan_tables(checked: DataFrame, kept: DataFrame) -> DataFrame:
    """Tables that were checked but are referenced by no kept code."""
    c = checked.where(F.col("page").isNotNull()).select(*TABLE_KEY).distinct()
    return c.join(kept.select(*TABLE_KEY), TABLE_KEY, "left_anti")


def hits_with_tables(hits: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """A hit page counts only when both its text and at least one table exist."""
    return (hits.join(pages.select("source", "page"), ["source", "page"], "left_semi")
            .join(tables.select("source", "page"), ["source", "page"], "left_semi"))


def with_description(refs: DataFrame, codes: DataFrame) -> DataFrame:
    """Code -> description, 'Description not found' when absent."""
    c = codes.select("code", F.col("description").alias("_d"))
    return refs.join(c, "code", "left").withColumn(
        "description", F.coalesce("_d", F.lit(NO_DESCRIPTION))).drop("_d")


def dedupe_refs(refs: DataFrame) -> DataFrame:
    """One ref per (source, code, page, table_no), the first occurrence kept."""
    return (refs.where(F.col("page").isNotNull())
            .groupBy("source", "code", "page", "table_no").agg(F.min("ordinal").alias("ordinal")))


def dedupe_pages(refs: DataFrame, scope=("source",)) -> DataFrame:
    """First occurrence of every (source, page) within a scope (document or sector)."""
    s = list(scope)
    keys = list(dict.fromkeys([*s, "source", "page"]))
    return refs.groupBy(*keys).agg(F.min("ordinal").alias("ordinal"))


def add_noise_tables(targets: DataFrame, tables: DataFrame, m: int = MAX_NOISE_TABLES) -> DataFrame:
    """Up to ``m`` other tables of the same document for every target table.

    Only the first m+1 tables (by page, table_no) of each document can be
    chosen, so the join is bounded by that, not by the document's size.
    """
    w = Window.partitionBy("source").orderBy("page", "table_no")
    first = (tables.select(*TABLE_KEY).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m + 1)
             .select("source", F.col("page").alias("noise_page"), F.col("table_no").alias("noise_table_no"), "_r"))
    t = targets.select("target_id", *TABLE_KEY)
    cand = t.join(first, "source").where(
        (F.col("noise_page") != F.col("page")) | (F.col("noise_table_no") != F.col("table_no")))
    w2 = Window.partitionBy("target_id").orderBy("_r")
    return (cand.withColumn("noise_rank", F.row_number().over(w2)).where(F.col("noise_rank") <= m)
            .select("target_id", "source", "noise_page", "noise_table_no", "noise_rank"))


def merge_question_refs(old: DataFrame, new: DataFrame, mode: str = "replace") -> DataFrame:
    """K6: document form replaces a question's entry, sector form extends it."""
    if mode == "replace":
        return old.join(new.select("question").distinct(), "question", "left_anti").unionByName(new)
    if mode == "extend":
        return old.unionByName(new)
    raise ValueError("mode must be 'replace' or 'extend'")


def pending_tables(all_tables: DataFrame, done: DataFrame) -> DataFrame:
    """Tables not formatted yet."""
    return all_tables.select(*TABLE_KEY).join(done.select(*TABLE_KEY), TABLE_KEY, "left_anti")


def group_hits(hits: DataFrame, tables: DataFrame) -> DataFrame:
    """Sector -> document -> page -> table list, as ordered text lists.

    ``hits(sector, source, page)``; output one row per (sector, source)
    with ``pages`` = 'page:[t1,t2]' items in page order.
    """
    ht = hits.select("sector", "source", "page").distinct().join(tables.select(*TABLE_KEY), ["source", "page"])
    per_page = ht.groupBy("sector", "source", "page").agg(
        F.array_join(F.array_sort(F.collect_list("table_no")).cast("array<string>"), ",").alias("_t"))
    per_src = per_page.groupBy("sector", "source").agg(
        F.array_sort(F.collect_list(F.struct("page", "_t"))).alias("_p"))
    return per_src.select("sector", "source", F.array_join(F.transform(
        "_p", lambda x: F.concat(x["page"].cast("string"), F.lit(":["), x["_t"], F.lit("]"))), ";").alias("pages"))


def qa_tables(qa: DataFrame, tables: DataFrame) -> DataFrame:
    """Explode each question's refs and attach the table; missing ones flagged.

    A question without refs keeps one row (ref_no null, missing).
    """
    r = qa.select("qid", F.posexplode_outer("refs").alias("ref_no", "r")).select(
        "qid", "ref_no", F.col("r.source").alias("source"), F.col("r.page").alias("page"),
        F.col("r.table_no").alias("table_no"))
    t = tables.select(*TABLE_KEY).distinct().withColumn("_found", F.lit(True))
    return (r.join(t, TABLE_KEY, "left")
            .withColumn("missing", F.col("_found").isNull()).drop("_found"))


def join_on_index(results: DataFrame, corpus: DataFrame, cols=("hierarchical",)) -> DataFrame:
    """Attach corpus columns to results by question id (not by position)."""
    return results.join(corpus.select("qid", *cols), "qid", "left")

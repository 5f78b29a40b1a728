"""Context as one ordered assembly (X1-X3, X9): a reply's parts in the order of its requests.

A request grid (question, file or sector) is the outer side of every join, so a
request without metadata, without references or without readable pages still has
its part: a message, or a heading with its end line.  A part's size is bounded by
the pages a question retrieved; a prompt's by the tables of its file or sector,
which are the product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.context import SOURCE_CAPTION, TABLE_CAPTION, fill_placeholders, insert_tables, ordered_join

# Texts of the reply.
NO_METADATA = {"document": ("⚠️ No metadata.json found for ", ""), "sector": ("⚠️No metadata found for the sector '", "'\n")}
NO_REFERENCE = {"document": ("⚠️ No references found for query '", "' in ", "\n"),
                "sector": ("⚠️  No reference found for query “", "” in sector '", "'\n")}
HEADING = {"document": "Company name: ", "sector": "Sector: "}
PROMPT_HEAD = {"document": ("File: ", "\nConsider the data shown in the following tables"),
               "sector": ("Sector: ", "\nThe following reports were analysed: ", ".\nConsider the data shown in the following tables: ")}
PROMPT_BETWEEN = " e "
PROMPT_END = ". Analyse the main values to answer the question."


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def assemble_context(requests: DataFrame, known: DataFrame, refs: DataFrame, pages: DataFrame, table_texts: DataFrame,
                     form: str = "document") -> DataFrame:
    """One row per question of ``requests``: (query_id, context, reply).

    ``requests(query_id, question, name, ordinal)`` asks a question of a file or sector; parts
    follow ordinal, then name, and a repeated request counts once.  ``known(name)`` lists those with stored
    references, ``refs(query_id, name, source, page, ordinal)`` holds these (a row with a null page is an
    entry without pages), ``pages(source, page, text)`` the page texts and
    ``table_texts(source, page, table_no, table_text)`` what their placeholders stand for.

    A page is written once, at its first reference, with its placeholders filled; a page without a row in
    ``pages`` is left out, one with null text is an empty block, of several texts of a page the greatest stays.
    Unknown names and missing references are messages inside the context.  In the document form an unknown
    file ends the reply: ``reply`` is the first such message and ``context`` is null; else ``reply`` is null.
    """
    if form not in HEADING:
        raise ValueError("form must be document or sector")
    page_key, part_key = ["source", "page"], ["query_id", "name"]
    found = refs.where("page IS NOT NULL").groupBy(*part_key, *page_key).agg(F.min("ordinal").alias("ordinal"))
    used = found.select(*page_key).distinct()
    texts = pages.join(used, page_key, "left_semi").groupBy(*page_key).agg(F.max("text").alias("text"))
    filled = fill_placeholders(texts, table_texts.join(used, page_key, "left_semi"),
                               caption=TABLE_CAPTION if form == "document" else SOURCE_CAPTION)
    place = ("\n# Source: ", F.col("source")) if form == "sector" else ()
    block = _text("\n---", *place, "\n# Page ", F.col("page"), "\n", F.col("text"), "\n")
    bodies = found.join(filled, page_key).groupBy(*part_key).agg(
        ordered_join(F.collect_list(F.struct("ordinal", *page_key, block.alias("x"))), "").alias("_body"))
    grid = requests.groupBy(*part_key, "question").agg(F.min("ordinal").alias("ordinal"))
    grid = grid.join(known.select("name").distinct().withColumn("_known", F.lit(True)), "name", "left")
    grid = grid.join(refs.select(*part_key).distinct().withColumn("_entry", F.lit(True)), part_key, "left")
    grid = grid.join(bodies, part_key, "left")
    ask, between, end = NO_REFERENCE[form]
    unknown = F.col("_known").isNull()
    no_metadata = _text(NO_METADATA[form][0], F.col("name"), NO_METADATA[form][1])
    part = (F.when(unknown, no_metadata)
            .when(F.col("_entry").isNull(), _text(ask, F.col("question"), between, F.col("name"), end))
            .otherwise(_text(HEADING[form], F.col("name"), "\n\n", F.col("_body"), "\n---\n")))
    stop = F.min(F.when(unknown & F.lit(form == "document"), F.struct("ordinal", "name", no_metadata.alias("x"))))
    out = grid.groupBy("query_id").agg(
        ordered_join(F.collect_list(F.struct("ordinal", "name", part.alias("x"))), "").alias("context"), stop.alias("_stop"))
    return out.select("query_id", F.when(F.col("_stop").isNull(), F.col("context")).alias("context"), F.col("_stop.x").alias("reply"))


def number_markers(tables: DataFrame, name_col: str = "name") -> DataFrame:
    """Running marker numbers ``j`` from 1 over all files of a name, files by source, tables by page and number.

    A file's numbers start where those of the files before it end (a prefix sum over one row a
    file), so no window spans all tables of a sector.
    """
    files = tables.groupBy(name_col, "source").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(name_col).orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select(name_col, "source", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(name_col, "source").orderBy("page", "table_no")
    return (tables.withColumn("_i", F.row_number().over(inside)).join(files, [name_col, "source"])
            .withColumn("j", (F.col("_start") + F.col("_i")).cast("int")).drop("_i", "_start"))


def marker_texts(tables: DataFrame, form: str = "document", name_col: str = "name") -> DataFrame:
    """(name, text) of every name with a table: its heading and one ``<Tablej>`` marker per table."""
    if form not in PROMPT_HEAD:
        raise ValueError("form must be document or sector")
    files = tables.groupBy(name_col, "source").agg(F.count("*").alias("_n"))
    names = files.groupBy(name_col).agg(F.sum("_n").cast("int").alias("_n"), F.sort_array(F.collect_list("source")).alias("_files"))
    marks = F.array_join(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda j: F.concat(F.lit("<Table"), j.cast("string"), F.lit(">"))), PROMPT_BETWEEN)
    head = PROMPT_HEAD[form]
    between = (head[1],) if form == "document" else (head[1], F.array_join("_files", ", "), head[2])
    return names.select(name_col, _text(head[0], F.col(name_col), *between, marks, PROMPT_END).alias("text"))


def table_prompts(tables: DataFrame, form: str = "document", name_col: str = "name") -> DataFrame:
    """Per file or sector the marker text with each marker replaced by its table; ``tables(name, source, page, table_no, html)``."""
    numbered = number_markers(tables, name_col).select(name_col, "j", "html")
    return insert_tables(marker_texts(tables, form, name_col), numbered, [name_col])

"""File sources (S1-S10): table CSVs, page texts, JSON maps, QA corpus, PDF listing.

All readers are distributed: ``binaryFile`` / ``text`` scans split by file,
parsing is done with SQL functions per row.  Heterogeneous CSV tables are
read into the one long ``cells`` schema, so no single header is imposed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
TABLE_FILE_RE = r"(\d+)_(\d+)\.csv$"
PAGE_FILE_RE = r"(\d+)\.txt$"
PDF_GLOB = "*.[pP][dD][fF]"
# Encodings tried in order; ISO-8859-1 decodes any byte string, so entries
# after it can never be chosen.
DEFAULT_ENCODINGS = ("utf-8", "utf-8-sig", "iso-8859-1", "cp1252", "latin1")

def _field(sep: str) -> str:
    """One field: quoted when a quote opens it (then it may hold separators and newlines), else plain."""
    s = "\\" + sep if sep in ".^$|?*+()[]{}\\" else sep
    return rf'(?:"(?:[^"]++|"")*+"[^{s}\r\n]*+|[^{s}\r\n]*+)'


def _record_re(sep: str) -> str:
    """A non-blank record: fields up to a line end that no quoted field holds."""
    s = "\\" + sep if sep in ".^$|?*+()[]{}\\" else sep
    return rf"(?=[^\r\n]){_field(sep)}(?:{s}{_field(sep)})*+"


def _fields(rec, sep: str):
    """All fields of a record, blank ones included: each is matched behind a separator."""
    s = "\\" + sep if sep in ".^$|?*+()[]{}\\" else sep
    return F.transform(F.regexp_extract_all(F.concat(F.lit(sep), rec), F.lit(f"{s}({_field(sep)})"), F.lit(1)), _unquote)


def _unquote(c):
    quoted = c.startswith('"') & c.endswith('"') & (F.length(c) >= 2)
    inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted, inner).otherwise(c)


def decode_text(content, encodings=DEFAULT_ENCODINGS):
    """S3: bytes -> text with the first encoding that decodes cleanly.

    UTF-8 (with or without BOM) is used when the bytes are valid UTF-8,
    otherwise ISO-8859-1 (every byte maps to a character).
    """
    as_utf8 = F.col(content).cast("string") if isinstance(content, str) else content.cast("string")
    raw = F.col(content) if isinstance(content, str) else content
    no_bom = F.regexp_replace(as_utf8, r"^\x{FEFF}", "")
    enc = [e.lower().replace("_", "-") for e in encodings]
    latin = next((e for e in enc if e in ("iso-8859-1", "latin1", "latin-1")), None)
    out = F.when(F.is_valid_utf8(as_utf8), no_bom) if any(e.startswith("utf-8") for e in enc) else None
    if latin:
        fallback = F.decode(raw, "ISO-8859-1")
        out = fallback if out is None else out.otherwise(fallback)
    return out


def _table_key(path_col):
    folder = F.regexp_extract(path_col, r"([^/]+)/[^/]+$", 1)
    return (folder.alias("source"),
            F.regexp_extract(path_col, TABLE_FILE_RE, 1).cast("int").alias("page"),
            F.regexp_extract(path_col, TABLE_FILE_RE, 2).cast("int").alias("table_no"))


def read_tables(spark: SparkSession, path: str, sep: str = ";", header: bool = True,
                on_bad: str = "keep", encodings=DEFAULT_ENCODINGS) -> DataFrame:
    """Every ``{page}_{n}.csv`` below ``path`` into long cells.

    Output: source (folder), page, table_no, row_idx, col_idx, header, cell,
    n_fields, width.  Quoted fields may hold the separator or newlines.
    ``on_bad``: 'keep' keeps rows with extra fields (flagged by n_fields >
    width) for T5 to repair; 'drop' removes them; 'error' raises at runtime.
    ``header=False`` reads every line as data with no header.
    """
    if on_bad not in ("keep", "drop", "error"):
        raise ValueError("on_bad must be keep, drop or error")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.csv")
             .option("recursiveFileLookup", "true").load(path))
    text = files.select(*_table_key(F.col("path")), decode_text("content", encodings).alias("_t"))
    recs = text.select("source", "page", "table_no",
                       F.posexplode(F.regexp_extract_all("_t", F.lit(_record_re(sep)), 0)).alias("_line", "_rec"))
    fields = recs.select("source", "page", "table_no", "_line",
                         _fields(F.col("_rec"), sep).alias("_f"))
    key = ["source", "page", "table_no"]
    if header:
        heads = fields.where(F.col("_line") == 0).select(*key, F.col("_f").alias("_h"))
        body = fields.where(F.col("_line") > 0).join(heads, key, "left")
        body = body.withColumn("row_idx", F.col("_line") - 1)
    else:
        body = fields.withColumn("_h", F.lit(None).cast("array<string>")).withColumn("row_idx", F.col("_line"))
    body = body.withColumns({"n_fields": F.size("_f"),
                             "width": F.coalesce(F.size("_h"), F.size("_f"))})
    if on_bad == "drop":
        body = body.where(F.col("n_fields") <= F.col("width"))
    elif on_bad == "error":
        body = body.where(F.when(F.col("n_fields") > F.col("width"),
                                 F.raise_error(F.lit("malformed table row")).cast("boolean")).otherwise(True))
    cells = body.select(*key, "row_idx", "n_fields", "width", "_h",
                        F.posexplode("_f").alias("col_idx", "cell"))
    return cells.select(*key, "row_idx", "col_idx", F.try_element_at("_h", F.col("col_idx") + 1).alias("header"),
                        "cell", "n_fields", "width")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Every ``{page}.txt`` below ``path`` -> (source, page, text)."""
    df = (spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.txt")
          .option("recursiveFileLookup", "true").load(path))
    # The path is a URI: blanks and other characters of folder names are escaped in it.
    p = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return df.select(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1).alias("source"),
                     F.regexp_extract(p, PAGE_FILE_RE, 1).cast("int").alias("page"),
                     F.col("value").alias("text"))


def _json_files(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json")
            .option("recursiveFileLookup", "true").load(path)
            .select(F.col("value").alias("_j"), F.col("_metadata.file_path").alias("_path")))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """JSON object code -> description  =>  (code, description, ordinal)."""
    j = _json_files(spark, path).select(F.from_json("_j", "map<string,string>").alias("_m"))
    e = j.select(F.posexplode("_m").alias("ordinal", "code", "description"))
    return e.select("code", "description", "ordinal")


def read_refs(spark: SparkSession, path: str) -> DataFrame:
    """JSON code -> [[page, table], ...]  =>  (source, code, page, table_no, ordinal).

    The source is the folder of the file; a code with an empty list keeps
    one row with null page/table_no.
    """
    j = _json_files(spark, path).select(
        F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("source"),
        F.from_json("_j", "map<string,array<array<int>>>").alias("_m"))
    e = j.select("source", F.explode("_m").alias("code", "_l"))
    r = e.select("source", "code", F.posexplode_outer("_l").alias("ordinal", "_p"))
    return r.select("source", "code", F.try_element_at("_p", F.lit(1)).alias("page"),
                    F.try_element_at("_p", F.lit(2)).alias("table_no"), "ordinal")


_SECTOR_FORM = "map<string,array<struct<source:string,pages:array<struct<page_n:int,csv_files:array<string>>>>>>"


def read_question_refs(spark: SparkSession, path: str, form: str = "document") -> DataFrame:
    """Question maps in document form (question -> [[page, n]]) or sector form
    (question -> [{source, pages: [{page_n, csv_files}]}]) => (question, source, page, table_no)."""
    files = _json_files(spark, path)
    if form == "document":
        j = files.select(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("source"),
                         F.from_json("_j", "map<string,array<array<int>>>").alias("_m"))
        e = j.select("source", F.explode("_m").alias("question", "_l"))
        r = e.select("question", "source", F.explode_outer("_l").alias("_p"))
        return r.select("question", "source", F.try_element_at("_p", F.lit(1)).alias("page"),
                        F.try_element_at("_p", F.lit(2)).alias("table_no"))
    if form == "sector":
        j = files.select(F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1).alias("sector"),
                         F.from_json("_j", _SECTOR_FORM).alias("_m"))
        e = j.select("sector", F.explode("_m").alias("question", "_l")).select(
            "sector", "question", F.explode_outer("_l").alias("_s"))
        p = e.select("sector", "question", F.col("_s.source").alias("source"),
                     F.explode_outer("_s.pages").alias("_pg"))
        f = p.select("sector", "question", "source", F.col("_pg.page_n").alias("page"),
                     F.explode_outer("_pg.csv_files").alias("_csv"))
        return f.select("sector", "question", "source", "page",
                        F.regexp_extract("_csv", r"_(\d+)\.csv$", 1).try_cast("int").alias("table_no"))
    raise ValueError("form must be 'document' or 'sector'")


_PY_ITEM = r"""\s*(?:'((?:[^'\\]|\\.)*+)'|"((?:[^"\\]|\\.)*+)"|(-?[0-9.]+|None))\s*"""


def _py_list(col):
    """Python list literal of strings (either quote kind) or numbers -> array<string>; null if it is not one."""
    body = F.regexp_extract(F.col(col), r"(?s)^\s*\[(.*)\]\s*$", 1)
    is_list = F.col(col).rlike(rf"(?s)^\s*\[(?:{_PY_ITEM}(?:,{_PY_ITEM})*+,?)?\s*\]\s*$")
    raw = F.regexp_extract_all(body, F.lit(_PY_ITEM), F.lit(0))

    def value(x):
        t = F.trim(x)
        quoted = t.rlike("""^['"]""")
        inner = F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"\\(.)", "$1")
        return F.when(t == "None", F.lit(None)).when(quoted, inner).otherwise(t)

    return F.when(is_list, F.transform(F.filter(raw, lambda x: F.trim(x) != ""), value))


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """QA corpus CSV; list-literal columns zipped into refs; '.pdf' stripped.

    Output: qid, question, qtype, gri, value, hierarchical, refs array<struct<source,page,table_no>>, and the
    multi-table corpus' unit, years, answer_value, answer_companies (null where the file has no such column).
    A list literal that does not parse yields null refs (surfaced, not guessed).
    """
    df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
          .csv(path))
    idx = [c for c in df.columns if c in ("index", "Unnamed: 0", "_c0", "")]
    qid = F.col(f"`{idx[0]}`").cast("int") if idx else F.monotonically_increasing_id()
    srcs = F.transform(_py_list("pdf name"), lambda s: F.regexp_replace(s, r"\.pdf$", ""))
    pages = F.transform(_py_list("page nbr"), lambda s: s.cast("int"))
    tabs = F.transform(_py_list("table nbr"), lambda s: s.cast("int"))
    zipped = F.arrays_zip(srcs.alias("source"), pages.alias("page"), tabs.alias("table_no"))
    hier = F.col("hierarchical").cast("int") if "hierarchical" in df.columns else F.lit(None).cast("int")
    qtype = F.col("question_type_ext") if "question_type_ext" in df.columns else F.lit(None).cast("string")
    gri = F.col("gri") if "gri" in df.columns else F.lit(None).cast("string")
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    items = lambda c: _py_list(c) if c in df.columns else F.lit(None).cast("array<string>")
    return df.select(qid.alias("qid"), F.col("question"), qtype.alias("qtype"), gri.alias("gri"),
                     F.col("value"), hier.alias("hierarchical"), zipped.alias("refs"), text("unit").alias("unit"),
                     F.transform(items("years"), lambda y: y.cast("int")).alias("years"),
                     text("answer_value").alias("answer_value"), items("answer_company").alias("answer_companies"))


def list_documents(spark: SparkSession, path: str, glob: str = PDF_GLOB) -> DataFrame:
    """PDF files below a folder (or a single file), case-insensitive suffix.

    Only path/size/mtime are read; the content column is pruned.
    """
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(path))
    return df.select("path", "length", "modificationTime",
                     F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("title"))

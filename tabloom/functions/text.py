"""Scalar text functions (Column -> Column), all JVM-side built-ins.

Regular expressions are spelled so that Java regex (Spark) and RE2 (the DuckDB
oracle) read them the same way: word characters are ``[\\p{L}\\p{N}_]``
(Python's Unicode ``\\w``), never ``\\w`` itself, which is ASCII in both.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Token rule of the sparse retriever: lower-cased runs of two or more word
# characters (the default token pattern of the TF-IDF vectorizer it uses).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# Separator placed between the fields hashed into a content id.
ID_SEPARATOR = "\u001f"
# Key used when a company name is empty.
UNKNOWN_KEY = "UNKNOWN"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text) -> Column:
    """Array of lower-cased tokens of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN_PATTERN), 0)


def company_from_source(source) -> Column:
    """Text after the last '-' of the file name, extension removed."""
    tail = F.substring_index(_c(source), "-", -1)
    return F.regexp_replace(tail, r"\.[^./]*$", "")


def title_from_source(source) -> Column:
    """Base name of a path without its last extension."""
    base = F.substring_index(_c(source), "/", -1)
    return F.regexp_replace(base, r"\.[^.]*$", "")


def clean_key(name) -> Column:
    """I4: every char that is not a word char or '-' becomes '_'; empty -> UNKNOWN."""
    trimmed = F.trim(_c(name))
    cleaned = F.regexp_replace(trimmed, r"[^\p{L}\p{N}_-]", "_")
    return F.when(trimmed.isNull() | (F.length(trimmed) == 0), F.lit(UNKNOWN_KEY)).otherwise(cleaned)


def chunk_id(*cols) -> Column:
    """SHA-256 over the content and metadata values, in the given order.

    Fields are joined with an explicit separator (null -> empty), so the id is
    order-stable, separator-safe and the same on every executor and run.
    Array columns are joined with ','.
    """
    parts = []
    for c in cols:
        c = _c(c)
        parts.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.sha2(F.concat_ws(ID_SEPARATOR, *parts), 256)


def strip_markdown(text) -> Column:
    """Remove code fences, inline code, bold, italic, quote marks, 'python'."""
    t = _c(text)
    # A fence of several lines loses its first line and its end, one on a single line only its end.
    t = F.regexp_replace(t, r"(```(?:(?!```)[^\n])*+)```|```(?:(?!```)[^\n])*+\n((?:(?!```)[\s\S])*+)```", "$1$2")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"\*\*([^\n]*?)\*\*", "$1")
    t = F.regexp_replace(t, r"\*([^\n]*?)\*", "$1")
    t = F.regexp_replace(t, r"(?md)^>\s?", "")
    t = F.replace(t, F.lit("python"), F.lit(""))
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def after_last(text, marker: str) -> Column:
    """Text after the last case-insensitive ``marker`` (trimmed), else the text."""
    t = _c(text)
    low = F.lower(t)
    m = marker.lower()
    tail_len = F.length(F.substring_index(low, m, -1))
    tail = F.substring(t, F.length(t) - tail_len + 1, tail_len)
    tail = F.regexp_replace(tail, r"^\s+|\s+$", "")
    return F.when(F.locate(m, low) > 0, tail).otherwise(t)


def company_label(name) -> Column:
    """Drop a '.pdf' suffix, then a '_2023' suffix."""
    t = F.regexp_replace(_c(name), r"\.pdf$", "")
    return F.regexp_replace(t, r"_2023$", "")


def url_quote(text) -> Column:
    """Percent-encode a path: letters, digits and ``_.-~/`` stay, a space is %20."""
    t = F.url_encode(_c(text))
    for form, path in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        t = F.replace(t, F.lit(form), F.lit(path))
    return t

"""Numeric cell parsing (T9) and answer formatting (A21) as Column expressions.

``with_parsed_number`` adds ``lo double, hi double, op string, is_pct boolean``:

* ``31774`` -> (31774, 31774, '=')        * ``(74.0)`` -> (-74, -74, '=')
* ``-13%``  -> (-13, -13, '=', pct)       * ``<38``    -> (null, 38, '<')
* ``>-40%`` -> (-40, null, '>', pct)      * ``25-30``  -> (25, 30, 'range')
* ``10,291`` -> 10291 (comma before exactly-3-digit groups = thousands)
* ``-0,0007`` -> -0.0007 (other commas are decimal commas)
* missing markers (blank, na, n/a, nan, -, up, null, none) -> all null
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.maps import let

# The missing-data markers seen in report tables.
MISSING_MARKERS = ("", "na", "n/a", "n.a.", "nan", "-", "–", "—", "up", "null", "none")

THOUSANDS_RE = r"^[+-]?[1-9][0-9]{0,2}(,[0-9]{3})+(\.[0-9]+)?$"
DECIMAL_COMMA_RE = r"^[+-]?[0-9]*,[0-9]+$"
PLAIN_RE = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"
UNSIGNED = r"[0-9][0-9,]*(?:\.[0-9]+)?"
RANGE_RE = rf"^({UNSIGNED})[-–—]({UNSIGNED})$"
OP_RE = r"^(<=|>=|<|>|=|~)"
ACCOUNTING_RE = r"^\((.*)\)$"

PARSED_TYPE = "struct<lo:double,hi:double,op:string,is_pct:boolean>"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(s: Column) -> Column:
    """Numeric text with optional thousands or decimal comma -> double (else null)."""
    norm = (F.when(s.rlike(THOUSANDS_RE), F.regexp_replace(s, ",", ""))
            .when(s.rlike(DECIMAL_COMMA_RE), F.regexp_replace(s, ",", "."))
            .otherwise(s))
    return F.when(norm.rlike(PLAIN_RE), norm.cast("double"))


def parsed_number(text: Column) -> Column:
    """T9 as one struct (lo, hi, op, is_pct) of a text.

    Every intermediate is a lambda variable: it is computed once, also where a
    filter on a field is moved in front of the projection, and what a text
    does not need (ranges of a plain number, numbers of a marker) is left out.
    """
    def result(lo, hi, op, pct) -> Column:
        return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), op.cast("string").alias("op"), pct.alias("is_pct"))

    null = F.lit(None)

    def plain(body: Column, op: Column, sign: Column, pct: Column) -> Column:
        return let(to_double(body) * sign, lambda v: result(
            F.when(~op.isin("<", "<="), v), F.when(~op.isin(">", ">="), v),
            F.when(v.isNotNull(), F.when(op.isin("", "=", "~"), "=").otherwise(op)), pct))

    def span(body: Column, pct: Column) -> Column:
        end = lambda k: let(F.regexp_extract(body, RANGE_RE, k), to_double)
        return result(end(1), end(2), F.lit("range"), pct)

    def compared(s: Column, sign: Column, pct: Column) -> Column:
        return let(F.regexp_extract(s, OP_RE, 1), lambda op: let(F.when(op == "", s).otherwise(F.regexp_replace(s, OP_RE, "")), lambda body: F.when(
            body.rlike(RANGE_RE), span(body, pct)).otherwise(plain(body, op, sign, pct))))

    def number(t: Column, pct: Column) -> Column:
        return let(F.regexp_replace(t, r"[%\s]", ""), lambda s: F.when(s.rlike(ACCOUNTING_RE), let(
            F.regexp_extract(s, ACCOUNTING_RE, 1), lambda inner: compared(inner, F.lit(-1.0), pct))).otherwise(compared(s, F.lit(1.0), pct)))

    missing = lambda t: t.isNull() | F.lower(t).isin(*MISSING_MARKERS)
    return let(F.trim(text), lambda t: F.when(missing(t), result(null, null, null, F.lit(False))).otherwise(
        number(t, F.coalesce(F.instr(t, "%") > 0, F.lit(False)))))


def with_parsed_number(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """Add ``lo, hi, op, is_pct`` (optionally prefixed) parsed from ``col``."""
    out = df.withColumn("_pn", parsed_number(F.col(col)))
    return out.withColumns({prefix + k: F.col(f"_pn.{k}") for k in ("lo", "hi", "op", "is_pct")}).drop("_pn")


#: Decimals kept before rounding once: beyond those a double of up to 10 digits has.
EXACT = "decimal(38,12)"



def format_answer(x, digits: int = 2) -> Column:
    """A number as text with exactly ``digits`` decimals (decimal rounding)."""
    return F.round(_c(x).cast(EXACT), digits).cast(f"decimal(38,{digits})").cast("string")


def format_list(arr, sep: str = ", ") -> Column:
    """Lists joined with ', '."""
    return F.array_join(_c(arr), sep)


def format_bool(cond) -> Column:
    """Booleans as yes / no."""
    return F.when(_c(cond), F.lit("yes")).otherwise(F.lit("no"))


# ---- the same parser in DuckDB SQL, for the oracle -------------------------

def _sql_to_double(s: str) -> str:
    norm = (f"(CASE WHEN regexp_matches({s}, '{THOUSANDS_RE}') THEN replace({s}, ',', '') "
            f"WHEN regexp_matches({s}, '{DECIMAL_COMMA_RE}') THEN replace({s}, ',', '.') ELSE {s} END)")
    return f"(CASE WHEN regexp_matches({norm}, '{PLAIN_RE}') THEN TRY_CAST({norm} AS DOUBLE) END)"


def parse_number_sql_ctes(src: str, col: str, p: str = "pn") -> str:
    """CTEs ``{p}1..{p}6`` adding lo, hi, op, is_pct to every row of ``src``."""
    markers = ", ".join("'" + m + "'" for m in MISSING_MARKERS)
    return f"""
{p}1 AS (SELECT *, trim({col}) AS _t0 FROM {src}),
{p}2 AS (SELECT *, (_t0 IS NULL OR lower(_t0) IN ({markers})) AS _missing,
                coalesce(strpos(_t0, '%') > 0, false) AS _pct,
                regexp_replace(_t0, '[%\\s]', '', 'g') AS _t1 FROM {p}1),
{p}3 AS (SELECT *, regexp_matches(_t1, '{ACCOUNTING_RE}') AS _acc,
                CASE WHEN regexp_matches(_t1, '{ACCOUNTING_RE}') THEN regexp_extract(_t1, '{ACCOUNTING_RE}', 1)
                     ELSE _t1 END AS _t2 FROM {p}2),
{p}4 AS (SELECT *, regexp_extract(_t2, '{OP_RE}', 1) AS _op, regexp_replace(_t2, '{OP_RE}', '') AS _body FROM {p}3),
{p}5 AS (SELECT *, regexp_matches(_body, '{RANGE_RE}') AS _rng,
                {_sql_to_double('_body')} * (CASE WHEN _acc THEN -1.0 ELSE 1.0 END) AS _v,
                {_sql_to_double(f"regexp_extract(_body, '{RANGE_RE}', 1)")} AS _d1,
                {_sql_to_double(f"regexp_extract(_body, '{RANGE_RE}', 2)")} AS _d2 FROM {p}4),
{p}6 AS (SELECT *,
           CASE WHEN _missing THEN NULL WHEN _rng THEN _d1 WHEN _op IN ('<', '<=') THEN NULL ELSE _v END AS lo,
           CASE WHEN _missing THEN NULL WHEN _rng THEN _d2 WHEN _op IN ('>', '>=') THEN NULL ELSE _v END AS hi,
           CASE WHEN _missing THEN NULL WHEN _rng THEN 'range' WHEN _v IS NULL THEN NULL
                WHEN _op IN ('', '=', '~') THEN '=' ELSE _op END AS op,
           (_pct AND NOT _missing) AS is_pct FROM {p}5)"""

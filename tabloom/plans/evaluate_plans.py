"""Registered evaluation queries (E1-E8) over predictions derived from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import evaluate as E
from tabloom.plans.registry import register
from tabloom.sources import driver

PRED_SQL = """pred AS (
  SELECT o_orderkey AS qid,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'cot' WHEN '2-HIGH' THEN 'pot' WHEN '3-MEDIUM' THEN 'cot_noiseTrue'
         WHEN '4-NOT SPECIFIED' THEN 'pot_noiseFalse' ELSE 'cot_noiseFalse' END AS model,
    CASE o_orderstatus WHEN 'F' THEN 'What percentage of revenue came from this order?'
         WHEN 'O' THEN 'What is the order total (in %)?' ELSE 'What is the order total?' END AS question,
    CASE o_custkey % 8 WHEN 2 THEN '<' || o_totalprice::DECIMAL(18,2)::VARCHAR
         WHEN 5 THEN o_custkey::VARCHAR || ', ' || (o_custkey + 1)::VARCHAR
         WHEN 6 THEN o_custkey::VARCHAR || '-' || (o_custkey + 1)::VARCHAR
         ELSE o_totalprice::DECIMAL(18,2)::VARCHAR END AS value,
    CASE o_custkey % 8 WHEN 0 THEN o_totalprice::DECIMAL(18,2)::VARCHAR
         WHEN 1 THEN o_totalprice::DECIMAL(18,2)::VARCHAR || ' EUR'
         WHEN 2 THEN '< ' || o_totalprice::DECIMAL(18,2)::VARCHAR || 'kg'
         WHEN 3 THEN (o_totalprice / 100)::DECIMAL(18,4)::VARCHAR
         WHEN 4 THEN format('{:,.2f}', o_totalprice)
         WHEN 5 THEN '[''' || o_custkey::VARCHAR || ''', ''' || (o_custkey + 1)::VARCHAR || ''']'
         WHEN 6 THEN o_custkey::VARCHAR || ' – ' || (o_custkey + 1)::VARCHAR
         ELSE 'n/a' END AS response,
    CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN 'extra' ELSE 'rel' END AS dataset,
    CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS hierarchical
  FROM orders)"""


def _fmt3(s: str) -> str:
    return (f"array_to_string(list_transform(range(1, len(regexp_split_to_array({s}, '{E.NUMBER_RE}')) + 1), "
            f"lambda i: regexp_split_to_array({s}, '{E.NUMBER_RE}')[i] || "
            f"coalesce(printf('%.3f', regexp_extract_all({s}, '({E.NUMBER_RE})', 1)[i]::DOUBLE), '')), '')")


def _match(v: str, r: str, pct: str) -> str:
    fv = f"TRY_CAST({v} AS DOUBLE)"
    fr = f"TRY_CAST(replace({r}, ',', '') AS DOUBLE)"
    return (f"(CASE WHEN {fv} IS NULL OR {fr} IS NULL OR isnan({fv}) OR isnan({fr}) THEN false "
            f"WHEN {pct} AND (abs({fv}) = abs({fr}) OR abs({fv}) = abs({fr} * 100)) THEN true "
            f"ELSE {fv} = {fr} END)")


def _has_any(c: str, chars: str) -> str:
    return "(" + " OR ".join(f"strpos({c}, '{ch}') > 0" for ch in chars) + ")"


def _dash(s: str) -> str:
    return f"regexp_replace(regexp_replace({s}, '{E.DASH_RANGE_RE}', '\\1 - \\3', 'g'), '[–—]', '-', 'g')"


_R1 = "regexp_replace(regexp_replace(response_n, '(\\d),(\\d)', '\\1\\2', 'g'), '(\\d),(\\d)', '\\1\\2', 'g')"
_R2 = f"trim(regexp_replace(regexp_replace({_dash(_R1)}, '[a-zA-Z]+(\\d+)', '', 'g'), '{E.RANGE_DROP_RE}', '', 'g'), ' ')"
_R3 = (f"CASE WHEN dataset = 'extra' THEN regexp_replace(r2, '(\\d+\\.\\d+)\\s+(\\d+\\.\\d+)', '\\1 - \\2', 'g') "
       f"ELSE regexp_replace(regexp_replace(r2, '(\\d+)\\s+(\\d+)', '\\1, \\2', 'g'), '\\s*,\\s*|\\s+', ', ', 'g') END")

_BRANCHES = []
for _op in E.PREFIX_OPS:
    _s = "%" + _op + " "
    _BRANCHES.append(f"WHEN starts_with(v, '{_op}') AND starts_with(r, '{_op}') THEN "
                     + _match(f"trim(v, '{_s}')", f"trim(regexp_replace(r, '{E.LETTERS_RE}', '', 'g'), '{_s}')", "pct"))
_ALPHA = "regexp_matches(r, '\\p{L}')"
_TOKENS = "string_split(regexp_replace(r, '(\\d)#([a-zA-Z])', '\\1 \\2', 'g'), ' ')"
_BRANCHES.append(f"WHEN ({_ALPHA} OR {_has_any('r', '()')}) AND dataset = 'extra' THEN "
                 f"list_bool_or(list_transform({_TOKENS}, lambda e: "
                 + _match("trim(v, '%~')", "trim(trim(e, '%()'), '~')", "pct") + "))")
_BRANCHES.append(f"WHEN {_ALPHA} AND dataset = 'rel' THEN "
                 + _match("trim(v, '%~')", "trim(string_split(r, ' ')[1], '%~')", "pct"))
_TOL = (f"((({_has_any('v', '.%')} OR {_has_any('r', '.%')}) AND ({_has_any('v', '<=>')} = {_has_any('r', '<=>')})) "
        f"OR {_has_any('v', '~,')} OR {_has_any('r', '~,')})")
_BRANCHES.append(f"WHEN {_TOL} THEN " + _match("trim(v, '%<= >~')", "trim(r, '%<= >~')", "pct"))

SCORED_SQL = PRED_SQL + f""",
n1 AS (SELECT *, lower(value) AS value_n,
         regexp_replace(trim(split_part(
           CASE WHEN regexp_matches(lower(response), '^\\[.*\\]$')
                THEN array_to_string(list_transform(string_split_regex(regexp_extract(lower(response), '^\\[(.*)\\]$', 1),
                                                                       ',\\s*'), lambda x: trim(trim(x), '''"')), ', ')
                ELSE lower(response) END, '###', 1), ' |().' || chr(10) || chr(13)),
           '([0-9])([a-zA-Z])', '\\1 \\2', 'g') AS response_n,
         (strpos(question, '%') > 0 OR strpos(question, 'percentage') > 0) AS pct
       FROM pred),
n2 AS (SELECT *, CASE WHEN dataset = 'extra' THEN regexp_matches(value_n, '{E.EXTRA_RANGE_RE}')
                      ELSE regexp_matches(value_n, '{E.REL_RANGE_RE}') END AS is_range FROM n1),
n3 AS (SELECT *, {_R2} AS r2 FROM n2),
n4 AS (SELECT * EXCLUDE (value_n, response_n, r2),
              CASE WHEN is_range THEN {_fmt3(_dash('value_n'))} ELSE value_n END AS value_n,
              CASE WHEN is_range THEN {_fmt3('(' + _R3 + ')')} ELSE response_n END AS response_n FROM n3),
scored AS (SELECT *, coalesce(CASE WHEN value_n = response_n THEN true
{chr(10).join(_BRANCHES).replace('v,', 'value_n,').replace('(v ', '(value_n ')}
    ELSE false END, false) AS correct
  FROM (SELECT *, value_n AS v, response_n AS r FROM n4))"""


@register("normalize_answers", "WITH " + SCORED_SQL + """
SELECT qid, model, value_n, response_n, pct, is_range FROM scored""")
def q_normalize_answers(spark, sf_dir):
    return E.evaluate(driver.predictions(spark, sf_dir)).select(
        "qid", "model", "value_n", "response_n", "pct", "is_range")


@register("match_answers", "WITH " + SCORED_SQL + " SELECT qid, model, dataset, correct FROM scored")
def q_match_answers(spark, sf_dir):
    return E.evaluate(driver.predictions(spark, sf_dir)).select("qid", "model", "dataset", "correct")


@register("exact_match_by_model", "WITH " + SCORED_SQL + """
SELECT model, round((avg(correct::INTEGER) * 100)::DECIMAL(38,6), 1)::DOUBLE AS em, count(*) AS n
FROM scored GROUP BY model""")
def q_exact_match_by_model(spark, sf_dir):
    return E.exact_match(E.evaluate(driver.predictions(spark, sf_dir)), ["model"])


@register("exact_match_hierarchical", "WITH " + SCORED_SQL + """
SELECT model, hierarchical, round((avg(correct::INTEGER) * 100)::DECIMAL(38,6), 1)::DOUBLE AS em, count(*) AS n
FROM scored WHERE dataset = 'extra' GROUP BY model, hierarchical""")
def q_exact_match_hierarchical(spark, sf_dir):
    scored = E.evaluate(driver.predictions(spark, sf_dir)).where(F.col("dataset") == "extra")
    return E.exact_match(scored, ["model", "hierarchical"])


SAMPLE_QUESTIONS = 25


@register("limit_questions", "WITH " + PRED_SQL + f"""
SELECT qid, question, value FROM pred ORDER BY qid LIMIT {SAMPLE_QUESTIONS}""")
def q_limit_questions(spark, sf_dir):
    """The first n questions of the corpus by id (the sampling option of a test run)."""
    qa = driver.predictions(spark, sf_dir).select("qid", "question", "value")
    return E.limit_questions(qa, SAMPLE_QUESTIONS)


@register("results_by_index", "WITH " + SCORED_SQL + """
SELECT qid, model, correct, hierarchical FROM scored""")
def q_results_by_index(spark, sf_dir):
    """Scored results get the corpus' hierarchical flag by question id (not by position)."""
    from tabloom.operators import link as L
    pred = driver.predictions(spark, sf_dir)
    results = E.evaluate(pred.drop("hierarchical")).select("qid", "model", "correct")
    return L.join_on_index(results, pred.select("qid", "hierarchical"))

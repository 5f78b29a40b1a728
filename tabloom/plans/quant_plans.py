"""Registered quantitative queries (A1-A21) over facts from lineitem x supplier x nation.

company = nation name, metric = return flag, year = ship year, value = revenue.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.functions.numbers import format_answer
from tabloom.operators import quant as Q
from tabloom.plans.registry import register
from tabloom.sources import driver

Y_FROM, Y_TO = 1999, 2000
TOP_N = 3
NUM_METRIC, DEN_METRIC = "A", "R"
TARGET_UNIT = "EUR"
# Fixed unit rules (unit, target, factor) and the unit each region reports in.
UNIT_RULES = (("kEUR", "EUR", 1000.0), ("MEUR", "EUR", 1000000.0))
REGION_UNITS = {0: ("kEUR", 1000.0), 1: ("MEUR", 1000000.0), 2: ("EUR", 1.0), 3: ("USD", 1.0), 4: ("kEUR", 1000.0)}

FACTS_SQL = """facts AS (
  SELECT n.n_name AS company, l.l_returnflag AS metric, year(l.l_shipdate)::INTEGER AS year, n.n_regionkey AS region,
         sum(l.l_extendedprice::DECIMAL(18,2))::DOUBLE AS value
  FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
  GROUP BY ALL)"""


def fmt(x: str) -> str:
    return f"CAST(round(({x})::DECIMAL(38,12), 2) AS DECIMAL(38,2))::VARCHAR"


def _sql(body: str) -> str:
    return "WITH " + FACTS_SQL + ("" if body.startswith(",") else "\n") + body


def _pair_sql(by: str, a: str, b: str) -> str:
    return (f"(SELECT {by}, max(CASE WHEN {a} THEN value END) AS a, max(CASE WHEN {b} THEN value END) AS b "
            f"FROM facts GROUP BY ALL)")


def F_(spark, sf_dir):
    return driver.facts(spark, sf_dir)


BY_CM = ["company", "metric"]
BY_MY = ["metric", "year"]


@register("q_sum", _sql(f"SELECT company, metric, {fmt('sum(value)')} AS answer FROM facts GROUP BY ALL"))
def q_sum(spark, sf_dir):
    return Q.answer(Q.q_sum(F_(spark, sf_dir), BY_CM))


@register("q_mean", _sql(f"SELECT company, metric, {fmt('avg(value)')} AS answer FROM facts GROUP BY ALL"))
def q_mean(spark, sf_dir):
    return Q.answer(Q.q_mean(F_(spark, sf_dir), BY_CM))


_P = _pair_sql("company, metric", f"year = {Y_FROM}", f"year = {Y_TO}")


@register("q_reduction_difference", _sql(f"SELECT company, metric, {fmt('a - b')} AS answer FROM {_P}"))
def q_reduction_difference(spark, sf_dir):
    return Q.answer(Q.q_diff(F_(spark, sf_dir), BY_CM, Y_FROM, Y_TO, "reduction"))


@register("q_increase_difference", _sql(f"SELECT company, metric, {fmt('b - a')} AS answer FROM {_P}"))
def q_increase_difference(spark, sf_dir):
    return Q.answer(Q.q_diff(F_(spark, sf_dir), BY_CM, Y_FROM, Y_TO, "increase"))


@register("q_reduction_percentage", _sql(
    f"SELECT company, metric, {fmt('CASE WHEN a <> 0 THEN 100.0 * (a - b) / a END')} AS answer FROM {_P}"))
def q_reduction_percentage(spark, sf_dir):
    return Q.answer(Q.q_pct(F_(spark, sf_dir), BY_CM, Y_FROM, Y_TO, "reduction"))


@register("q_increase_percentage", _sql(
    f"SELECT company, metric, {fmt('CASE WHEN a <> 0 THEN 100.0 * (b - a) / a END')} AS answer FROM {_P}"))
def q_increase_percentage(spark, sf_dir):
    return Q.answer(Q.q_pct(F_(spark, sf_dir), BY_CM, Y_FROM, Y_TO, "increase"))


@register("q_comparative", _sql(f"""
SELECT company, metric, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a > b THEN 'yes' ELSE 'no' END END
  AS answer FROM {_pair_sql('company, metric', f'year = {Y_TO}', f'year = {Y_FROM}')}"""))
def q_comparative(spark, sf_dir):
    return Q.q_compare(F_(spark, sf_dir), BY_CM, F.col("year") == Y_TO, F.col("year") == Y_FROM, ">")


@register("q_superlative_value", _sql(f"""
SELECT metric, year, {fmt('max(value)')} AS max_answer, {fmt('min(value)')} AS min_answer FROM facts GROUP BY ALL"""))
def q_superlative_value(spark, sf_dir):
    return F_(spark, sf_dir).groupBy(*BY_MY).agg(format_answer(F.max("value")).alias("max_answer"),
                                                 format_answer(F.min("value")).alias("min_answer"))


@register("q_superlative_company", _sql(f"""
SELECT metric, year, company, {fmt('value')} AS answer FROM facts
QUALIFY row_number() OVER (PARTITION BY metric, year ORDER BY value DESC, company) = 1"""))
def q_superlative_company(spark, sf_dir):
    return Q.answer(Q.q_best_item(F_(spark, sf_dir), BY_MY, "company", "max"))


@register("q_rank_values", _sql(f"""
SELECT metric, year, string_agg({fmt('value')}, ', ' ORDER BY value DESC, company) AS answer FROM (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY metric, year ORDER BY value ASC, company) <= {TOP_N})
GROUP BY ALL"""))
def q_rank_values(spark, sf_dir):
    return Q.q_rank(F_(spark, sf_dir), BY_MY, TOP_N, "company", pick="low", order="desc", show="value")


@register("q_rank_companies", _sql(f"""
SELECT metric, year, string_agg(company, ', ' ORDER BY value DESC, company) AS answer FROM (
  SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY metric, year ORDER BY value DESC, company) <= {TOP_N})
GROUP BY ALL"""))
def q_rank_companies(spark, sf_dir):
    return Q.q_rank(F_(spark, sf_dir), BY_MY, TOP_N, "company", pick="high", order="desc", show="company")


_RATIO = (f"(SELECT company, year, CASE WHEN b <> 0 THEN 100.0 * a / b END AS value FROM "
          f"{_pair_sql('company, year', f'metric = {NUM_METRIC!r}', f'metric = {DEN_METRIC!r}')})")


def _ratio(spark, sf_dir):
    return Q.q_ratio(F_(spark, sf_dir), ["company", "year"], F.col("metric") == NUM_METRIC,
                     F.col("metric") == DEN_METRIC)


@register("q_ratio", _sql(f"SELECT company, year, {fmt('value')} AS answer FROM {_RATIO}"))
def q_ratio(spark, sf_dir):
    return Q.answer(_ratio(spark, sf_dir))


@register("q_ratio_average", _sql(f"SELECT company, {fmt('avg(value)')} AS answer FROM {_RATIO} GROUP BY ALL"))
def q_ratio_average(spark, sf_dir):
    return Q.answer(Q.two_step(_ratio(spark, sf_dir), ["company"], "mean", item="year"))


_SUMS = "(SELECT metric, company, sum(value) AS value FROM facts GROUP BY ALL)"
_MEANS = "(SELECT metric, company, avg(value) AS value FROM facts GROUP BY ALL)"


@register("q_sum_average", _sql(f"SELECT metric, {fmt('avg(value)')} AS answer FROM {_SUMS} GROUP BY ALL"))
def q_sum_average(spark, sf_dir):
    inner = Q.q_sum(F_(spark, sf_dir), ["metric", "company"])
    return Q.answer(Q.two_step(inner, ["metric"], "mean"))


@register("q_average_sum", _sql(f"SELECT metric, {fmt('sum(value)')} AS answer FROM {_MEANS} GROUP BY ALL"))
def q_average_sum(spark, sf_dir):
    inner = Q.q_mean(F_(spark, sf_dir), ["metric", "company"])
    return Q.answer(Q.two_step(inner, ["metric"], "sum"))


@register("q_sum_sup", _sql(f"""
SELECT metric, company, {fmt('value')} AS answer FROM {_SUMS}
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, company) = 1"""))
def q_sum_sup(spark, sf_dir):
    inner = Q.q_sum(F_(spark, sf_dir), ["metric", "company"])
    return Q.answer(Q.two_step(inner, ["metric"], "sup"))


def _extreme_sql(inner: str, by: str, direction: str) -> str:
    return f"""SELECT {by}, company, {fmt('value')} AS answer FROM {inner} WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY value {direction}, company) = 1"""


@register("q_average_sup", _sql(_extreme_sql(_MEANS, "metric", "DESC")))
def q_average_sup(spark, sf_dir):
    return Q.answer(Q.two_step(Q.q_mean(F_(spark, sf_dir), ["metric", "company"]), ["metric"], "sup"))


@register("q_sum_inf", _sql(_extreme_sql(_SUMS, "metric", "ASC")))
def q_sum_inf(spark, sf_dir):
    return Q.answer(Q.two_step(Q.q_sum(F_(spark, sf_dir), ["metric", "company"]), ["metric"], "inf"))


@register("q_ratio_sup", _sql(_extreme_sql(_RATIO, "year", "DESC")))
def q_ratio_sup(spark, sf_dir):
    inner = _ratio(spark, sf_dir).where(F.col("value").isNotNull())
    return Q.answer(Q.two_step(inner, ["year"], "sup"))


def _ranking_sql(inner: str, by: str, pick: str, show: str) -> str:
    return f"""SELECT {by}, string_agg({show}, ', ' ORDER BY value DESC, company) AS answer FROM (
  SELECT * FROM {inner} WHERE value IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY value {pick}, company) <= {TOP_N}) GROUP BY ALL"""


@register("q_average_ranking", _sql(_ranking_sql(_MEANS, "metric", "ASC", "company")))
def q_average_ranking(spark, sf_dir):
    """Low form with company answers: the lowest averages, printed from high to low."""
    inner = Q.q_mean(F_(spark, sf_dir), ["metric", "company"])
    return Q.q_rank(inner, ["metric"], TOP_N, "company", pick="low", order="desc", show="company")


@register("q_ratio_ranking", _sql(_ranking_sql(_RATIO, "year", "DESC", fmt("value"))))
def q_ratio_ranking(spark, sf_dir):
    inner = _ratio(spark, sf_dir).where(F.col("value").isNotNull())
    return Q.two_step(inner, ["year"], "rank", n=TOP_N, pick="high", order="desc")


@register("q_sum_ranking", _sql(f"""
SELECT metric, string_agg({fmt('value')}, ', ' ORDER BY value DESC, company) AS answer FROM (
  SELECT * FROM {_SUMS} QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, company) <= {TOP_N})
GROUP BY ALL"""))
def q_sum_ranking(spark, sf_dir):
    inner = Q.q_sum(F_(spark, sf_dir), ["metric", "company"])
    return Q.two_step(inner, ["metric"], "rank", n=TOP_N, pick="high", order="desc")


@register("q_change_sup", _sql(f"""
SELECT metric, company, {fmt('value')} AS answer FROM (
  SELECT metric, company, b - a AS value FROM {_pair_sql('metric, company', f'year = {Y_FROM}', f'year = {Y_TO}')})
WHERE value IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, company) = 1"""))
def q_change_sup(spark, sf_dir):
    inner = Q.q_diff(F_(spark, sf_dir), ["metric", "company"], Y_FROM, Y_TO, "increase")
    return Q.answer(Q.two_step(inner, ["metric"], "sup"))


@register("q_lookup", _sql(f"SELECT company, metric, year, {fmt('value')} AS answer FROM facts"))
def q_lookup(spark, sf_dir):
    return Q.answer(Q.q_lookup(F_(spark, sf_dir)).select("company", "metric", "year", "value"))


_UNIT_CASE = " ".join(f"WHEN {r} THEN '{u}'" for r, (u, _) in REGION_UNITS.items())
_DIV_CASE = " ".join(f"WHEN {r} THEN {d}" for r, (_, d) in REGION_UNITS.items())
_RULES_SQL = " UNION ALL ".join(f"SELECT '{u}' AS unit, '{t}' AS target, {fct} AS factor" for u, t, fct in UNIT_RULES)


@register("normalize_units", _sql(f""",
reported AS (SELECT company, metric, year, CASE region {_UNIT_CASE} END AS unit,
                    value / (CASE region {_DIV_CASE} END) AS value FROM facts),
rules AS ({_RULES_SQL}),
norm AS (SELECT r.company, r.metric, r.year,
                CASE WHEN r.unit = '{TARGET_UNIT}' THEN 1.0 ELSE u.factor END AS f, r.unit, r.value
         FROM reported r LEFT JOIN (SELECT * FROM rules WHERE target = '{TARGET_UNIT}') u USING (unit))
SELECT company, metric, year, CASE WHEN f IS NULL THEN unit ELSE '{TARGET_UNIT}' END AS unit,
       CASE WHEN f IS NULL THEN 'no_rule' ELSE 'ok' END AS status, {fmt('value * f')} AS answer FROM norm"""
                                     .replace("WITH facts", "WITH facts", 1)))
def q_normalize_units(spark, sf_dir):
    f = F_(spark, sf_dir)
    unit = F.lit(None).cast("string")
    div = F.lit(None).cast("double")
    for r, (u, d) in REGION_UNITS.items():
        unit = F.when(F.col("region") == r, F.lit(u)).otherwise(unit)
        div = F.when(F.col("region") == r, F.lit(d)).otherwise(div)
    reported = f.select("company", "metric", "year", unit.alias("unit"), (F.col("value") / div).alias("value"))
    rules = spark.createDataFrame(list(UNIT_RULES), "unit string, target string, factor double")
    out = Q.normalize_units(reported, rules, TARGET_UNIT)
    return Q.answer(out.select("company", "metric", "year", "unit", "status", "value"))

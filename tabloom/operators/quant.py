"""Quantitative question operators over facts.

facts: <item cols>, year, value   (item cols e.g. company, metric)

Every operator is a grouped aggregation or a window over facts; the
question grammar of the reference corpus (sum, mean, differences,
percentages, comparisons, superlatives, rankings and their two-step
compositions) maps onto these.  Ties are broken by item name so results
are deterministic.  Answers are rendered with ``format_answer`` (A21).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions.numbers import format_answer, format_bool, format_list


def _pair(f: DataFrame, by, sel_a: Column, sel_b: Column) -> DataFrame:
    """(by..., a, b): the value selected by ``sel_a`` and by ``sel_b`` per group.

    Raises when a selection holds two different values: neither would be the answer.
    """
    def only(sel: Column) -> Column:
        low, high = F.min(F.when(sel, F.col("value"))), F.max(F.when(sel, F.col("value")))
        return F.when(low == high, low).when(low < high, F.raise_error(F.lit("several values match one selection")).cast("double"))

    return f.groupBy(*by).agg(only(sel_a).alias("a"), only(sel_b).alias("b"))


#: Answers that one pass over the facts can give together.
SINGLE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def q_together(f: DataFrame, by, **asked: str) -> DataFrame:
    """A1, A2 and A8 of the same facts in one pass: a column for each name, its question one of ``SINGLE``."""
    return f.groupBy(*by).agg(*[SINGLE[how]("value").alias(name) for name, how in asked.items()])


def q_sum(f: DataFrame, by) -> DataFrame:
    """A1: sum of the selected cells per group."""
    return q_together(f, by, value="sum")


def q_mean(f: DataFrame, by) -> DataFrame:
    """A2: arithmetic mean of the selected cells per group."""
    return q_together(f, by, value="mean")


def q_diff(f: DataFrame, by, year_from: int, year_to: int, kind: str = "reduction") -> DataFrame:
    """A3/A4: reduction = from - to; increase = to - from."""
    p = _pair(f, by, F.col("year") == year_from, F.col("year") == year_to)
    v = (F.col("a") - F.col("b")) if kind == "reduction" else (F.col("b") - F.col("a"))
    return p.select(*by, v.alias("value"))


def q_pct(f: DataFrame, by, year_from: int, year_to: int, kind: str = "reduction") -> DataFrame:
    """100 * change / from; null when the base is 0 or missing."""
    p = _pair(f, by, F.col("year") == year_from, F.col("year") == year_to)
    change = (F.col("a") - F.col("b")) if kind == "reduction" else (F.col("b") - F.col("a"))
    return p.select(*by, F.when(F.col("a") != 0, F.lit(100.0) * change / F.col("a")).alias("value"))


def q_compare(f: DataFrame, by, sel_a: Column, sel_b: Column, op: str = ">") -> DataFrame:
    """Is a op b -> 'yes' / 'no' (null when a side is missing)."""
    p = _pair(f, by, sel_a, sel_b)
    cond = {">": F.col("a") > F.col("b"), "<": F.col("a") < F.col("b")}[op]
    return p.select(*by, F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), format_bool(cond))
                    .alias("answer"))


def q_best(f: DataFrame, by, how: str = "max") -> DataFrame:
    """The highest / lowest value per group."""
    return q_together(f, by, value="max" if how == "max" else "min")


def _ordered(how: str, item: str):
    v = F.col("value").desc_nulls_last() if how == "max" else F.col("value").asc_nulls_last()
    return [v, F.col(item).asc()]


def q_best_item(f: DataFrame, by, item: str = "company", how: str = "max") -> DataFrame:
    """The item with the highest / lowest value (ties -> smallest name)."""
    w = Window.partitionBy(*by).orderBy(*_ordered(how, item))
    return (f.where(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(w))
            .where(F.col("_r") <= 1).select(*by, item, "value"))


def q_rank(f: DataFrame, by, n: int, item: str = "company", pick: str = "high", order: str = "desc",
           show: str = "value") -> DataFrame:
    """The n highest (``pick='high'``) or lowest values, printed in ``order``.

    Selection direction and print order are independent, as in the corpus
    ("the two lowest, in descending order").  ``show`` is 'value' or the item.
    """
    w = Window.partitionBy(*by).orderBy(*_ordered("max" if pick == "high" else "min", item))
    top = f.where(F.col("value").isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    key = F.col("value") if order == "asc" else -F.col("value")
    shown = format_answer("value") if show == "value" else F.col(item)
    agg = top.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col(item).alias("i"),
                                                                       shown.alias("s")))).alias("_l"))
    return agg.select(*by, format_list(F.transform("_l", lambda x: x["s"])).alias("answer"))


def q_ratio(f: DataFrame, by, sel_num: Column, sel_den: Column) -> DataFrame:
    """100 * numerator / denominator per group (null when the denominator is 0)."""
    p = _pair(f, by, sel_num, sel_den)
    return p.select(*by, F.when(F.col("b") != 0, F.lit(100.0) * F.col("a") / F.col("b")).alias("value"))


def two_step(inner: DataFrame, by, outer: str, item: str = "company", n: int = 3,
             pick: str = "high", order: str = "desc") -> DataFrame:
    """An outer aggregate over per-item inner results.

    ``inner(<by>, <item>, value)`` comes from any single-step operator
    (sum, mean, ratio, diff).  ``outer`` is 'mean', 'sum', 'sup' (value and
    item of the max), 'inf', or 'rank'.
    """
    if outer == "mean":
        return q_mean(inner, by)
    if outer == "sum":
        return q_sum(inner, by)
    if outer in ("sup", "inf"):
        return q_best_item(inner, by, item, "max" if outer == "sup" else "min")
    if outer == "rank":
        return q_rank(inner, by, n, item, pick, order)
    raise ValueError(f"unknown outer step {outer!r}")


def q_lookup(f: DataFrame, cond: Column | None = None) -> DataFrame:
    """The single cell(s) matching the question's item and year."""
    return f if cond is None else f.where(cond)


def normalize_units(f: DataFrame, rules: DataFrame, target: str) -> DataFrame:
    """Value x factor into ``target``; units without a rule get status 'no_rule'.

    ``rules(unit, target, factor)`` is a small dimension (joined, AQE
    broadcasts it); the target unit itself needs no rule.  Repeated equal
    rules count once, different factors for one unit raise.
    """
    r = rules.where(F.col("target") == target).groupBy("unit").agg(
        F.when(F.min("factor") != F.max("factor"), F.raise_error(F.concat(F.lit("several factors for unit "), F.col("unit"))).cast("double"))
        .otherwise(F.min("factor")).alias("_f"))
    j = f.join(r, "unit", "left")
    same = F.col("unit") == F.lit(target)
    factor = F.when(same, F.lit(1.0)).otherwise(F.col("_f"))
    return (j.withColumn("value", F.col("value") * factor)
            .withColumn("status", F.when(factor.isNull(), F.lit("no_rule")).otherwise(F.lit("ok")))
            .withColumn("unit", F.when(factor.isNull(), F.col("unit")).otherwise(F.lit(target)))
            .drop("_f"))


def answer(df: DataFrame, col: str = "value") -> DataFrame:
    """A21 on a numeric result column: text with two decimals."""
    return df.withColumn("answer", format_answer(col)).drop(col)

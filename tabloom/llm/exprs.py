"""Column helpers shared by the native operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable is never inlined, so the optimizer cannot copy an expensive
    expression into each of its uses (or into a per-element lambda).
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than space and 09-0D, in order; null text has none.

    Most texts hold single spaces and line ends only, so that a literal split does;
    the regex and the removal of empty strings run where the text needs them.
    """
    def split(x: Column) -> Column:
        odd = reduce(lambda a, b: a | b, (x.contains(c) for c in "\t\x0b\f\r"))
        spaced = F.when(odd, F.regexp_replace(x, r"[\x09-\x0D]", " ")).otherwise(F.replace(x, F.lit("\n"), F.lit(" ")))
        return let(spaced, lambda y: F.when(
            y.contains("  ") | y.startswith(" ") | y.endswith(" ") | (y == ""), F.array_remove(F.split(y, " ", -1), ""),
        ).otherwise(F.split(y, " ", -1)))

    return let(F.coalesce(text, F.lit("")), split)


def neighbours(values: Column, gap: int, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(values[i], values[i + gap])`` for every such pair (empty when there is none)."""
    n = F.greatest(F.size(values) - gap, F.lit(0))
    return F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(gap + 1), n), fn)

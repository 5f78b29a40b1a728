"""Maps from gathered entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_of_greatest(entries: Column) -> Column:
    """Map of an array of (key, value) structs; of several values of one key the greatest stays, null below all.

    The array is sorted once (a lambda variable is not inlined) and keeps the last entry of every key.
    """
    def last_of_key(e: Column) -> Column:
        key = lambda x: x.getField("k")
        return F.map_from_entries(F.filter(e, lambda x, i: ~F.coalesce(key(F.try_element_at(e, i + 2)) == key(x), F.lit(False))))

    named = F.transform(entries, lambda x: x.cast("struct<k:int,v:string>"))
    return F.element_at(F.transform(F.array(F.array_sort(F.filter(named, lambda x: x["k"].isNotNull()))), last_of_key), 1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row (a lambda variable is never inlined)."""
    return F.element_at(F.transform(F.array(value), body), 1)

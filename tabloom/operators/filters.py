"""Metadata filters (F1-F5) and retrieval-call validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_filters(df: DataFrame, filters) -> DataFrame:
    """conjunctive equality filter from ``(column, value)`` pairs (pushed to Parquet)."""
    filters = list(filters)
    if not filters:
        return df
    cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in filters])
    return df.where(cond)


def sectors_overlap(col: str, sectors) -> Column:
    """any of ``sectors`` is in the array column."""
    return F.arrays_overlap(F.col(col), F.array(*[F.lit(s) for s in sectors]))


def any_sector(df: DataFrame, sectors, col: str = "company_sectors") -> DataFrame:
    """F2 with F5's null-safety: rows without sectors never match; no selection keeps all."""
    sectors = list(sectors or [])
    if not sectors:
        return df
    return df.where(F.col(col).isNotNull() & sectors_overlap(col, sectors))



def validate_retrieval(filters, use_dense: bool, use_sparse: bool, use_ensemble: bool) -> None:
    """refuse a retrieval call that cannot be planned.

    One mode must be chosen.  Modes with a sparse side score within one
    document, so their first filter names it: ``("source", <non-empty text>)``.
    """
    chosen = [name for name, on in (("dense", use_dense), ("sparse", use_sparse), ("ensemble", use_ensemble)) if on]
    if len(chosen) != 1:
        raise ValueError(f"choose one retrieval mode, not {chosen or 'none'}")
    if chosen == ["dense"]:
        return
    name, value = next(iter(filters or ()), (None, None))
    if name != "source" or not isinstance(value, str) or not value:
        raise ValueError(f"{chosen[0]} retrieval starts from a source filter with a document name")

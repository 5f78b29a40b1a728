"""Size probes that decide whether a side may be broadcast.

A broadcast side must have a proven bound in bytes.  The probe reads a frame
that depends only on the *small* input (queries, codes, selections), up to the
number of rows that could fit the bound, and sums what their columns hold.
Beyond the bound the caller gets the frame back unchanged and Spark plans a
shuffle join (with AQE free to re-plan at runtime from real stage sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

#: Bytes of a side that is still broadcast, and of one row or value besides its contents.
MAX_BROADCAST_BYTES = 128 << 20
ROW_BYTES = 16


def _bytes(col: Column, kind: DataType) -> Column:
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + ROW_BYTES
    if isinstance(kind, ArrayType):
        inner = F.aggregate(col, F.lit(0), lambda a, x: a + _bytes(x, kind.elementType)) if isinstance(
            kind.elementType, (StringType, BinaryType, ArrayType)) else F.size(col) * 8
        return F.greatest(F.coalesce(inner, F.lit(0)), F.lit(0)) + ROW_BYTES
    return F.lit(8)


def has_at_most(df: DataFrame, max_bytes: int) -> bool:
    """True when the rows of ``df`` hold at most ``max_bytes`` (reads at most max_bytes / ROW_BYTES + 1 rows)."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(ROW_BYTES)).cast("long")
    return (df.limit(max_bytes // ROW_BYTES + 1).select(row.alias("b")).agg(F.sum("b")).first()[0] or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its size is proven to be at most ``max_bytes``, else ``df``."""
    return F.broadcast(df) if has_at_most(df, max_bytes) else df

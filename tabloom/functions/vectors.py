"""Vector math on ``array<float>`` columns with higher-order functions.

Everything stays inside whole-stage code generation; elements are widened to
double before multiplying so results do not depend on float32 rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_embedding(text) -> Column:
    """JSON text ``[f, f, ...]`` -> array<float>."""
    return F.from_json(_c(text), "array<float>")



def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0).cast("double"),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(a) -> Column:
    """V / |v|; a zero vector gives null (the reference yields NaN)."""
    n = norm(a)
    return F.when(n > 0, F.transform(_c(a), lambda x: x.cast("double") / n))

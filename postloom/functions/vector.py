"""Vector expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector has no length."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit_score(cos: Column, top: float = 0.85) -> Column:
    """Maps [0, top] to [0, 1] and clamps."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), cos / top))

"""Vector column expressions (arrays of doubles), kept JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x)


def l2_normalize(v: Column) -> Column:
    """Divide every component by the Euclidean norm (a zero vector stays zero)."""
    # an array of one, so that the norm is worked out once and not for each component
    norms = F.array(F.sqrt(squared_norm(v)))
    return F.transform(norms, lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))[0]


def as_double_array(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0).cast("double"), lambda acc, x: acc + x)

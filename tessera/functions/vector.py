"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Zero if a norm is zero; vectors of unlike length are an error."""
    both = norm(a) * norm(b)
    checked = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(dot(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(checked / both)


def indexable(a: Column, width: int) -> Column:
    return a.isNotNull() & (F.size(a) == width) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x))

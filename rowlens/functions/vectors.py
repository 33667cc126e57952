"""Vector expressions on ``array<float>`` columns.

These suit single comparisons and small checks. Searches over a table go
through :mod:`rowlens.operators.nearest`, which multiplies whole Arrow blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """``1 - cos``; null when either vector has length zero."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def zero_vector(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), dim)

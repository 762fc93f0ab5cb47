"""Vector functions in double precision, summed in the order of the components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """The vector over its norm; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def vector_problem(v: Column, dimensions: int, tolerance: float = 5e-3) -> Column:
    """Null, or why a stored vector is not a finite unit vector of that many components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(v.isNull() | (F.size(v) != dimensions), "shape").when(bad, "not finite").when(F.abs(norm(v) - 1) > 2 * tolerance, "not normalised")

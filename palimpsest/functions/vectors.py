"""Vector expressions over arrays of numbers, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def literal(values: list[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values])


def cosine_to(a: Column, values: list[float]) -> Column:
    """Cosine similarity to a constant vector; null for null, zero and vectors of another length."""
    size = sum(float(v) ** 2 for v in values) ** 0.5
    usable = (F.size(a) == len(values)) & (norm(a) > 0)
    return F.when(usable, dot(a, literal(values)) / (norm(a) * F.lit(size)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors; 0 where one is zero or the lengths differ, null for null."""
    usable = (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(a.isNull() | b.isNull(), None).when(usable, dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)

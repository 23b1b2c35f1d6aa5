"""Vector functions as Column expressions: float storage, double sums from left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(product, F.lit(0.0), lambda s, x: s + x)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: (x.cast("double") / n).cast("float"))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Of unit vectors: the dot product between -1 and 1, as float."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))).cast("float")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])

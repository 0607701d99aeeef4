"""Vector functions over array<float> columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine; null where the dimensions differ or a norm is zero."""
    q = F.array(*(F.lit(float(x)) for x in query))
    length = float(sum(x * x for x in map(float, query)) ** 0.5)
    bad = (F.size(vector) != len(query)) | (norm(vector) == 0) | F.lit(length == 0)
    return F.when(~bad, 1 - dot(vector, q) / (norm(vector) * F.lit(length)))

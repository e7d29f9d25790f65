"""Vector functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """One minus the cosine, 0 to 2; null where it isn't defined: another number of entries, one missing or not finite, or no length."""
    length = sum(x * x for x in query) ** 0.5
    whole = (F.size(vector) == len(query)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ratio = dot(vector, F.array(*(F.lit(float(x)) for x in query))) / (norm(vector) * F.lit(length or None))
    return F.when(whole & (norm(vector) > 0), F.lit(1.0) - ratio)

"""Vector similarity as column expressions; sums run in index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) * F.coalesce(y, F.lit(0.0))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Lenient: 0 if a length is 0. Norms that are known already can be given."""
    size = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def _same(a: Column, b: Column, value: Column) -> Column:
    message = F.concat(F.lit("vector dimensions differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(message).cast("double"))


def cosine_strict(a: Column, b: Column) -> Column:
    """As ``cosine``; different dimensions are an error."""
    return _same(a, b, cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; different dimensions are an error."""
    return _same(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))

"""Embedding vectors as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(_dot(vector, vector))


def unit(vector: Column) -> Column:
    """The vector at length 1; null for a zero vector, which has no direction."""
    length = norm(vector)
    return F.when(length > 0, F.transform(vector, lambda x: x.cast("double") / length))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null or zero or their lengths differ."""
    both = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (both > 0), _dot(a, b) / both)

"""Vector expressions on arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine distance, or squared Euclidean distance for metric l2sq."""
    if metric == "l2sq":
        gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return dot(gaps, gaps)
    return 1.0 - dot(a, b) / (norm(a) * norm(b))

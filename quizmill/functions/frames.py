"""DataFrame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hold(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    A plain withColumn may be merged into the expression that reads it. Inside a lambda that means
    computing it again for every element, and below a filter computing it twice. inline() of a
    one-element array is a step of its own that is never merged.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))

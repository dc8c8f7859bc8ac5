"""Most frequent values of groups of any size: a mergeable sketch names candidates, an exact count settles them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values that a sketch tracks. It misses none that makes up more than ERROR / TRACKED of its group.
TRACKED, ERROR = 1024, 3.5


def candidates(rows: DataFrame, value: str, by: list[str], tracked: int = TRACKED) -> DataFrame:
    """(by..., value, total): the values that the sketch of each group has, and the rows of the group. Sketches merge before
    the shuffle, so a group of any size reaches its reducer as one small row a task; nulls are not counted. A group whose sketch has no value
    left has one row with a null."""
    sketch = F.expr(f"approx_top_k(`{value}`, {tracked}, {tracked})")
    sketched = rows.groupBy(*by).agg(sketch.alias("__top"), F.count(value).alias("total"))
    return sketched.select(*by, "total", F.explode_outer(F.col("__top.item")).alias(value))


def top_values(rows: DataFrame, value: str, by: list[str], top: int, tracked: int = TRACKED) -> DataFrame:
    """(by..., value, uses, rank): the `top` most frequent values of each group, ties to the lesser value, exactly.

    Only candidates are counted, so counts of rare values never meet. A value that the sketch lacks has at most ERROR / tracked
    of its group's rows; groups whose last ranked value is no more frequent than that (or that rank fewer) are counted in full.
    """
    everything = "__all"
    keys = by or [everything]
    rows = rows if by else rows.withColumn(everything, F.lit(1))
    rows = rows.filter(F.col(value).isNotNull())
    order = W.partitionBy(*keys).orderBy(F.desc("uses"), value)

    def ranked(some: DataFrame) -> DataFrame:
        counted = some.groupBy(*keys, value).agg(F.count("*").alias("uses"))
        return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    named = candidates(rows, value, keys, tracked)
    first = ranked(rows.join(named.select(*keys, value), [*keys, value], "left_semi"))
    last = first.groupBy(*keys).agg(F.min("uses").alias("least"), F.count("*").alias("found"))
    groups = named.groupBy(*keys).agg(F.first("total").alias("total"), F.count(value).alias("kept"))
    sure = (F.col("least") > F.col("total") * F.lit(ERROR / tracked)) & (F.col("found") == top)
    every = F.col("kept").between(1, tracked * 3 // 8)  # a sketch drops values only when it is full
    unsure = groups.join(last, keys, "left").filter(~F.coalesce(sure, F.lit(False)) & ~every).select(*keys)
    settled = first.join(unsure, keys, "left_anti")
    told = settled.unionByName(ranked(rows.join(unsure, keys, "left_semi")))
    return told if by else told.drop(everything)

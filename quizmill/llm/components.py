"""Connected components of a graph whose edges no driver or task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the least node it is linked with, near or far.

    Each round every node joins its least neighbour, if that is less than itself, and the graph is drawn again between
    what has been joined, without loops and repeated edges. A star of any size is gone after one round and a chain loses
    more than half of its nodes, so rounds are few and the work shrinks from one to the next. Each round is staged.
    """

    def drawn(pairs: DataFrame) -> DataFrame:
        return staged(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())

    rest, labels = drawn(edges), None
    while not rest.isEmpty():
        both = rest.union(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        joined = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("up")))
        if labels is None:
            labels = joined.withColumnRenamed("up", "root")
        else:
            next_up = joined.withColumnRenamed("node", "root")
            labels = staged(labels.join(next_up, "root", "left").select("node", F.coalesce("up", "root").alias("root")))
        left, right = (joined.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        rest = drawn(rest.join(left, "a").join(right, "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if labels is None else labels

"""Approximate nearest neighbours: stable projections in a kd-tree, verified until a chi-square stopping test holds."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Projected dimensions, rows of a block (one tree each) and of a leaf, queries that visit a block together, rows verified
#: between two stopping tests, and the chance that the test must give of having the neighbours.
DIMS, BLOCK, LEAF, QUERIES, STEP, SURE = 32, 4096, 32, 1024, 64, 0.95
NEIGHBOURS, SEED = 5, 17


def chi_square(x: float, k: int) -> float:
    """Distribution function of the chi-square law with k degrees of freedom (series of the incomplete gamma)."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-12:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * exp(a * log(z) - z - lgamma(a)))


def quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 20.0 * k
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, k) < p else (lo, mid)
    return hi


def valid(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    number = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(number, lambda x: x != 0), F.lit(False))


class Tree:
    """A kd-tree over projected rows: halves along the widest side until LEAF rows are left; keeps each leaf's box."""

    def __init__(self, low: np.ndarray) -> None:
        self.low, self.leaves = low, []
        todo = [np.arange(len(low))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                self.leaves.append(rows)
                continue
            side = np.ptp(low[rows], axis=0).argmax()
            half = np.argpartition(low[rows, side], len(rows) // 2)
            todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
        self.floor = np.array([low[r].min(axis=0) for r in self.leaves])
        self.ceil = np.array([low[r].max(axis=0) for r in self.leaves])

    def search(self, at: np.ndarray, query: np.ndarray, unit: np.ndarray, names: np.ndarray, own: int, k: int, ratio: float) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest rows of unit to query, in growing projected distance. A point at the k-th best distance d found so
        far projects beyond r with a chance of 1 - chi_square((r / d) ** 2); the walk ends when r passes d by `ratio`."""
        gap = np.maximum(0, np.maximum(self.floor - at, at - self.ceil))
        box = (gap * gap).sum(axis=1)
        order = np.argsort(box)
        waiting, far = np.zeros(0, int), np.zeros(0)
        best, score = np.zeros(0, int), np.zeros(0)
        i, width, verified = 0, 4, 0
        while i < len(order) or len(waiting):
            rows = np.concatenate([self.leaves[j] for j in order[i : i + width]]) if i < len(order) else np.zeros(0, int)
            i, width = i + width, width * 2
            waiting = np.concatenate([waiting, rows])
            far = np.concatenate([far, ((self.low[rows] - at) ** 2).sum(axis=1)])
            reach = box[order[i]] if i < len(order) else np.inf  # nothing unseen is nearer than this
            ready = np.flatnonzero(far <= reach)
            ready = ready[np.argsort(far[ready], kind="stable")]
            for j in range(0, len(ready), STEP):
                if len(best) == k and far[ready[j]] > ratio * max(0.0, 2 - 2 * score.min()) + 1e-12:
                    return best, score, verified
                rows = waiting[ready[j : j + STEP]]
                rows = rows[names[rows] != own]
                verified += len(rows)
                best = np.concatenate([best, rows])
                score = np.concatenate([score, (unit[rows] * query).sum(axis=1)])
                if len(best) > k:
                    top = np.lexsort((names[best], -score))[:k]
                    best, score = best[top], score[top]
            left = far > reach
            waiting, far = waiting[left], far[left]
        return best, score, verified


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, dims: int = DIMS, sure: float = SURE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) the k rows of vectors with the largest
    cosine, its own id left out, ties to the smaller id; score is the cosine of the original vectors in double precision.

    Rows are dealt into blocks of about BLOCK by a hash of their id; each block is indexed by a tree of its own over dims
    Gaussian projections of its unit vectors, and groups of queries visit every block. Each visit keeps k rows, so a query
    brings k rows a block to its final ranking. For unit vectors the nearest is the one of largest cosine, and a point at
    distance d projects to d times the root of a chi-square variable: the walk in a block ends when a point nearer than
    the k-th found would, with a chance of `sure`, have been seen.

    Null, zero and non-finite vectors and rows of null id take no part. Vectors of another length than the query's are
    no candidates for it. A row that repeats counts once. Fewer than k candidates are all returned; empty tables give none.
    """
    usable = F.col("vec_id").isNotNull() & valid(F.col("embedding"))
    pick = lambda df: df.filter(usable).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.size("embedding").alias("width"))
    rows, asked = pick(vectors), pick(queries)
    blocks = max(1, -(-rows.count() // BLOCK))
    crowds = max(1, -(-asked.count() // QUERIES))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("crowd", F.pmod(F.xxhash64("vec_id"), F.lit(crowds)).cast("int"))
    left = rows.withColumn("crowd", F.explode(F.sequence(F.lit(0), F.lit(crowds - 1))))
    right = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ratio = quantile(sure, dims)

    def visit(some: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(some) and len(wanted):
            some = some.drop_duplicates("vec_id").sort_values("vec_id", ignore_index=True)
            names = some["vec_id"].to_numpy()
            x, q = np.stack(some["v"]), np.stack(wanted["v"])
            unit, asking = (m / np.linalg.norm(m / np.abs(m).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(m).max(axis=1, keepdims=True) for m in (x, q))
            plane = np.random.default_rng(SEED).normal(size=(x.shape[1], dims))
            tree, low = Tree(unit @ plane), asking @ plane
            for name, at, v in zip(wanted["vec_id"], low, asking, strict=True):
                best, score, _ = tree.search(at, v, unit, names, name, k, ratio)
                out.append(pd.DataFrame({"query_id": name, "vec_id": names[best], "score": score}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["block", "crowd", "width"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(visit, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

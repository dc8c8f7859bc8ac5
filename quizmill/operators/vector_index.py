"""Inverted-file index of stored chunks: vectors by nearest cell, kept as tables and probed by equi-joins.

Two tables under one folder: `rows`, every chunk with its vector and that vector's length, one folder per cell; and `stats`, which has for each
collection and cell how many of its chunks lie there and how far the farthest stands from the centre. Centres are learnt
from a bounded sample; every chunk is indexed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill.functions import vectors as vx
from quizmill.functions.frames import hold

#: Vectors that the centres are learnt from, and the most centres there can be.
SAMPLE, MOST_CELLS = 20_000, 4_096
#: Cells that a query looks at first.
PROBES = 4
#: Slack of the exact way's bound, for angles in double precision.
_SLACK = 1e-7


def usable(vector: Column) -> Column:
    """A vector that has a direction: not null, not zero, without null or non-finite components."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vector: Column, length: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") / length)


def _units(chunks: DataFrame) -> DataFrame:
    sized = hold(chunks.filter(usable(F.col("embedding"))), length=vx.norm(F.col("embedding")))
    return sized.withColumn("unit", unit(F.col("embedding"), F.col("length")))


def cells_for(rows: int) -> int:
    """Centres for so many rows: their square root, so that a query's centres and the rows of a cell grow alike."""
    return max(2, min(MOST_CELLS, math.isqrt(rows)))


def learn(chunks: DataFrame, cells: int | None = None, seed: int = 5) -> DataFrame:
    """(cell, centre): spherical k-means over the SAMPLE chunks of least hashed id, so reruns learn alike. At least one
    chunk must have a direction."""
    units = _units(chunks)
    stored = units.count()
    if not stored:
        raise ValueError("no vector to learn centres from")
    cells = cells or cells_for(stored)
    sample = units.orderBy(F.xxhash64("collection", "chunk_id"), "chunk_id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return chunks.sparkSession.createDataFrame(rows, "cell int, centre array<double>")


def _nearest(batches: Iterator[pd.DataFrame], matrix: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            cosines = np.stack(batch.pop("unit").to_list()) @ matrix.T
            near = np.argmax(cosines, axis=1)
            yield batch.assign(cell=near.astype(np.int32), away=np.arccos(np.clip(cosines[np.arange(len(near)), near], -1.0, 1.0)))


def _placed(chunks: DataFrame, centres: DataFrame) -> DataFrame:
    """Chunks with the length of their vector, nearest cell and the angle to its centre. At most MOST_CELLS centres travel to the tasks."""
    matrix = np.array([r.centre for r in centres.orderBy("cell").collect()])
    matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    units = _units(chunks)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema if f.name != "unit") + ", cell int, away double"
    return units.mapInPandas(partial(_nearest, matrix=matrix), schema)


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def append(chunks: DataFrame, centres: DataFrame, path: str) -> None:
    """Index more chunks (collection, chunk_id, embedding, ...) under the same centres: rows go to their cell's folder, and
    the counts and radii of what came are written beside the earlier ones. Chunks without a direction are left out."""
    placed = _placed(chunks, centres)
    placed.drop("away").repartition("cell").write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    fresh = _placed(chunks.select("collection", "embedding"), centres)
    fresh.groupBy("collection", "cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).write.mode("append").parquet(f"{path}/stats")


def build(chunks: DataFrame, path: str, cells: int | None = None) -> None:
    """Learn the centres of a new index and store all chunks in it."""
    learn(chunks, cells).write.parquet(f"{path}/centres")
    append(chunks, chunks.sparkSession.read.parquet(f"{path}/centres"), path)


def _scored(asked: DataFrame, rows: DataFrame) -> DataFrame:
    met = asked.join(rows, ["collection", "cell"])
    near = hold(met, unit=unit(F.col("embedding"), F.col("length")))
    return hold(near, distance=F.round(1.0 - vx.dot(F.col("unit"), F.col("asked")), 9)).drop("asked", "unit", "embedding", "length")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def probes(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(query_id, collection, asked, cell, n, least, turn): the cells of each query's collection, nearest centre first, and
    the least angle at which a chunk of the cell can stand."""
    centres = spark.read.parquet(f"{path}/centres")
    stats = spark.read.parquet(f"{path}/stats").groupBy("collection", "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
    known = stats.join(F.broadcast(centres), "cell")  # at most MOST_CELLS centres
    sized = hold(queries.filter(usable(F.col("vector"))), length=vx.norm(F.col("vector")))
    asked = sized.select("query_id", "collection", unit(F.col("vector"), F.col("length")).alias("asked"))
    met = hold(asked.join(known, "collection"), apart=angle(vx.dot(F.col("centre"), F.col("asked")) / vx.norm(F.col("centre"))))
    turn = F.row_number().over(W.partitionBy("query_id").orderBy("apart", "cell"))
    return met.select("query_id", "collection", "asked", "cell", "n", (F.col("apart") - F.col("radius") - _SLACK).alias("least"), turn.alias("turn"))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, first: int = PROBES, exact: bool = False) -> DataFrame:
    """The k nearest chunks of each query (query_id, collection, vector) in its collection by cosine distance, found in the
    `first` nearest cells: the chunks' columns, query_id, distance and rank.

    `exact` then also looks at every cell that can hold something nearer than the k-th found: a cell's chunks stand no
    nearer than the angle to its centre less its radius. The result is that of a full scan. Queries of a collection that
    is not stored, and queries without a direction, find nothing; ties go to the lesser chunk_id.
    """
    rows = spark.read.parquet(f"{path}/rows")
    asked = probes(spark, path, queries)
    near = _best(_scored(asked.filter(F.col("turn") <= first).select("query_id", "collection", "asked", "cell"), rows), k)
    if not exact:
        return near
    reach = near.groupBy("query_id").agg(F.when(F.count("*") >= k, angle(1.0 - F.max("distance"))).alias("reach"))
    later = asked.filter(F.col("turn") > first).join(reach, "query_id", "left").filter(F.col("reach").isNull() | (F.col("least") <= F.col("reach")))
    far = _scored(later.select("query_id", "collection", "asked", "cell"), rows)
    return _best(near.drop("rank").unionByName(far), k)


def compared(spark: SparkSession, path: str, queries: DataFrame, first: int = PROBES) -> DataFrame:
    """(query_id, compared, stored): rows that a search of `first` cells scores, and rows of the query's collection."""
    asked = probes(spark, path, queries)
    return asked.groupBy("query_id").agg(F.sum(F.when(F.col("turn") <= first, F.col("n")).otherwise(0)).alias("compared"), F.sum("n").alias("stored"))

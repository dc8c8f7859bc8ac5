"""Stores that are changed where they lie: a bucketed vector cache, a day-partitioned log with upserts, folders of collections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.operators.oplog import latest_per

#: Buckets of a vector store: fixed when it is made, at least the parallelism its joins are to have.
BUCKETS = 32


def written(df: DataFrame, path: str) -> DataFrame:
    """df written once and read back: it is not computed again, and does not change when its inputs do."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed(texts: DataFrame) -> DataFrame:
    """texts with text_hash, the key of a vector store."""
    return texts.withColumn("text_hash", F.sha2("text", 256))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> bool:
    """Take one folder away; nothing else is read or written."""
    files, where = _files(spark, path)
    return files.delete(where, True)


# -- vectors by text hash


class VectorStore:
    """Vectors by text hash (text_hash, embedding) as a table bucketed and sorted by its key under `path`.

    A look-up joins on the key: the stored side keeps its buckets and is never shuffled, only what is asked for moves to
    them. Every append adds one sorted file to each bucket that gets rows. The table is known to the session's catalog
    under `name`; opening a path that has files takes them over.
    """

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"vectors_{uuid.uuid4().hex}"
        if not spark.catalog.tableExists(self.name):
            spark.sql(
                f"CREATE TABLE {self.name} (text_hash STRING, embedding ARRAY<FLOAT>) USING parquet "
                f"CLUSTERED BY (text_hash) SORTED BY (text_hash) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def known(self, asked: DataFrame) -> DataFrame:
        """(text_hash, embedding): what the store has of the distinct hashes of `asked`."""
        return self.rows().join(asked.select("text_hash").distinct().hint("shuffle_merge"), "text_hash", "left_semi")

    def missing(self, asked: DataFrame) -> DataFrame:
        """(text_hash): the distinct hashes of `asked` that the store lacks."""
        return asked.select("text_hash").distinct().join(self.rows().select("text_hash").hint("shuffle_merge"), "text_hash", "left_anti")

    def add(self, vectors: DataFrame) -> None:
        """Append (text_hash, embedding), one of each hash, leaving out what is stored already or is null; a run that is repeated
        after a failure adds only what is missing."""
        good = vectors.filter("text_hash IS NOT NULL AND embedding IS NOT NULL").groupBy("text_hash").agg(F.first("embedding").alias("embedding"))
        fresh = good.join(self.rows().select("text_hash").hint("shuffle_merge"), "text_hash", "left_anti")
        placed = fresh.select("text_hash", F.col("embedding").cast("array<float>").alias("embedding")).repartition(self.buckets, "text_hash")
        placed.write.mode("append").format("parquet").bucketBy(self.buckets, "text_hash").sortBy("text_hash").option("path", self.path).saveAsTable(self.name)


# -- the session log


def merge_log(rows: DataFrame, path: str, key: str = "task_id", ts: str = "timestamp", *order: str) -> None:
    """Insert or replace rows in a log stored by day (dt) under `path`: of rows with one key the latest by ts and `order`
    stays, stored or new, whatever day it falls on.

    Only touched days are rewritten: those of the new rows, and those on which a key of theirs is stored now. Their new
    content is written beside the log first and put in place from there, so a merge that failed half-way is finished by
    the next call, and merging the same rows again changes nothing. Null days are a day of their own.
    """
    spark = rows.sparkSession
    _finish(spark, path)
    fresh = latest_per(rows.withColumn("dt", F.to_date(ts)), key, ts, *order)
    if not exists(spark, path):
        spark.createDataFrame([], fresh.schema).write.partitionBy("dt").parquet(path)
    days = "coalesce(cast(dt as string), '')"
    stored = spark.read.schema(fresh.schema).parquet(path)
    held = stored.join(fresh.select(key).distinct(), key, "left_semi")
    touched = held.selectExpr(f"{days} AS day").union(fresh.selectExpr(f"{days} AS day")).distinct()
    touched = written(touched, f"{path}_days")
    names = [r.day for r in touched.collect()]  # a day each, as many as the log has folders at most
    old = stored.filter(F.expr(days).isin(names))
    merged = latest_per(old.select(*fresh.columns).unionByName(fresh), key, ts, *order)
    merged.repartition("dt").write.mode("overwrite").parquet(f"{path}_merge")
    _finish(spark, path)


def _finish(spark: SparkSession, path: str) -> None:
    """Put a complete merge in place: days that keep rows are overwritten, emptied ones are removed."""
    if exists(spark, f"{path}_merge/_SUCCESS"):
        merged = spark.read.parquet(f"{path}_merge")
        merged.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
        touched = spark.read.parquet(f"{path}_days")
        left = merged.selectExpr("coalesce(cast(dt as string), '') AS day").distinct()
        for r in touched.join(left, "day", "left_anti").collect():
            remove(spark, f"{path}/dt={r.day or '__HIVE_DEFAULT_PARTITION__'}")
    remove(spark, f"{path}_merge")


def read_merged(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The log as it stands; a merge that is not in place yet is finished first."""
    _finish(spark, path)
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def append_stats(rows: DataFrame, path: str) -> None:
    """Append statistics of generation runs, stamped with the time of recording, one folder per day of it."""
    stamped = rows.withColumn("recorded_at", F.current_timestamp())
    stamped.withColumn("dt", F.to_date("recorded_at")).write.mode("append").partitionBy("dt").parquet(path)


# -- collections of chunks


def remove_collection(spark: SparkSession, path: str, collection: int | str) -> bool:
    """Delete one collection of a chunk store where it lies: its folder goes, no other is listed, read or written. Tells
    whether there was one."""
    return remove(spark, f"{path}/collection={collection}")

"""Progress events as streams: hourly counts, sliding call rates, activity sessions, latest status."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
DELAY = "10 minutes"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Event files of a folder as a stream, each event once, late ones dropped by the watermark."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).parquet(folder)
    return (
        raw.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", DELAY)
        .dropDuplicatesWithinWatermark(["event_id"])
    )


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def hourly_progress(events: DataFrame) -> DataFrame:
    """Events per hour and type."""
    return events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("events")).select(
        stamp("window.start").alias("window_start"), "event_type", "events"
    )


def sliding_rate(events: DataFrame) -> DataFrame:
    """Calls per endpoint in one-hour windows that start every quarter of an hour."""
    endpoint = F.when(F.col("event_type").isin("purchase", "error"), "completions").otherwise("embeddings")
    calls = events.withColumn("endpoint", endpoint)
    return calls.groupBy(F.window("ts", "1 hour", "15 minutes"), "endpoint").agg(F.count("*").alias("calls")).select(
        stamp("window.start").alias("window_start"), "endpoint", "calls"
    )


def activity(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of activity per user."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events")).select(
        F.col("user_id").alias("task_id"), stamp("s.start").alias("started"), stamp("s.end").alias("ended"), "events"
    )


def latest_status(events: DataFrame) -> DataFrame:
    """Newest event per user; run_latest() keeps it up to date."""
    newest = F.max_by("event_type", F.struct("ts", "event_id")).alias("step")
    return events.groupBy("user_id").agg(newest).withColumnRenamed("user_id", "task_id")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one the cluster names; local mode may use its own disk."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/run-{uuid.uuid4().hex}"


def run_available(stream: DataFrame, out: str) -> DataFrame:
    """Process everything available to files, then read them back."""
    spark = stream.sparkSession
    schema = stream.schema
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{out}/state")
        .option("path", f"{out}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/rows")


def run_latest(stream: DataFrame, out: str, key: str = "task_id") -> DataFrame:
    """Process everything available in update mode: every batch appends the keys that it changed, under its number, and
    the last row of a key counts. A batch that is run again repeats its rows, which changes nothing."""
    spark = stream.sparkSession
    rest = [c for c in stream.columns if c != key]

    def append(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{out}/rows")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .foreachBatch(append)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{out}/rows")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")

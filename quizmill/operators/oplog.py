"""Operations log: sessions, task progress, caches, rate windows.

Ordered computations never put one key's whole history in one task. They work inside time
buckets and carry one row per bucket across (see next_in_order and running_totals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx

SECOND = 1_000_000


def micros(c: Column | str) -> Column:
    return F.unix_micros(c)


def latest_per(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The newest row per key. max_by combines map-side, so repeated reports of one key are cheap."""
    rest = [c for c in df.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(key).agg(newest).select(key, "r.*")


def upsert_sessions(rows: DataFrame) -> DataFrame:
    """Insert-or-replace by task: the latest report of each task wins."""
    return latest_per(rows, "task_id", "timestamp", "event_id")


def append_metrics(metrics: DataFrame, sessions: DataFrame) -> DataFrame:
    """Attach question metrics to the session of their task; metrics without a session are dropped."""
    return metrics.join(sessions.select("task_id", F.col("event_id").alias("session_id")), "task_id")


def since(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    start = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return rows.filter(F.col("timestamp") > start)


def performance_summary(sessions: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(sessions, as_of, days).agg(
        F.count("*").alias("total_sessions"),
        F.round(F.avg("success_rate"), 6).alias("avg_success_rate"),
        F.round(F.avg("generation_time"), 6).alias("avg_generation_time"),
        F.round(F.avg("average_quality_score"), 6).alias("avg_quality"),
        F.sum("num_questions_generated").alias("total_questions"),
    )


def daily(rows: DataFrame, **averages: str) -> DataFrame:
    """Average of each named column per day, ordered by day."""
    day = F.date_format("timestamp", "yyyy-MM-dd").alias("day")
    return rows.groupBy(day).agg(*[F.round(F.avg(c), 6).alias(n) for n, c in averages.items()]).orderBy("day")


def difficulty_performance(rows: DataFrame) -> DataFrame:
    return rows.groupBy("difficulty").agg(
        F.round(F.avg("generation_time"), 6).alias("avg_time"), F.count("*").alias("sessions")
    )


# --- caches --------------------------------------------------------------------


def cache_stats(ops: DataFrame) -> DataFrame:
    """Reading an expired entry is an eviction, not a miss."""
    kinds = {"hits": "hit", "misses": "miss", "saves": "save", "evictions": "expired"}
    agg = ops.groupBy("cache_type").agg(
        *[F.count_if(F.col("operation") == op).alias(n) for n, op in kinds.items()]
    )
    total = F.col("hits") + F.col("misses")
    return agg.withColumns(
        {
            "total_requests": total,
            "hit_rate_percent": F.when(total > 0, F.round(F.round(F.col("hits") * 100 / total, 9), 2)).otherwise(0.0),
        }
    )


def cache_sizes(entries: DataFrame) -> DataFrame:
    mb = F.round(F.round(F.sum("bytes") / (1024 * 1024), 9), 2)
    return entries.groupBy("cache_type").agg(F.sum("bytes").alias("total_bytes"), mb.alias("size_mb"))


def cache_advice(ops: DataFrame) -> DataFrame:
    m = lx.CACHE_ADVICE
    advice = tx.issues((F.col("hit_rate_percent") < 20, m["hits"]), (F.col("size_mb") > 100, m["size"]))
    return (
        cache_stats(ops).join(cache_sizes(ops), "cache_type").select("cache_type", advice.alias("recommendations"))
    )


def ttl_split(entries: DataFrame, as_of: str) -> DataFrame:
    """Adds expired: older than its tier's time to live at as_of."""
    limit = tx.lookup(F.col("cache_type"), {k: str(v) for k, v in lx.TTL_MINUTES.items()}).cast("bigint")
    age = micros(F.lit(as_of).cast("timestamp")) - micros("stored_at")
    return entries.withColumn("expired", age > limit * (60 * SECOND))


# --- tasks ---------------------------------------------------------------------


def latest_status(events: DataFrame) -> DataFrame:
    return latest_per(events, "task_id", "ts", "event_id")


def task_health(events: DataFrame) -> DataFrame:
    return latest_status(events).groupBy("status").agg(F.count("*").alias("tasks"))


def retry_rows(events: DataFrame) -> DataFrame:
    """A retry restarts a failed task after the upload step; other tasks are rejected."""
    failed = F.col("status") == "error"
    return latest_status(events).select(
        "task_id",
        "status",
        failed.alias("retry"),
        F.when(failed, "text_extraction").alias("restart_step"),
        F.when(failed, F.lit(15).cast("bigint")).alias("restart_percentage"),
    )


def _bucketed(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("bucket", F.date_trunc("hour", ts))


def next_in_order(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Adds next_ts: the time of the key's following event.

    Inside an hour by window; the last event of an hour takes the first event of the key's next
    active hour, found on a table with one row per key and hour.
    """
    hours = _bucketed(df, ts)
    inner = W.partitionBy(key, "bucket").orderBy(ts, tie)
    firsts = hours.groupBy(key, "bucket").agg(F.min(ts).alias("first_ts"))
    following = firsts.select(
        key, "bucket", F.lead("first_ts").over(W.partitionBy(key).orderBy("bucket")).alias("following_ts")
    )
    return (
        hours.withColumn("next_ts", F.lead(ts).over(inner))
        .join(following, [key, "bucket"])
        .withColumn("next_ts", F.coalesce("next_ts", "following_ts"))
        .drop("bucket", "following_ts")
    )


def step_durations(events: DataFrame) -> DataFrame:
    """Seconds until the task's next step."""
    gap = (micros("next_ts") - micros("ts")) / SECOND
    return next_in_order(events, "task_id", "ts", "event_id").select(
        "task_id", "event_id", "step", F.round(gap, 6).alias("seconds")
    )


def running_totals(df: DataFrame, key: str, ts: str, tie: str, **sums: Column) -> DataFrame:
    """Running sums per key in time order: totals of earlier hours plus the sum inside the hour."""
    hours = _bucketed(df, ts).withColumns({"_" + n: c for n, c in sums.items()})
    per_hour = hours.groupBy(key, "bucket").agg(*[F.sum("_" + n).alias("_hour_" + n) for n in sums])
    earlier = W.partitionBy(key).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = per_hour.select(
        key, "bucket", *[F.coalesce(F.sum("_hour_" + n).over(earlier), F.lit(0)).alias("_before_" + n) for n in sums]
    )
    inner = W.partitionBy(key, "bucket").orderBy(ts, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = hours.withColumns({n: F.sum("_" + n).over(inner) for n in sums})
    out = inside.join(carried, [key, "bucket"])
    return out.withColumns({n: F.col(n) + F.col("_before_" + n) for n in sums}).select(*df.columns, *sums)


def progress_log(events: DataFrame) -> DataFrame:
    """Questions generated and failed attempts so far, at every event of a task."""
    failed = F.col("status") == "error"
    return running_totals(
        events,
        "task_id",
        "ts",
        "event_id",
        questions_generated=F.when(failed, 0).otherwise(F.col("percentage") % 5),
        failed_attempts=failed.cast("bigint"),
    ).select("task_id", "event_id", "step", "questions_generated", "failed_attempts")


def progress_message(stage: Column, percentage: Column) -> Column:
    rows = {k: v for k, v in lx.STAGE_MESSAGES.items()}
    table = F.create_map(*[x for k, v in rows.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    texts = F.coalesce(F.try_element_at(table, stage), F.array(*[F.lit(t) for t in lx.STAGE_MESSAGE_DEFAULT]))
    return F.get(texts, F.when(percentage < 30, 0).when(percentage < 90, 1).otherwise(2))


# --- rate windows -----------------------------------------------------------------


def rate_window(calls: DataFrame) -> DataFrame:
    """Earlier calls of the same endpoint in the trailing minute and hour, and the wait when at the limit.

    Groups are (endpoint, minute), so a busy endpoint is many small groups. A call counts in its own
    minute, and is also sent to the next one (the minute frame reaches there) and to the one an hour
    later (where the hour frame begins in the middle of a minute). The 59 whole minutes in between
    come from a table with one row per endpoint and minute.
    """
    minute_len = 60 * SECOND
    t = calls.withColumn("t", micros("ts")).withColumn("own", F.expr(f"t div {minute_len}"))
    per_minute = t.groupBy("endpoint", "own").agg(F.count("*").alias("n"))
    hour_frame = W.partitionBy("endpoint").orderBy("own").rangeBetween(-59, -1)
    between = per_minute.select("endpoint", "own", F.coalesce(F.sum("n").over(hour_frame), F.lit(0)).alias("between"))

    rows = t.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1, F.col("own") + 60)))
    w = W.partitionBy("endpoint", "bucket").orderBy("t")
    minute = w.rangeBetween(-(minute_len - 1), -1)
    edge = w.rangeBetween(-(60 * minute_len - 1), -(2 * minute_len + 1))
    counted = (
        rows.withColumns(
            {
                "calls_minute": F.count("*").over(minute),
                "last_call": F.max("t").over(minute),
                "own_before": F.coalesce(F.sum((F.col("own") == F.col("bucket")).cast("bigint")).over(minute), F.lit(0)),
                "edge": F.count("*").over(edge),
            }
        )
        .filter(F.col("bucket") == F.col("own"))
        .join(between, ["endpoint", "own"])
    )
    limit = tx.lookup(F.col("endpoint"), {k: str(v[0]) for k, v in lx.RATE_LIMITS.items()}).cast("bigint")
    at_limit = F.col("calls_minute") >= limit
    wait = 60 - (F.col("t") - F.col("last_call")) / SECOND
    return counted.select(
        "event_id",
        "endpoint",
        "calls_minute",
        (F.col("own_before") + F.col("between") + F.col("edge")).alias("calls_hour"),
        at_limit.alias("at_limit"),
        F.when(at_limit, F.round(wait, 6)).otherwise(0.0).alias("wait_seconds"),
    )


def completion_eta(endpoint: Column, remaining: Column) -> Column:
    limit = tx.lookup(endpoint, {k: str(v[0]) for k, v in lx.RATE_LIMITS.items()}, "0").cast("bigint")
    return F.when(limit > 0, F.round(remaining / limit * 60, 6)).otherwise(0.0)


def activity_sessions(events: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Bursts of activity per task: a run ends when the task is idle for the gap.

    Events sort within (task, hour); the last event of a task's earlier hours comes from a table with one row per task and
    hour. What an hour holds of runs is aggregated before the task's hours meet, so a task with most of all events meets
    as a few rows an hour.
    """
    gap, hour_len = gap_minutes * 60 * SECOND, 3600 * SECOND
    e = events.withColumn("t", micros("ts")).withColumn("hour", F.expr(f"t div {hour_len}"))
    before = F.lag("last").over(W.partitionBy("task_id").orderBy("hour"))
    carry = e.groupBy("task_id", "hour").agg(F.max("t").alias("last")).select("task_id", "hour", before.alias("before"))
    local = W.partitionBy("task_id", "hour").orderBy("t", "event_id")
    idle = F.col("t") - F.coalesce(F.lag("t").over(local), F.col("before"))
    rows = e.join(carry, ["task_id", "hour"]).withColumn("fresh", F.coalesce(idle >= gap, F.lit(True)).cast("int"))
    runs = rows.withColumn("run", F.sum("fresh").over(local.rowsBetween(W.unboundedPreceding, 0)))
    parts = runs.groupBy("task_id", "hour", "run").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("events"), F.count_if(F.col("status") == "error").alias("errors")
    )
    along = W.partitionBy("task_id").orderBy("hour", "run").rowsBetween(W.unboundedPreceding, 0)
    numbered = parts.withColumn("session", F.sum((F.col("run") > 0).cast("int")).over(along))
    whole = numbered.groupBy("task_id", "session").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events"), F.sum("errors").alias("errors")
    )

    def stamp(c: Column) -> Column:
        return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")

    return whole.select("task_id", stamp(F.col("first")).alias("started"), stamp(F.col("last") + gap).alias("ended"), "events", "errors")


# --- estimates ----------------------------------------------------------------------


def processing_estimate(pages: Column, size_bytes: Column) -> Column:
    """Seconds: two per page or five per MB, whichever is more, plus a fifth; between 10 and 300."""
    base = F.greatest(pages * 2.0, size_bytes / (1024 * 1024) * 5) * 1.2
    return F.greatest(F.lit(10), F.least(F.lit(300), base.cast("int"))).cast("bigint")


def stage_estimate(pages: Column, size_mb: Column, questions: Column) -> dict[str, Column]:
    stages = {
        "upload": F.lit(2.0),
        "text_extraction": pages * 1.5,
        "chunking": pages * 0.5,
        "embedding_generation": F.greatest(F.lit(10.0), pages * 2.5),
        "vector_storage": F.lit(3.0),
        "question_generation": questions * 8.0,
    }
    factor = F.greatest(F.lit(1.0), size_mb / 5.0)
    seconds = sum(stages.values(), F.lit(0.0)) * factor
    return {
        **stages,
        "size_factor": F.round(factor, 6),
        "total_seconds": seconds.cast("bigint"),
        "total_minutes": F.round(F.round(seconds / 60, 9), 1),
    }


def split_outcome(results: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """(successful, failed) by the error column."""
    return results.filter(F.col(error).isNull()).drop(error), results.filter(F.col(error).isNotNull())

"""Registered queries on the operations log."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.operators import oplog, scoring, stats
from quizmill.plans import sql as S
from quizmill.plans.common import bank, flat, scored
from quizmill.plans.questions import SCORE
from quizmill.session import load
from quizmill.sources import bridge, stores
from quizmill.streaming.progress import scratch

AS_OF = "2024-01-31 00:00:00"
QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body)


SES = [S.SESSIONS]
UPSERT = 'latest AS (SELECT * FROM session_rows QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY "timestamp" DESC, event_id DESC) = 1)'
LOG_COLUMNS = "task_id, event_id, strftime(\"timestamp\", '%Y-%m-%d %H:%M:%S.%f') AS logged_at, difficulty, num_questions_requested, num_questions_generated, generation_time, success_rate, average_quality_score"


def log_view(df):
    return df.select(
        "task_id", "event_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("logged_at"), "difficulty",
        "num_questions_requested", "num_questions_generated", "generation_time", "success_rate", "average_quality_score",
    )


def sessions(s, d):
    return oplog.upsert_sessions(bridge.session_rows(s, d))


def recent_sessions(s, d, days=30):
    """The latest report of each task, of those inside the window: a task's latest report lies in the window if any does,
    so the window is cut at the scan, where day partitions are pruned, and only its rows are sorted out by task."""
    return oplog.upsert_sessions(oplog.since(bridge.session_rows(s, d), AS_OF, days))


add("scan_session_log", lambda s, d: log_view(bridge.session_rows(s, d)), SES, f"SELECT {LOG_COLUMNS} FROM session_rows")
add("session_upsert", lambda s, d: log_view(sessions(s, d)), SES + [UPSERT], f"SELECT {LOG_COLUMNS} FROM latest")


def metrics(s, d):
    """One metrics row per question, reported under its document's task of one day."""
    return scored(s, d).select(
        F.concat(F.col("assessment_id"), F.lit("-20240105")).alias("task_id"),
        "question_index",
        F.col("overall_score").alias("quality_score"),
        "difficulty",
        F.col("bloom_level").alias("cognitive_level"),
        F.size("distractors").cast("bigint").alias("distractor_count"),
        F.col("strong_count").alias("strong_distractor_count"),
        F.array_join(F.transform("distractors", lambda x: x["misconception_type"]), ",").alias("misconception_types"),
    )


METRICS = """
metrics AS (SELECT assessment_id || '-20240105' AS task_id, question_index, overall_score AS quality_score, difficulty, bloom_level AS cognitive_level,
  len(distractors) AS distractor_count, strong_count AS strong_distractor_count, coalesce(array_to_string([x.misconception_type FOR x IN distractors], ','), '') AS misconception_types FROM scored)
"""
add("metrics_extract", metrics, [S.BANK, S.SCORED, METRICS], "SELECT * FROM metrics")
add(
    "metrics_append",
    lambda s, d: oplog.append_metrics(metrics(s, d), sessions(s, d)),
    [S.BANK, S.SCORED, METRICS, S.SESSIONS, UPSERT],
    "SELECT m.*, l.event_id AS session_id FROM metrics m JOIN latest l ON l.task_id = m.task_id",
)
REQUESTS = "requests AS (SELECT doc_id AS assessment_id, 1 + doc_id % 12 AS requested, (doc_id % 90) / 2.0e0 AS generation_time FROM documents)"


def requests(s, d):
    return load(s, d, "documents").select(
        F.col("doc_id").alias("assessment_id"),
        (1 + F.col("doc_id") % 12).alias("requested"),
        ((F.col("doc_id") % 90) / 2.0).alias("generation_time"),
    )


add(
    "session_record",
    lambda s, d: stats.assessment_score(scored(s, d))
    .join(stats.assessment_sizes(bank(s, d)), "assessment_id")
    .join(requests(s, d), "assessment_id")
    .select(
        F.col("assessment_id").cast("string").alias("task_id"),
        F.col("requested").alias("num_questions_requested"),
        F.col("n").alias("num_questions_generated"),
        "generation_time",
        F.round(F.col("n") / F.col("requested"), 6).alias("success_rate"),
        F.col("quality_score").alias("average_quality_score"),
    ),
    [S.BANK, S.SCORED, SCORE, REQUESTS],
    "SELECT CAST(r.assessment_id AS VARCHAR) AS task_id, requested AS num_questions_requested, n AS num_questions_generated, generation_time, "
    "round(n / requested, 6) AS success_rate, quality_score AS average_quality_score FROM ascore a JOIN requests r ON r.assessment_id = a.assessment_id "
    "JOIN (SELECT assessment_id, count(*) n FROM bank GROUP BY 1) c ON c.assessment_id = a.assessment_id",
)


def content_hash(text, difficulty, n):
    return F.left(F.sha2(F.concat_ws("_", text, difficulty, n.cast("string")), 256), F.lit(16))


def recorded_stats(s, d):
    """Statistics of every document's run, appended in two parts and read back."""
    out = scratch(s)
    rows = load(s, d, "documents").select(
        content_hash(F.col("text"), F.lit("medium"), 1 + F.col("doc_id") % 12).alias("content_hash"),
        (1 + F.col("doc_id") % 12).alias("num_questions"),
        F.lit("medium").alias("difficulty"),
        ((F.col("doc_id") % 90) / 2.0).alias("generation_time"),
        F.lit(1.0).alias("success_rate"),
    )
    for part in (0, 1):
        stores.append_stats(rows.filter(F.pmod(F.xxhash64("content_hash"), F.lit(2)) == part), out)
    return s.read.parquet(out).select(*rows.columns)


add(
    "generation_stat_append",
    recorded_stats,
    [REQUESTS],
    "SELECT left(sha256(text || '_medium_' || (1 + doc_id % 12)), 16) AS content_hash, 1 + doc_id % 12 AS num_questions, 'medium' AS difficulty, "
    "(doc_id % 90) / 2.0e0 AS generation_time, 1e0 AS success_rate FROM documents",
)
SINCE30 = f"\"timestamp\" > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY"
SINCE7 = f"\"timestamp\" > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY"
add(
    "performance_summary",
    lambda s, d: oplog.performance_summary(recent_sessions(s, d), AS_OF, 30),
    SES + [UPSERT],
    "SELECT count(*) AS total_sessions, round(avg(success_rate), 6) AS avg_success_rate, round(avg(generation_time), 6) AS avg_generation_time, "
    f"round(avg(average_quality_score), 6) AS avg_quality, CAST(sum(num_questions_generated) AS BIGINT) AS total_questions FROM latest WHERE {SINCE30}",
)
add(
    "quality_trend",
    lambda s, d: oplog.daily(recent_sessions(s, d), quality="average_quality_score"),
    SES + [UPSERT],
    f"SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, round(avg(average_quality_score), 6) AS quality FROM latest WHERE {SINCE30} GROUP BY 1 ORDER BY 1",
)
add(
    "difficulty_performance",
    lambda s, d: oplog.difficulty_performance(bridge.session_rows(s, d)),
    SES,
    "SELECT difficulty, round(avg(generation_time), 6) AS avg_time, count(*) AS sessions FROM session_rows GROUP BY 1",
)
add(
    "recent_trend",
    lambda s, d: oplog.daily(oplog.since(bridge.session_rows(s, d), AS_OF, 7), avg_time="generation_time", avg_success="success_rate"),
    SES,
    f"SELECT strftime(\"timestamp\", '%Y-%m-%d') AS day, round(avg(generation_time), 6) AS avg_time, round(avg(success_rate), 6) AS avg_success FROM session_rows WHERE {SINCE7} GROUP BY 1 ORDER BY 1",
)

# --- caches ------------------------------------------------------------------------

STATS = """
cs AS (SELECT cache_type, count(*) FILTER (operation = 'hit') AS hits, count(*) FILTER (operation = 'miss') AS misses, count(*) FILTER (operation = 'save') AS saves,
  count(*) FILTER (operation = 'expired') AS evictions FROM cache_events GROUP BY 1),
cstats AS (SELECT *, hits + misses AS total_requests, CASE WHEN hits + misses > 0 THEN CAST(round(CAST(hits * 100 / (hits + misses) AS DECIMAL(18, 9)), 2) AS DOUBLE) ELSE 0e0 END AS hit_rate_percent FROM cs),
csize AS (SELECT cache_type, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(round(CAST(sum(bytes) / (1024 * 1024) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS size_mb FROM cache_events GROUP BY 1)
"""
CA = [S.CACHE, STATS]
add("cache_stats", lambda s, d: oplog.cache_stats(bridge.cache_events(s, d)), CA, "SELECT * FROM cstats")
add("cache_sizes", lambda s, d: oplog.cache_sizes(bridge.cache_events(s, d)), CA, "SELECT * FROM csize")
add(
    "cache_recommendations",
    lambda s, d: flat(oplog.cache_advice(bridge.cache_events(s, d))),
    CA,
    f"SELECT cache_type, {S.join(S.issues(('hit_rate_percent < 20', S.lit(lx.CACHE_ADVICE['hits'])), ('size_mb > 100', S.lit(lx.CACHE_ADVICE['size']))))} AS recommendations FROM cstats JOIN csize USING (cache_type)",
)
ttl_case = "CASE cache_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in lx.TTL_MINUTES.items()) + " END"
add(
    "ttl_expire",
    lambda s, d: oplog.ttl_split(bridge.cache_events(s, d), AS_OF).groupBy("cache_type").agg(
        F.count_if(F.col("expired")).alias("evicted"), F.count_if(~F.col("expired")).alias("kept")
    ),
    [S.CACHE],
    f"SELECT cache_type, count(*) FILTER (old) AS evicted, count(*) FILTER (NOT old) AS kept FROM (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(stored_at) > {ttl_case}::BIGINT * 60000000 AS old FROM cache_events) GROUP BY 1",
)

# --- tasks ---------------------------------------------------------------------------

T = [S.TASKS, "last_event AS (SELECT * FROM task_events QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) = 1)"]


def tasks(s, d):
    return bridge.task_events(s, d)


add("task_health", lambda s, d: oplog.task_health(tasks(s, d)), T, "SELECT status, count(*) AS tasks FROM last_event GROUP BY 1")
add(
    "latest_status",
    lambda s, d: oplog.latest_status(tasks(s, d)).select("task_id", "event_id", "step", "status", "percentage"),
    T,
    "SELECT task_id, event_id, step, status, percentage FROM last_event",
)
add(
    "retry_eligible",
    lambda s, d: oplog.retry_rows(tasks(s, d)),
    T,
    "SELECT task_id, status, status = 'error' AS retry, CASE WHEN status = 'error' THEN 'text_extraction' END AS restart_step, CASE WHEN status = 'error' THEN 15::BIGINT END AS restart_percentage FROM last_event",
)
add(
    "step_durations",
    lambda s, d: oplog.step_durations(tasks(s, d)),
    T,
    "SELECT task_id, event_id, step, round((epoch_us(lead(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1000000, 6) AS seconds FROM task_events",
)
add(
    "progress_log",
    lambda s, d: oplog.progress_log(tasks(s, d)),
    T,
    "SELECT task_id, event_id, step, CAST(sum(CASE WHEN status = 'error' THEN 0 ELSE percentage % 5 END) OVER w AS BIGINT) AS questions_generated, "
    "CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS failed_attempts FROM task_events "
    "WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
msg = "CASE stage " + " ".join(f"WHEN {S.lit(k)} THEN ({S.arr(v)})[i]" for k, v in lx.STAGE_MESSAGES.items()) + f" ELSE ({S.arr(lx.STAGE_MESSAGE_DEFAULT)})[i] END"
add(
    "progress_message",
    lambda s, d: tasks(s, d).select("event_id", "stage", "percentage", oplog.progress_message(F.col("stage"), F.col("percentage")).alias("message")),
    T,
    f"SELECT event_id, stage, percentage, {msg} AS message FROM (SELECT *, CASE WHEN percentage < 30 THEN 1 WHEN percentage < 90 THEN 2 ELSE 3 END i FROM task_events)",
)
limit = "CASE endpoint " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in lx.RATE_LIMITS.items()) + " END"
add(
    "rate_window",
    lambda s, d: oplog.rate_window(bridge.api_calls(s, d)),
    [S.CALLS],
    f"""SELECT event_id, endpoint, calls_minute, calls_hour, calls_minute >= {limit} AS at_limit, CASE WHEN calls_minute >= {limit} THEN round(60 - (t - last_call) / 1000000, 6) ELSE 0e0 END AS wait_seconds
  FROM (SELECT *, count(*) OVER m AS calls_minute, max(t) OVER m AS last_call, count(*) OVER h AS calls_hour FROM (SELECT *, epoch_us(ts) t FROM api_calls)
  WINDOW m AS (PARTITION BY endpoint ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING), h AS (PARTITION BY endpoint ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING))""",
)
add(
    "completion_eta",
    lambda s, d: bridge.api_calls(s, d).select("event_id", "endpoint", "remaining_calls", oplog.completion_eta(F.col("endpoint"), F.col("remaining_calls")).alias("seconds")),
    [S.CALLS],
    f"SELECT event_id, endpoint, remaining_calls, round(remaining_calls / {limit} * 60, 6) AS seconds FROM api_calls",
)
add(
    "activity_sessions",
    lambda s, d: oplog.activity_sessions(tasks(s, d)),
    T,
    """SELECT task_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S.%f') AS ended,
  count(*) AS events, count(*) FILTER (status = 'error') AS errors FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY task_id ORDER BY ts, event_id) run FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY task_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END fresh FROM task_events)) GROUP BY task_id, run""",
)

# --- estimates -------------------------------------------------------------------------

SIZES = "sizes AS (SELECT doc_id, CAST(ceil(len(string_split(text, chr(10))) / 10.0) AS BIGINT) pages, strlen(text) bytes, 1 + doc_id % 12 questions FROM documents)"


def sizes(s, d):
    return load(s, d, "documents").select(
        "doc_id",
        F.ceil(F.size(F.split("text", "\n")) / F.lit(bridge.LINES_PER_PAGE)).alias("pages"),
        F.octet_length("text").cast("bigint").alias("bytes"),
        (1 + F.col("doc_id") % 12).alias("questions"),
    )


add(
    "processing_estimate",
    lambda s, d: sizes(s, d).select("doc_id", "pages", oplog.processing_estimate(F.col("pages"), F.col("bytes")).alias("seconds")),
    [SIZES],
    "SELECT doc_id, pages, greatest(10, least(300, CAST(trunc(greatest(pages * 2.0e0, bytes / (1024 * 1024) * 5) * 1.2e0) AS BIGINT))) AS seconds FROM sizes",
)


def stage_view(s, d):
    mb = F.col("bytes") / (1024 * 1024)
    cols = oplog.stage_estimate(F.col("pages"), mb, F.col("questions"))
    return sizes(s, d).select("doc_id", *[c.alias(n) for n, c in cols.items()])


add(
    "stage_estimate",
    stage_view,
    [SIZES],
    """SELECT doc_id, 2e0 AS upload, pages * 1.5e0 AS text_extraction, pages * 0.5e0 AS chunking, greatest(10e0, pages * 2.5e0) AS embedding_generation, 3e0 AS vector_storage,
  questions * 8e0 AS question_generation, round(f, 6) AS size_factor, CAST(trunc(t) AS BIGINT) AS total_seconds, CAST(round(CAST(t / 60 AS DECIMAL(18, 9)), 1) AS DOUBLE) AS total_minutes
  FROM (SELECT *, (2 + pages * 1.5e0 + pages * 0.5e0 + greatest(10e0, pages * 2.5e0) + 3 + questions * 8e0) * f t FROM (SELECT *, greatest(1e0, bytes / (1024 * 1024) / 5) f FROM sizes))""",
)

# --- batches and generation ---------------------------------------------------------------


def usage(s, d):
    b = bank(s, d).withColumn("ok", rules.six_check_pass())
    batches = b.groupBy("assessment_id", "perspective").agg(F.count_if("ok").alias("accepted"))
    return batches.groupBy("perspective").agg(
        F.sum("accepted").alias("questions"),
        F.count_if(F.col("accepted") > 0).alias("successful_batches"),
        F.count_if(F.col("accepted") == 0).alias("failed_batches"),
        F.count("*").alias("attempts"),
    )


add(
    "perspective_usage",
    usage,
    [S.BANK, S.GATE],
    "SELECT perspective, CAST(sum(n) AS BIGINT) AS questions, count(*) FILTER (n > 0) AS successful_batches, count(*) FILTER (n = 0) AS failed_batches, count(*) AS attempts "
    "FROM (SELECT assessment_id, perspective, count(*) FILTER (passed >= 5) n FROM gate GROUP BY 1, 2) GROUP BY 1",
)


def outcomes(s, d):
    rows = bridge.session_rows(s, d).select(
        "event_id", "task_id", F.when(F.col("success_rate") < 0.6, "low success rate").alias("error")
    )
    good, bad = oplog.split_outcome(rows, "error")
    return good.select("event_id", "task_id", F.lit("successful").alias("outcome"), F.lit("").alias("error")).unionByName(
        bad.select("event_id", "task_id", F.lit("failed").alias("outcome"), "error")
    )


add(
    "batch_outcome",
    outcomes,
    SES,
    "SELECT event_id, task_id, CASE WHEN success_rate < 0.6e0 THEN 'failed' ELSE 'successful' END AS outcome, CASE WHEN success_rate < 0.6e0 THEN 'low success rate' ELSE '' END AS error FROM session_rows",
)
add(
    "generation_statistics",
    lambda s, d: stats.generation_statistics(scoring.gated(bank(s, d)), requests(s, d)),
    [S.BANK, S.GATE, REQUESTS],
    "SELECT r.assessment_id, requested, coalesce(n, 0) AS generated, round(coalesce(n, 0) / requested, 6) AS success_rate, "
    "CASE WHEN n > 0 THEN round(generation_time / n, 6) ELSE 0e0 END AS time_per_question, coalesce(n, 0) = requested AS exact_count "
    "FROM requests r LEFT JOIN (SELECT assessment_id, count(*) n FROM gate WHERE passed >= 5 GROUP BY 1) g ON g.assessment_id = r.assessment_id",
)

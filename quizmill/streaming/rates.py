"""The rate limiter as a stream: for every remote call the earlier calls of the trailing minute, a flag and the wait."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quizmill import lexicon as lx
from quizmill.operators.oplog import SECOND, micros
from quizmill.streaming.progress import run_available

MINUTE = 60 * SECOND
#: A group of calls: long enough that few calls go to two, short enough that state and delay stay small.
SPAN = 10 * MINUTE
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "event_id long, endpoint string, calls_minute long, at_limit boolean, wait_seconds double"


class SpanOfCalls(StatefulProcessor):
    """One endpoint's calls of one span, with those of the minute before it, which its frames reach into.

    Calls wait until the watermark has passed the span: no earlier one can come any more, so in whatever order they came,
    each is told once what was before it. Then the state goes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getListState("calls", "t long, event_id long, own boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.calls.appendList(list(zip(part["t"].tolist(), part["event_id"].tolist(), part["own"].tolist())))
        self.handle.registerTimer((int(key[1]) + 1) * (SPAN // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        calls = sorted(self.calls.get())
        self.calls.clear()
        t = np.array([c[0] for c in calls], np.int64)
        own = np.array([c[2] for c in calls], bool)
        if own.any():
            before = np.searchsorted(t, t, side="left")  # earlier calls; those at the same instant are not
            count = before - np.searchsorted(t, t - MINUTE, side="right")
            wait = 60 - (t - t[np.maximum(before - 1, 0)]) / SECOND
            limit = lx.RATE_LIMITS.get(key[0], (None,))[0]
            full = count >= limit if limit is not None else np.zeros(len(t), bool)
            told = pd.DataFrame({"event_id": [c[1] for c in calls], "endpoint": key[0], "calls_minute": count, "at_limit": full, "wait_seconds": np.where(full, np.round(wait, 6), 0.0)})
            yield told[own]

    def close(self) -> None:
        pass


def call_rates(events: DataFrame) -> DataFrame:
    """(event_id, endpoint, calls_minute, at_limit, wait_seconds) for each call of a watermarked stream of events, once the watermark
    has passed its span: the earlier calls of its endpoint in the trailing minute, whether they fill the limit, and the
    seconds to wait. Endpoints without a limit are never at it.

    A group is one span of one endpoint; calls of a span's last minute go to the next one as well. So a busy endpoint is many
    groups, and state lasts for a span and the watermark's delay.
    """
    endpoint = F.when(F.col("event_type").isin("purchase", "error"), "completions").otherwise("embeddings")
    calls = events.select("event_id", "ts", endpoint.alias("endpoint"), micros("ts").alias("t"))
    spans = F.array_distinct(F.array(*[F.floor((F.col("t") + d) / SPAN).cast("long") for d in (0, MINUTE)]))
    sent = calls.select("*", F.explode(spans).alias("span"))
    placed = sent.select("endpoint", "span", "t", "event_id", (F.col("span") == F.floor(F.col("t") / SPAN)).alias("own"), "ts")
    return placed.groupBy("endpoint", "span").transformWithStateInPandas(SpanOfCalls(), _OUT, "append", "eventTime")


def run(stream: DataFrame, out: str) -> DataFrame:
    """run_available() with the state store that timers need; the session's own setting stays."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return run_available(stream, out)
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)

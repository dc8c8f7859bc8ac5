"""Stores changed in place, and the vector index."""

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizmill.operators import retrieval as rt
from quizmill.operators import vector_index as vi
from quizmill.sources import bridge, files, stores

SF = "/root/testdata/sf0.01"


def listing(path):
    """Every data file below a path with the time it was written."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


# -- vector store


def vectors(spark, names):
    return spark.createDataFrame([(n, [float(len(n)), 1.0]) for n in names], "text string, embedding array<float>").transform(stores.hashed)


def test_second_run_embeds_nothing(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), buckets=8)
    asked = vectors(spark, ["a", "b", "b", "cc"])
    assert store.missing(asked).count() == 3
    store.add(asked)
    assert store.missing(asked).count() == 0 and store.rows().count() == 3
    store.add(asked)
    assert store.rows().count() == 3
    more = vectors(spark, ["a", "ddd"])
    assert store.missing(more).count() == 1 and store.known(more).count() == 1
    store.add(more)
    again = stores.VectorStore(spark, str(tmp_path / "v"), buckets=8)  # a later session opens the same files
    assert sorted(r.embedding[0] for r in again.rows().collect()) == [1.0, 1.0, 2.0, 3.0]


def test_stored_side_is_never_shuffled(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), buckets=8)
    store.add(vectors(spark, [f"w{i}" for i in range(50)]))
    for df in (store.known(vectors(spark, ["w1"])), store.missing(vectors(spark, ["w1"]))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("== Initial Plan ==")[0]
        scan = final[: final.index("FileScan parquet")].splitlines()
        stored = [x for x in final.splitlines() if "FileScan" in x]
        assert len(stored) == 1 and "Bucketed: true" in stored[0]
        depth = scan[-1].index("+-") if "+-" in scan[-1] else len(scan[-1])
        above, least = [], depth
        for line in reversed(scan[:-1]):
            at = next(i for i, c in enumerate(line) if c not in " :+-")
            if at < least:
                above.append(line)
                least = at
        assert not any("Exchange" in x for x in above if "Join" not in x and above.index(x) < next(i for i, y in enumerate(above) if "Join" in y))


def test_null_vectors_and_empty_stores(spark, tmp_path):
    store = stores.VectorStore(spark, str(tmp_path / "v"), buckets=2)
    assert store.rows().count() == 0
    store.add(spark.createDataFrame([("h", None), (None, [1.0])], "text_hash string, embedding array<float>"))
    assert store.rows().count() == 0


# -- session log


def log(spark, items):
    return spark.createDataFrame([(k, i, datetime.fromisoformat(t) if t else None, v) for k, i, t, v in items], "task_id string, event_id long, timestamp timestamp, v long")


def content(spark, path):
    return sorted((r.task_id, r.event_id, r.v) for r in stores.read_merged(spark, path).collect())


A = [("a", 1, "2024-01-01T10:00", 1), ("b", 2, "2024-01-02T10:00", 2), ("c", 3, "2024-01-03T10:00", 3), ("d", 4, None, 4)]
B = [("a", 5, "2024-01-04T10:00", 5), ("a", 6, "2024-01-04T10:00", 6), ("c", 7, "2024-01-01T00:00", 7), ("e", 8, "2024-01-04T11:00", 8)]
AFTER = [("a", 6, 6), ("b", 2, 2), ("c", 3, 3), ("d", 4, 4), ("e", 8, 8)]


def test_merge_replaces_and_leaves_other_days_alone(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.merge_log(log(spark, A), path, "task_id", "timestamp", "event_id")
    before = listing(path)
    stores.merge_log(log(spark, B), path, "task_id", "timestamp", "event_id")
    assert content(spark, path) == AFTER
    after = listing(path)
    still = {f for f in before if "dt=2024-01-02" in f or "HIVE_DEFAULT" in f}
    assert still and all(after.get(f) == before[f] for f in still)
    assert not any("dt=2024-01-01" in f for f in after)  # emptied: its only task moved on
    stores.merge_log(log(spark, B), path, "task_id", "timestamp", "event_id")
    stores.merge_log(log(spark, A), path, "task_id", "timestamp", "event_id")
    assert content(spark, path) == AFTER


@pytest.mark.parametrize("broken", ["before", "within"])
def test_a_failed_merge_is_finished_or_repeated(spark, tmp_path, monkeypatch, broken):
    path = str(tmp_path / "log")
    stores.merge_log(log(spark, A), path, "task_id", "timestamp", "event_id")
    real, calls = stores._finish, []

    def failing(session, where):
        calls.append(where)
        if len(calls) == 2:
            if broken == "within":  # one day is gone from the log, the rest is not in place yet
                stores.remove(session, f"{where}/dt=2024-01-02")
            raise OSError("lost")
        real(session, where)

    monkeypatch.setattr(stores, "_finish", failing)
    with pytest.raises(OSError):
        touching = [*B, ("b", 9, "2024-01-01T09:00", 9)]
        stores.merge_log(log(spark, touching), path, "task_id", "timestamp", "event_id")
    monkeypatch.setattr(stores, "_finish", real)
    assert content(spark, path) == AFTER
    stores.merge_log(log(spark, B), path, "task_id", "timestamp", "event_id")
    assert content(spark, path) == AFTER


def test_merge_of_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    stores.merge_log(log(spark, A), path, "task_id", "timestamp", "event_id")
    before = listing(path)
    stores.merge_log(log(spark, []), path, "task_id", "timestamp", "event_id")
    assert listing(path) == before


# -- collections


def test_collection_is_removed_in_place(spark, tmp_path):
    store = str(tmp_path / "store")
    files.append_chunks(spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "collection bigint, chunk_id string, text string"), store)
    before = listing(store)
    assert stores.remove_collection(spark, store, 2) and not stores.remove_collection(spark, store, 2)
    assert listing(store) == {f: t for f, t in before.items() if "collection=2" not in f}
    assert [r.chunk_id for r in spark.read.parquet(store).collect()] == ["a"]


def test_stats_are_appended(spark, tmp_path):
    out = str(tmp_path / "stats")
    row = spark.createDataFrame([("h", 5)], "content_hash string, num_questions long")
    stores.append_stats(row, out)
    stores.append_stats(row, out)
    assert [tuple(r) for r in spark.read.parquet(out).select("content_hash", "num_questions").collect()] == [("h", 5)] * 2


# -- vector index


@pytest.fixture(scope="module")
def stored(spark):
    return bridge.chunk_vectors(spark, SF).withColumn("collection", F.lit(1).cast("bigint")).cache()


def queries_of(stored, every=7):
    return stored.filter(F.col("doc_id") % every == 0).select(F.col("chunk_id").alias("query_id"), "collection", F.col("embedding").alias("vector"))


@pytest.fixture(scope="module")
def themes(spark):
    """Vectors about sixty themes; the given ones have no neighbourhoods to find (their ten nearest lie at a cosine of 0.3)."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(60, 32))
    rows = [(1, f"c{i}", i, (middle[rng.integers(60)] + 0.45 * rng.normal(size=32)).tolist()) for i in range(3200)]
    return spark.createDataFrame(rows, "collection long, chunk_id string, doc_id long, embedding array<float>").cache()


def test_recall_and_rows_compared(spark, themes, tmp_path):
    path, k = str(tmp_path / "ix"), 10
    vi.build(themes, path)
    queries = queries_of(themes, 16)
    truth = {(r.query_id, r.chunk_id) for r in rt.top_chunks(queries, themes, k).collect()}
    hits = vi.search(spark, path, queries, k)
    found = {(r.query_id, r.chunk_id) for r in hits.collect()}
    seen = vi.compared(spark, path, queries).agg(F.sum("compared"), F.sum("stored")).first()
    assert len(found & truth) >= 0.9 * len(truth)
    assert seen[0] < 0.15 * seen[1]


def test_rows_compared_grow_slower_than_the_table(spark, themes, tmp_path):
    seen = []
    for part in (4, 1):
        path = str(tmp_path / f"ix{part}")
        vi.build(themes.filter(F.col("doc_id") % part == 0), path)
        seen.append(vi.compared(spark, path, queries_of(themes.filter("doc_id % 4 = 0"), 64)).agg(F.avg("compared"), F.avg("stored")).first())
    assert seen[1][1] == 4 * seen[0][1] and seen[1][0] < 3 * seen[0][0]


def test_exact_search_is_a_full_scan(spark, stored, tmp_path):
    path = str(tmp_path / "ix")
    vi.build(stored.filter("doc_id % 2 = 0"), path)
    vi.append(stored.filter("doc_id % 2 = 1"), spark.read.parquet(f"{path}/centres"), path)
    queries = queries_of(stored, 40)
    want = sorted((r.query_id, r.rank, r.chunk_id, r.distance) for r in rt.top_chunks(queries, stored, 6).collect())
    got = sorted((r.query_id, r.rank, r.chunk_id, r.distance) for r in vi.search(spark, path, queries, 6, first=1, exact=True).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-8)
    assert spark.read.parquet(f"{path}/rows").count() == stored.count()


def test_vectors_without_direction(spark, tmp_path):
    path = str(tmp_path / "ix")
    rows = [(1, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0]), (1, "z", [0.0, 0.0]), (1, "n", None), (1, "x", [float("nan"), 1.0]), (2, "c", [1.0, 1.0]), (1, "m", [None, 1.0])]
    vi.build(spark.createDataFrame(rows, "collection long, chunk_id string, embedding array<float>"), path)
    asked = spark.createDataFrame([("q", 1, [1.0, 0.1]), ("none", 3, [1.0, 0.0]), ("zero", 1, [0.0, 0.0]), ("null", 1, None)], "query_id string, collection long, vector array<double>")
    got = vi.search(spark, path, asked, 5, exact=True).collect()
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in got) == [("q", 1, "a"), ("q", 2, "b")]


def test_nothing_to_index(spark, tmp_path):
    with pytest.raises(ValueError):
        vi.build(spark.createDataFrame([], "collection long, chunk_id string, embedding array<float>"), str(tmp_path / "ix"))


def test_the_vector_store_shuffles_hashes_only(spark, monkeypatch):
    """Of every plan that a round writes, no exchange takes a text in."""
    import re

    import __spark_entry__ as entry
    from quizmill.sources import stores

    plans, write = [], stores.written
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    monkeypatch.setattr(stores, "written", lambda df, path: plans.append(df._jdf.queryExecution().explainString(mode)) or write(df, path))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        entry.queries()["embed_store"](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moved = [m for p in plans for m in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", p)]
    assert moved and not any(re.search(r"\btext#", m) for m in moved)

"""Streams drop late and repeated events; stores append and read back."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quizmill.operators import oplog
from quizmill.sources import exports, files, responses
from quizmill.sources.bridge import question_bank
from quizmill.streaming import progress, rates

SF = "/root/testdata/sf0.001"


def rows(spark, items):
    data = [(i, datetime.fromisoformat(t), 1, kind, 1.0, "{}") for i, t, kind in items]
    return spark.createDataFrame(data, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")


def test_late_and_repeated_events_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        return progress.run_available(progress.hourly_progress(progress.read_events(spark, src, "*.parquet")), out)

    rows(spark, [(1, "2024-01-01T00:10:00", "view"), (2, "2024-01-01T00:20:00", "view"), (2, "2024-01-01T00:20:00", "view")]).coalesce(1).write.mode("append").parquet(src)
    run()
    rows(spark, [(3, "2024-01-01T03:00:00", "view")]).coalesce(1).write.mode("append").parquet(src)
    run()
    rows(spark, [(4, "2024-01-01T00:30:00", "view"), (5, "2024-01-01T06:00:00", "view")]).coalesce(1).write.mode("append").parquet(src)
    got = {r.window_start: r.events for r in run().collect()}
    assert got == {"2024-01-01 00:00:00.000000": 2, "2024-01-01 03:00:00.000000": 1}


def test_chunk_store(spark, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "kept")
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "collection bigint, chunk_id string, text string")
    files.append_chunks(df, store)
    files.append_chunks(df.filter("collection = 2"), store)
    assert spark.read.parquet(store).count() == 3
    files.drop_collection(spark, store, target, 2)
    assert [r.chunk_id for r in spark.read.parquet(target).collect()] == ["a"]


def test_log_reads_only_the_days_asked_for(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.range(4).select("id", F.timestamp_seconds(F.col("id") * 86400).alias("ts"))
    files.append_log(df, path, "ts")
    log = files.read_log(spark, path, "1970-01-03")
    assert sorted(r.id for r in log.collect()) == [2, 3]
    assert "PartitionFilters: [isnotnull(dt" in log._jdf.queryExecution().toString()


def test_file_reader(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"hello")
    row = files.read_files(spark, str(tmp_path), "*.pdf").first()
    assert (row.filename, row.size_bytes, row.extension) == ("a.pdf", 5, ".pdf")
    assert row.unique_name == "5d41402a_a.pdf"


def test_text_and_csv_writers(spark, tmp_path):
    b = question_bank(spark, SF).filter("assessment_id < 3")
    exports.write_blocks(exports.export_text(b), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).filter(F.col("value").startswith("QUESTION ")).count() == b.count()
    exports.write_csv(exports.export_canvas(b), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == b.count() and len(back.columns) == 19


def test_call_rates_in_any_order_of_arrival(spark, tmp_path):
    """Calls that arrive out of order, within the watermark and over several batches, are told what a closed table tells."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    start = datetime(2024, 1, 1, 0, 8, 30)
    calls = [(i, start + timedelta(seconds=i * 1.5), "purchase" if i % 3 else "view") for i in range(150)] + [(500, start, "purchase"), (501, start + timedelta(seconds=60), "purchase")]
    shuffled = random.Random(4).sample(calls[:60] + calls[150:], 62), random.Random(5).sample(calls[60:150], 90), [(900, start + timedelta(hours=2), "view")], [(901, start, "view")]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for part in shuffled:
        rows(spark, [(i, t.isoformat(), kind) for i, t, kind in part]).coalesce(1).write.mode("append").parquet(src)
        got = rates.run(rates.call_rates(progress.read_events(spark, src, "*.parquet")), out)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    table = spark.createDataFrame([(i, t, "completions" if kind == "purchase" else "embeddings") for i, t, kind in calls], "event_id long, ts timestamp, endpoint string")
    want = {tuple(r) for r in oplog.rate_window(table).select("event_id", "endpoint", "calls_minute", "at_limit", "wait_seconds").collect()}
    assert {tuple(r) for r in got.collect()} == want and any(x[3] for x in want)
    assert got.count() == len(calls)


def test_items_of_any_shape(spark):
    texts = {
        "list of own keys": '[{"question_text": "q", "correct_position": "B", "options": [{"key": "A", "text": "w"}, {"label": "B", "text": "r"}, "x", "y"]}]',
        "lines": '[{"question_text": "q", "correct_position": "b", "options": "a) w\\n(B) r\\nC. x\\n\\nD: y"}]',
        "flag as text": '[{"question_text": "q", "options": {"A": {"text": "r", "is_correct": "true"}, "B": {"text": "w", "explanation": "told"}, "C": "x", "D": 4}}]',
        "faults": 'x [1, "two", null, [], {"question_text": 5, "options": 7}, {"question_text": "q"}, {"question_text": "q", "options": null}] y',
        "no array": '{"question_text": "q"}', "broken": '[{"question_text": ]', "nothing": None, "empty": "[]",
    }
    df = spark.createDataFrame([(k, v, "causal") for k, v in texts.items()], "name string, content string, perspective string")
    got = {}
    for r in responses.normalize_any(responses.parse_any(df)).orderBy("name", "position").collect():
        got.setdefault(r.name, []).append(r.reject or (r.correct_answer, [x.text for x in r.distractors]))
    assert got["list of own keys"] == [("r", ["w", "x", "y"])]
    assert got["lines"] == ["no correct answer"]
    assert got["flag as text"] == [("r", ["w", "x", "4"])]
    assert got["faults"] == ["not an object"] * 4 + ["unreadable options", "expected 4 options", "expected 4 options"]
    assert set(got) == {"list of own keys", "lines", "flag as text", "faults"}

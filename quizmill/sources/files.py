"""Files and tables: intake facts, validation, JSON assessments, append-only stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx

ASSESSMENT_JSON = (
    "assessment_id BIGINT, question_index BIGINT, question_text STRING, options MAP<STRING,STRING>, "
    "correct_position STRING, difficulty STRING"
)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploaded files with their facts; the content is read once per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    named = files.withColumn("filename", F.substring_index("path", "/", -1))
    return file_facts(named, F.col("content"))


def file_facts(files: DataFrame, content: Column) -> DataFrame:
    """Size, extension, content hash and a name made unique by the content."""
    size = F.octet_length(content).cast("bigint")
    return files.withColumns(
        {
            "size_bytes": size,
            "size_mb": F.round(F.round(size / (1024 * 1024), 9), 2),
            "extension": F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)),
            "sha256": F.sha2(content, 256),
            "unique_name": F.concat(F.left(F.md5(content), F.lit(8)), F.lit("_"), F.col("filename")),
        }
    )


def validate_files(facts: DataFrame) -> DataFrame:
    """facts: size_bytes, extension, pages, lead_chars (text length of the first three pages)."""
    m = lx.FILE_MESSAGES
    too_large = F.concat(
        F.lit("File too large: "), F.format_number(F.col("size_bytes") / (1024 * 1024), 1), F.lit("MB")
    )
    errors = tx.issues(
        (F.col("size_bytes") == 0, m["empty"]),
        (F.col("size_bytes") > lx.MAX_FILE_BYTES, too_large),
        (~F.col("extension").isin(".pdf", ".txt"), m["type"]),
        (F.col("pages") == 0, m["pages"]),
        ((F.col("pages") > 0) & (F.col("lead_chars") == 0), m["text"]),
    )
    warnings = tx.issues(
        ((F.col("lead_chars") > 0) & (F.col("lead_chars") < 100), m["little"]),
        (F.col("pages") > 50, F.concat(F.lit("Large file ("), F.col("pages"), F.lit(" pages) may take longer to process"))),
    )
    return facts.withColumns({"errors": errors, "warnings": warnings}).withColumn("valid", F.size("errors") == 0)


def read_assessments(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Assessment questions from JSON, with a fixed schema."""
    return spark.read.schema(ASSESSMENT_JSON).option("multiLine", multi_line).json(path)


def append_chunks(rows: DataFrame, path: str) -> None:
    """Append to the chunk store, one folder per collection, stamped with the time of storing."""
    rows.withColumn("stored_at", F.current_timestamp()).write.mode("append").partitionBy("collection").parquet(path)


def drop_collection(spark: SparkSession, path: str, target: str, collection: str) -> None:
    """Rewrite the store to a new folder without one collection."""
    kept = spark.read.parquet(path).filter(F.col("collection") != F.lit(collection))
    kept.write.mode("overwrite").partitionBy("collection").parquet(target)


def append_log(rows: DataFrame, path: str, ts: str) -> None:
    """Append log rows partitioned by day, so time filters skip whole folders."""
    rows.withColumn("dt", F.to_date(ts)).write.mode("append").partitionBy("dt").parquet(path)


def read_log(spark: SparkSession, path: str, first_day: str | Column) -> DataFrame:
    """Log rows from a day on; earlier folders are not read."""
    start = F.lit(first_day).cast("date") if isinstance(first_day, str) else first_day
    return spark.read.parquet(path).filter(F.col("dt") >= start)

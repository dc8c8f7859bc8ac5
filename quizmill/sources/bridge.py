"""Relations of the assessment domain, derived from the given tables.

All are narrow projections of whole tables: one document becomes pages and questions
inside its own row, so no shuffle is needed. The stems, clauses and headings below give
the synthetic prose the vocabulary the rules look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx
from quizmill.session import dealt, load

STEMS = [
    "What is", "How does", "Compare and contrast", "Which design would you use for",
    "Why could", "Explain", "Which is not", "Define", "Judge and justify", "List",
    "", "Which option A fits [this]", "Describe the consensus of",
]
CLAUSES = [
    "A wallet stores the private key", "Miners validate transactions",
    "A private key signs and the public key verifies", "A hash is one-way",
    "A blockchain is distributed and immutable", "Decentralized systems are slower over time",
    "A consensus mechanism is used", "Immutable records cannot be changed",
    "It uses proof of work", "Gas measures execution cost",
    "A smart contract needs an oracle", "A Merkle tree enables verification",
    "", "", "", "",
]
HEADINGS = [
    "", "Introduction", "2.1 Definition of the theorem", "Example: see also the note",
    "for (i = 0; i < n) { step(i); }", "$E = mc^2$ where α ≤ β and ∑ x",
    "Figure 3: overview of the method", "| a | b |\n| 1 | 2 |",
    "def run(x):\n    return `x` + 1\nimport os", "", "KEY IDEAS",
    "Fig. 2 - process\n\\frac{a}{b} and \\sum_{i}^{n}",
]
LINES_PER_PAGE = 10
SENTENCES_PER_QUESTION = 5


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def page_texts(lines: Column, doc_id: Column) -> Column:
    """Array of page texts: ten lines each, under a heading chosen by position."""
    count = F.ceil(F.size(lines) / F.lit(LINES_PER_PAGE)).cast("int")

    def page(i: Column) -> Column:
        body = F.array_join(F.slice(lines, i * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)), "\n")
        head = pick(HEADINGS, (doc_id + i) % len(HEADINGS))
        return F.when(head == "", body).otherwise(F.concat(head, F.lit("\n"), body))

    return F.transform(F.sequence(F.lit(0), count - 1), page)


def documents(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """The documents table, with work for every core. Placed, its rows lie by doc_id: texts move once, and whatever is made
    of them is grouped by doc_id where it is."""
    docs = load(spark, sf_dir, "documents")
    if not placed:
        return dealt(docs, "doc_id")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return docs.repartition(parts, "doc_id")


def doc_pages(spark: SparkSession, sf_dir: str, keep_blank: bool = False) -> DataFrame:
    """doc_id, page_num, text: every page of every document; blank pages are dropped unless kept."""
    # the line array is a column of its own: inside the lambda it would be split again per page
    docs = documents(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("lines"))
    pages = page_texts(F.col("lines"), F.col("doc_id"))
    rows = docs.select("doc_id", F.posexplode(pages).alias("pos", "text")).select(
        "doc_id", (F.col("pos") + 1).cast("bigint").alias("page_num"), "text"
    )
    return rows if keep_blank else rows.filter(F.trim("text") != "")


def question_bank(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """One assessment per document; every five sentences are a question, its answer and distractors. Placed, the questions of an
    assessment lie together."""
    docs = documents(spark, sf_dir, placed).select(
        "doc_id", "source", tx.sentences(F.trim("text")).alias("s")
    )
    s = F.col("s")
    n = F.ceil(F.size(s) / F.lit(SENTENCES_PER_QUESTION)).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda b: F.slice(s, b * SENTENCES_PER_QUESTION + 1, F.lit(SENTENCES_PER_QUESTION)),
    )
    rows = docs.select(
        F.col("doc_id").alias("a"), "source", F.posexplode(blocks).alias("pos", "b")
    ).withColumn("q", F.col("pos").cast("bigint"))
    a, q, b = F.col("a"), F.col("q"), F.col("b")

    stem = pick(STEMS, (a + q) % len(STEMS))
    first = F.get(b, 0)
    asked = F.when(
        ((a + q) % 5 != 0) & F.endswith(first, F.lit(".")),
        F.concat(F.expr("left(b[0], length(b[0]) - 1)"), F.lit("?")),
    ).otherwise(first)
    clause = pick(CLAUSES, (a * 5 + q * 7) % len(CLAUSES))
    second = F.coalesce(F.get(b, 1), F.lit(""))
    answer = F.when(clause == "", second).otherwise(F.concat(clause, F.lit(": "), second))

    def distractor(i: int) -> Column:
        kind = F.concat(F.lit("m"), ((a + q * (i + 1)) % 5).cast("string"))
        return F.struct(
            F.get(b, F.lit(i + 2)).alias("text"),
            kind.alias("misconception_type"),
            F.concat(F.lit("Mixes it up with "), kind).alias("explanation"),
            (1 + (a * 7 + q * 5 + (i + 1) * 3) % 10).cast("bigint").alias("closeness_score"),
        )

    # one by one, as a lambda is not compiled
    wrong = F.slice(F.array(*[distractor(i) for i in range(3)]), 1, F.greatest(F.size(b) - 2, F.lit(0)))

    return rows.select(
        a.alias("assessment_id"),
        q.alias("question_index"),
        F.when(stem == "", asked).otherwise(F.concat(stem, F.lit(" "), asked)).alias("question_text"),
        F.when((a + q) % 7 == 0, "true_false").otherwise("multiple_choice").alias("question_type"),
        F.when((a * 3 + q) % 10 < 3, "easy").when((a * 3 + q) % 10 < 8, "medium").otherwise("hard").alias("difficulty"),
        answer.alias("correct_answer"),
        wrong.alias("distractors"),
        F.concat(F.lit("Stated in "), F.col("source")).alias("explanation"),
        F.lower(F.substring_index(second, " ", 1)).alias("concept"),
        pick(lx.PERSPECTIVES, (a + q) % len(lx.PERSPECTIVES)).alias("perspective"),
        pick(["A", "B", "C", "D"], (a * q) % 4).alias("correct_position"),
        F.col("source").alias("source_file"),
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored chunks: documents with a vector, grouped into collections by label. A vector without a document has no text
    to return and takes no part, as in the SQL."""
    vectors = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return vectors.join(docs, "doc_id").select(
        F.col("label").cast("bigint").alias("collection"),
        F.concat(F.lit("c"), F.col("doc_id")).alias("chunk_id"),
        F.col("doc_id"),
        "text",
        "embedding",
        F.when(F.col("doc_id") % 11 != 0, (F.col("doc_id") % 100) / 100.0).alias("importance_score"),
        (F.col("doc_id") % 7).alias("page_num"),
        (F.col("doc_id") % 13).alias("chunk_index"),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Part "), F.col("doc_id") % 5)).alias("section"),
        F.concat(F.lit("c"), F.col("doc_id") - 10).alias("prev_chunk"),
        F.concat(F.lit("c"), F.col("doc_id") + 10).alias("next_chunk"),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, vector: the mean vector per label, summed map-side per (label, dimension)."""
    cells = load(spark, sf_dir, "embeddings").select(
        F.col("label").cast("bigint").alias("label"), F.posexplode("embedding").alias("dim", "x")
    )
    means = cells.groupBy("label", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vector")
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )


def session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation-session log rows; several rows may report the same task."""
    e = _events(spark, sf_dir)
    i = F.col("event_id")
    return e.select(
        F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd")).alias("task_id"),
        F.col("event_id"),
        F.col("ts").alias("timestamp"),
        pick(["easy", "medium", "hard"], i % 3).alias("difficulty"),
        (5 + i % 20).alias("num_questions_requested"),
        (5 + (i % 20) - (F.col("k") % 5)).alias("num_questions_generated"),
        F.col("value").alias("generation_time"),
        (1 - (F.col("k") % 10) / 20.0).alias("success_rate"),
        (F.col("k") / 100.0).alias("average_quality_score"),
    )


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress events: one task per user."""
    stages = list(lx.STAGE_WEIGHTS)
    t = F.col("event_type")
    return _events(spark, sf_dir).select(
        F.col("user_id").alias("task_id"),
        "event_id",
        "ts",
        t.alias("step"),
        pick(stages, F.col("event_id") % len(stages)).alias("stage"),
        F.when(t == "error", "error").when(t == "purchase", "ready").when(t == "signup", "uploading").otherwise("processing").alias("status"),
        F.col("k").alias("percentage"),
        F.col("value"),
    )


def api_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote calls per endpoint."""
    t = F.col("event_type")
    return _events(spark, sf_dir).select(
        "event_id",
        F.when(t.isin("purchase", "error"), "completions").otherwise("embeddings").alias("endpoint"),
        "ts",
        F.col("k").alias("remaining_calls"),
    )


def cache_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache operations per tier with the size of the entry."""
    tiers = list(lx.TTL_MINUTES)
    t = F.col("event_type")
    return _events(spark, sf_dir).select(
        "event_id",
        pick(tiers, F.col("user_id") % len(tiers)).alias("cache_type"),
        F.when(t == "view", "hit").when(t == "click", "miss").when(t == "purchase", "save").when(t == "error", "expired").otherwise("hit").alias("operation"),
        F.col("ts").alias("stored_at"),
        (F.col("value") * 1000).cast("bigint").alias("bytes"),
    )

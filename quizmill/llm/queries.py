"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm import alignment, bpe, decontaminate, html, jaccard, languages, lines, mixing, neighbours, prediction, quality, secrets, spelling
from quizmill.llm.common import fold, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs.filter(fold(5) != 0), table(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text", "n_chars", (fold(5) == 0).alias("held_out")), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op3_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.score(table(spark, sf_dir, "documents"), fold(7) == 2)


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    told = languages.identify(docs.select("doc_id", "text", (fold(5) == 0).alias("held_out")), languages.trained(docs))
    return told.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "overlap")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "keeps")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids"))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = alignment.align(table(spark, sf_dir, "documents"), as_text=True)
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_prediction, op4_neighbours, op5_secrets, op6_language, op7_mixing, op8_html, op9_decontamination, op10_ngram_jaccard, op11_spelling, op12_bpe, op13_alignment)}
ORACLES = {"op1_line_dedup": lines.ORACLE, "op7_mixing": mixing.oracle()}

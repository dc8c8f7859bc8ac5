"""Score every question of a bank: a narrow projection, no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.functions import text as tx
from quizmill.functions.frames import hold


def score_questions(bank: DataFrame) -> DataFrame:
    """All per-question scores, issue lists, the weighted overall score, its grade and advice."""
    low, n, lengths, hits, words = (F.col(c) for c in ("_low", "_n", "_lengths", "_hits", "_words"))
    read = bank.withColumns({"_low": F.lower("question_text"), "_lengths": rules.option_words(3)}).withColumns(
        {"_hits": rules.bloom_hits(low), "_words": tx.word_list(low), "_n": tx.word_count(F.col("question_text"))}
    )
    first = read.withColumns(
        {
            **rules.readability(n),
            **rules.distractor_quality(),
            "distractor_issues": rules.distractor_issues(),
            "bloom_level": rules.bloom_level(low, hits),
            "clarity_issues": rules.clarity_issues(low=low, n=n, lengths=lengths),
            "language_issues": rules.language_issues(words),
            "predicted_score": rules.predicted_difficulty(n),
        }
    ).drop("_low", "_n", "_lengths", "_hits", "_words")
    second = first.withColumns(
        {
            "readability_level": rules.readability_level(F.col("flesch_score")),
            "cognitive_score": rules.bloom_score(F.col("bloom_level")),
            "clarity_score": rules.clarity_score(F.col("clarity_issues")),
            "language_score": rules.language_score(F.col("language_issues")),
            "predicted_level": rules.difficulty_band(F.col("predicted_score")),
        }
    )
    third = second.withColumn("overall_score", rules.overall_score())
    return third.withColumns(
        {"quality_grade": rules.grade(F.col("overall_score")), "recommendations": rules.question_advice()}
    )


def checked(bank: DataFrame) -> DataFrame:
    """Adds passes: the six checks, made once a question; a filter on it is not pushed below the making of the question."""
    known = {
        "low": F.lower("question_text"), "n": tx.word_count(F.col("question_text")),
        "texts": F.transform(rules.option_texts(), F.lower), "n_words": rules.option_words(),
    }
    made = bank.withColumns({f"_{k}": c for k, c in known.items()})
    passed = made.withColumn("_passes", rules.six_check_pass(**{k: F.col(f"_{k}") for k in known}))
    return hold(passed.drop(*[f"_{k}" for k in known]), passes=F.col("_passes")).drop("_passes")


def gated(bank: DataFrame) -> DataFrame:
    """The questions that pass the six checks."""
    return checked(bank).filter("passes").drop("passes")


def basic_scores(bank: DataFrame) -> DataFrame:
    """Constant scores used when the full analysis is switched off; closeness is still measured."""
    d = rules.distractor_quality()
    return bank.select(
        "assessment_id",
        "question_index",
        F.lit(0.7).alias("readability_score"),
        d["strong_count"].alias("strong_count"),
        d["average_closeness"].alias("average_closeness"),
        F.lit(0.7).alias("distractor_score"),
        F.lit("understand").alias("bloom_level"),
        F.lit(0.7).alias("cognitive_score"),
        F.lit(0.8).alias("clarity_score"),
        F.lit(0.7).alias("overall_score"),
        F.lit("B").alias("quality_grade"),
        F.lit(lx.BASIC_ADVICE).alias("recommendations"),
    )

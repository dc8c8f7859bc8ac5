"""Shapes shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.operators.scoring import score_questions
from quizmill.sources import bridge


def bank(spark, sf_dir, placed: bool = False) -> DataFrame:
    return bridge.question_bank(spark, sf_dir, placed)


def scored(spark, sf_dir, placed: bool = False) -> DataFrame:
    return score_questions(bridge.question_bank(spark, sf_dir, placed))


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Result edge: whole numbers as BIGINT, string arrays joined with ' | '."""
    df = df.select(*columns) if columns else df
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, " | ")
        out.append(c.alias(f.name))
    return df.select(*out)

"""Distractors from misconception patterns: twelve expressions per answer, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rewrites as rw
from quizmill.functions.frames import hold

ID = ["assessment_id", "question_index"]


def applicable_patterns(answers: DataFrame) -> DataFrame:
    a, d = F.col("correct_answer"), F.col("difficulty")
    names = F.array_compact(F.array(*[F.when(rw.applicable(a, d, n), F.lit(n)) for n, *_ in lx.PATTERNS]))
    return answers.select(*ID, F.explode(names).alias("pattern"))


def rewritten(answers: DataFrame) -> DataFrame:
    """Every pattern's rewrite of every answer; patterns that do not apply give no row."""
    a = F.col("correct_answer")
    rows = F.array_compact(
        F.array(
            *[
                F.when(fn(a).isNotNull(), F.struct(F.lit(n).alias("pattern"), fn(a).alias("distractor")))
                for n, fn in rw.REWRITES.items()
            ]
        )
    )
    return answers.select(*ID, "correct_answer", F.inline(rows))


def select_distractors(answers: DataFrame, needed: int = 3, seed: str = "0") -> DataFrame:
    """Up to needed valid distractors per answer from its applicable patterns, in a seeded random order.

    Candidates are at most one per pattern, so they are ordered inside the row.
    """
    a, d = F.col("correct_answer"), F.col("difficulty")

    def entry(name: str, span: tuple[int, int]) -> Column:
        low, high = span
        text = rw.REWRITES[name](a)
        draw = F.md5(F.concat_ws("|", *ID, F.lit(name), F.lit(seed)))
        return F.when(
            rw.applicable(a, d, name) & rw.valid_distractor(text, a),
            F.struct(
                draw.alias("draw"),
                F.lit(name).alias("pattern"),
                text.alias("distractor"),
                (low + F.ascii(draw) % (high - low + 1)).cast("bigint").alias("closeness"),
            ),
        )

    found = F.array_sort(F.array_compact(F.array(*[entry(n, span) for n, _, span, _ in lx.PATTERNS])))
    rows = hold(answers.select(*ID, "correct_answer", "difficulty"), found=found)
    return rows.select(*ID, "difficulty", F.posexplode(F.slice("found", 1, needed)).alias("pos", "x")).select(
        *ID, (F.col("pos") + 1).cast("bigint").alias("choice"), "difficulty", "x.pattern", "x.distractor", "x.closeness"
    )


def used_registry(applied: DataFrame) -> DataFrame:
    """Patterns by difficulty and by concept with the number of answers they apply to."""
    facts = {n: [("difficulty", x) for x in levels] + [("concept", c) for c in concepts] for n, levels, _, concepts in lx.PATTERNS}
    table = F.create_map(
        *[
            v
            for n, pairs in facts.items()
            for v in (
                F.lit(n),
                F.array(*[F.struct(F.lit(g).alias("grouping"), F.lit(k).alias("entry")) for g, k in pairs]),
            )
        ]
    )
    counts = applied.groupBy("pattern").agg(F.count("*").alias("answers"))
    return counts.select("pattern", "answers", F.inline(F.element_at(table, F.col("pattern"))))

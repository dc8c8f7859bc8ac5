"""Per-question scores and checks, as column expressions over the question bank.

Each function reads the bank columns by name (question_text, correct_answer,
distractors, ...) and returns one column or a dict of named columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx


def question() -> Column:
    return F.col("question_text")


def answer() -> Column:
    return F.col("correct_answer")


def distractors() -> Column:
    return F.col("distractors")


def closeness() -> Column:
    return F.transform(distractors(), lambda d: d["closeness_score"])


def option_texts(limit: int | None = None) -> Column:
    """Answer first, then the distractor texts."""
    wrong = F.transform(distractors(), lambda d: d["text"])
    return F.concat(F.array(answer()), wrong if limit is None else F.slice(wrong, 1, limit))


def option_words(limit: int | None = None) -> Column:
    return F.transform(option_texts(limit), tx.word_count)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


# --- scores --------------------------------------------------------------------


def readability(n: Column | None = None) -> dict[str, Column]:
    """The question's words may be given where they are known, here and below."""
    n = tx.word_count(question()) if n is None else n
    words = F.greatest(F.lit(1), n)
    sents = F.greatest(F.lit(1), tx.heads(question(), "[^.!?]*+([.!?]?)[.!?]*+"))
    syl = tx.syllables(question(), n)
    ease = F.lit(206.835) - F.lit(1.015) * (words / sents) - F.lit(84.6) * (syl / words)
    grade = F.lit(0.39) * (words / sents) + F.lit(11.8) * (syl / words) - F.lit(15.59)
    return {
        "flesch_score": F.round(ease, 6),
        "grade_level": F.round(grade, 6),
        "readability_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ease - 30) / 70)), 6),
        "appropriate": F.round(grade, 6).between(8, 12),
    }


def readability_level(ease: Column) -> Column:
    return tx.bands(ease, lx.READABILITY_BANDS, lx.READABILITY_LAST)


def distractor_quality() -> dict[str, Column]:
    n = F.size(distractors())
    c = closeness()
    strong = F.size(F.filter(c, lambda x: x >= 6))
    weak = F.size(F.filter(c, lambda x: x < 4))
    kinds = F.size(F.array_distinct(F.transform(distractors(), lambda d: d["misconception_type"])))
    avg = total(c) / n
    diversity = kinds / n
    score = F.least(F.lit(1.0), avg / 10 * 0.6 + strong / n * 0.3 + diversity * 0.1)
    some = n > 0
    return {
        "strong_count": F.when(some, strong).otherwise(0).cast("bigint"),
        "weak_count": F.when(some, weak).otherwise(0).cast("bigint"),
        "average_closeness": F.when(some, F.round(avg, 6)).otherwise(0.0),
        "distractor_diversity": F.when(some, F.round(diversity, 6)).otherwise(0.0),
        "distractor_score": F.when(some, F.round(score, 6)).otherwise(0.0),
    }


def distractor_issues() -> Column:
    m = lx.DISTRACTOR_ISSUES
    c = closeness()
    n = F.size(distractors()).cast("bigint")
    squares = total(F.transform(c, lambda x: x * x))
    kinds = F.size(F.array_distinct(F.transform(distractors(), lambda d: d["misconception_type"])))
    return F.when(n == 0, F.array(F.lit(m["none"]))).otherwise(
        tx.issues(
            (n < 3, m["few"]),
            (F.size(F.filter(c, lambda x: x >= 6)) < 2, m["weak"]),
            # sample variance below one, kept in whole numbers
            ((n > 1) & (n * squares - total(c) * total(c) < n * (n - 1)), m["flat"]),
            (kinds == 1, m["same"]),
        )
    )


def bloom_hits(low: Column) -> Column:
    """How many words of each level the question holds."""
    return F.array(*[tx.count_present(low, words) for words in lx.BLOOM_WORDS.values()])


def bloom_level(low: Column | None = None, hits: Column | None = None) -> Column:
    low = F.lower(question()) if low is None else low
    hits = bloom_hits(low) if hits is None else hits
    best = F.array_max(hits)
    out = F.when(best > 0, F.get(F.array(*map(F.lit, lx.BLOOM_WORDS)), (F.array_position(hits, best) - 1).cast("int")))
    out = out.when(best.isNull(), None)
    for level, words in lx.BLOOM_FALLBACK:
        out = out.when(tx.any_word(low, words), level)
    return out.otherwise("understand")


def bloom_score(level: Column) -> Column:
    ranks = F.array(*[F.lit(x) for x in lx.BLOOM_WORDS])
    return F.round(F.array_position(ranks, level) / F.lit(len(lx.BLOOM_WORDS)), 6)


def clarity_issues(with_options: bool = True, low: Column | None = None, n: Column | None = None, lengths: Column | None = None) -> Column:
    m = lx.CLARITY_ISSUES
    low = F.lower(question()) if low is None else low
    n = tx.word_count(question()) if n is None else n
    vague = F.concat_ws(", ", *[F.when(F.contains(low, F.lit(w)), w) for w in lx.AMBIGUOUS_WORDS])
    lengths = option_words(3) if lengths is None else lengths
    checks = [
        (F.contains(low, F.lit("not")), m["negative"]),
        (F.length(question()) - F.length(F.replace(question(), F.lit("?"))) != 1, m["marks"]),
        (n < 5, m["short"]),
        (n > 30, m["long"]),
        (vague != "", F.concat(F.lit(m["ambiguous"]), vague)),
    ]
    if with_options:
        checks.append((F.array_max(lengths) > 2 * F.array_min(lengths), m["unbalanced"]))
    return tx.issues(*checks)


def clarity_score(found: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - F.size(found) * 0.2), 6)


def predicted_difficulty(words: Column | None = None) -> Column:
    size = F.least(F.lit(1.0), (tx.word_count(question()) if words is None else words) / 20)
    n = F.size(distractors())
    with_distractors = (size + total(closeness()) / n / 10 + 0.5) / 3
    return F.round(F.when(n > 0, with_distractors).otherwise((size + 0.5) / 2), 6)


def difficulty_band(score: Column) -> Column:
    return F.when(score < 0.4, "EASY").when(score < 0.7, "MEDIUM").otherwise("HARD")


def language_issues(words: Column | None = None) -> Column:
    m = lx.LANGUAGE_ISSUES
    words = tx.word_list(F.lower(question())) if words is None else words
    return tx.issues(
        (~F.rlike(question(), F.lit(r"^\p{Lu}")), m["capital"]),
        (~F.rlike(question(), F.lit(r"\?\s*$")), m["end"]),
        (F.contains(question(), F.lit("  ")), m["spaces"]),
        (F.rlike(question(), F.lit(r"[\[\]{}]")), m["brackets"]),
        (F.size(words) != F.size(F.array_distinct(words)), m["repeat"]),
    )


def language_score(found: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 1.0 - F.size(found) * 0.25), 6)


def concepts() -> Column:
    return tx.present(F.lower(question()), lx.DOMAIN_CONCEPTS)


def overall_score() -> Column:
    w = lx.SCORE_WEIGHTS
    return F.round(
        F.col("readability_score") * w["readability"]
        + F.col("distractor_score") * w["distractor"]
        + F.col("cognitive_score") * w["cognitive"]
        + F.col("clarity_score") * w["clarity"]
        + F.col("language_score") * w["language"],
        8,
    )


def grade(score: Column) -> Column:
    return tx.bands(score, lx.GRADE_BANDS, lx.GRADE_LAST)


def question_advice() -> Column:
    m = lx.QUESTION_ADVICE
    return tx.issues(
        (F.col("readability_score") < 0.6, m["readability"]),
        (F.col("strong_count") < 2, m["strong"]),
        (F.col("distractor_diversity") < 0.5, m["diverse"]),
        (F.col("clarity_score") < 0.7, F.concat(F.lit(m["clarity"]), F.array_join("clarity_issues", ", "))),
        (F.col("bloom_level") == "remember", m["level"]),
        (F.size("language_issues") > 0, m["grammar"]),
    )


# --- gates ---------------------------------------------------------------------


def six_checks(low: Column | None = None, n: Column | None = None, texts: Column | None = None, n_words: Column | None = None) -> dict[str, Column]:
    """The question's lower case and words, the options' lower case and words may be given where they are known."""
    low, n = F.lower(question()) if low is None else low, tx.word_count(question()) if n is None else n
    texts, n_words = F.transform(option_texts(), F.lower) if texts is None else texts, option_words() if n_words is None else n_words
    return {
        "no_placeholder": ~F.exists(texts, lambda t: tx.any_word(t, lx.GATE_PLACEHOLDERS)),
        "option_length": F.forall(n_words, lambda k: (k >= 3) & (k <= 35)),
        "distractors_ok": (F.size(distractors()) >= 2)
        & F.forall(distractors(), lambda d: F.length(F.trim(d["text"])) >= 5),
        "clear_question": F.rlike(question(), F.lit(r"\?\s*$")) & n.between(3, 25),
        "no_negative": ~tx.any_word(low, lx.GATE_NEGATIVES),
        "balanced": F.array_max(n_words) <= 2 * F.array_min(n_words),
    }


def six_check_pass(**known: Column) -> Column:
    passed = reduce(lambda a, b: a + b, [c.cast("int") for c in six_checks(**known).values()])
    return passed >= 5


def strict_pass() -> Column:
    """All strict rules except the duplicate test, which needs the rest of the bank."""
    return (
        tx.word_count(question()).between(5, 40)
        & F.endswith(question(), F.lit("?"))
        & (tx.word_count(answer()) >= 2)
        & (F.size(distractors()) == 3)
        & ~F.exists(option_texts(), lambda t: tx.any_word(F.lower(t), lx.STRICT_PLACEHOLDERS))
    )


def perspective_bloom(p: Column) -> Column:
    return tx.lookup(p, lx.PERSPECTIVE_BLOOM, "understand")


def perspective_types(p: Column) -> Column:
    table = F.create_map(
        *[x for k, v in lx.PERSPECTIVE_TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]
    )
    return F.coalesce(
        F.try_element_at(table, p), F.array(*[F.lit(t) for t in lx.PERSPECTIVE_TYPES_DEFAULT])
    )


def retry_hints(reasons: Column) -> Column:
    hints = F.flatten(
        F.array(
            *[
                F.when(F.contains(reasons, F.lit(word)), F.array(*[F.lit(t) for t in texts])).otherwise(
                    F.array().cast("array<string>")
                )
                for word, texts in lx.RETRY_HINTS
            ]
        )
    )
    return F.when(F.size(hints) > 0, F.array_join(hints, "\n")).otherwise(lx.RETRY_DEFAULT)


# --- option views ----------------------------------------------------------------


def options_pivot() -> Column:
    """Map letter -> option: the answer at A, up to three distractors after it.

    The explanation fields of the other kind of option are null.
    """
    d = lx.OPTION_DEFAULTS

    def given(c: Column, key: str) -> Column:
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(d[key]))

    def entry(text: Column, correct: bool, explanation: Column, **fields: Column) -> Column:
        names = [
            "key_points", "real_world_example", "connects_to", "misconception_name",
            "why_students_think_this", "correct_understanding", "remember_this",
        ]
        return F.struct(
            text.alias("text"),
            F.lit(correct).alias("is_correct"),
            explanation.alias("explanation"),
            *[fields.get(n, F.lit(None).cast("string")).alias(n) for n in names],
        )

    def wrong(x: Column) -> Column:
        before, after = d["why_chosen"].split("{type}")
        kind = given(x["misconception_type"], "why_chosen_type")
        return entry(
            x["text"],
            False,
            given(x["explanation"], "why_wrong"),
            misconception_name=given(x["misconception_type"], "misconception"),
            why_students_think_this=F.concat(F.lit(before), kind, F.lit(after)),
            correct_understanding=F.lit(d["understanding"]),
            remember_this=F.lit(d["remember"]),
        )

    right = entry(
        answer(),
        True,
        given(F.col("explanation"), "why_correct"),
        key_points=F.lit(d["key_points"]),
        real_world_example=F.lit(d["example"]),
        connects_to=F.lit(d["connects"]),
    )
    entries = F.concat(F.array(right), F.transform(F.slice(distractors(), 1, 3), wrong))
    letters = F.slice(F.array(*[F.lit(x) for x in "ABCD"]), 1, F.size(entries))
    return F.map_from_arrays(letters, entries)


def ui_quality() -> Column:
    n = F.size(distractors())
    shown = F.least(n, F.lit(3))
    score = (
        F.lit(0.3)
        + F.when(F.length(F.trim(question())) > 20, 0.15).otherwise(0.0)
        + F.when(F.length(F.trim(F.col("explanation"))) > 10, 0.15).otherwise(0.0)
        + F.when(shown == 3, 0.1).otherwise(0.0)
        + 0.2
        + F.when(shown >= 2, 0.1).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), score), 6)

"""Putting question sets together: exact counts, quotas, replacements, cached sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx
from quizmill.sources.stores import written
from quizmill.streaming.progress import scratch

KEY, IDX = "assessment_id", "question_index"


def exact_count(accepted: DataFrame, requests: DataFrame) -> DataFrame:
    """Accepted questions in order, cut at the requested number, however large; request_constraints() reports one that is
    above the limit for requests."""
    order = W.partitionBy(KEY).orderBy(IDX)
    asked = accepted.join(requests.select(KEY, "requested"), KEY)
    return asked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= F.col("requested")).drop("n", "requested")


def _word_set(text: str) -> set[str]:
    return set("".join(ch if ch.isalnum() or ch == "_" else " " for ch in text.lower()).split())


def _alike(a: str, b: str) -> bool:
    x, y = _word_set(a), _word_set(b)
    return len(x & y) / len(x | y) > 0.8


def fallback_forms(question: str, subject: str) -> tuple[str, str, str]:
    """A template's text, its form from the second round on, and the form that replaces a text too like an earlier one."""
    low = question.lower()
    return question, f"In {subject} systems, {low}", f"Regarding {subject}, {low}"


def _like(words: Column, text: str) -> Column:
    """Of distinct words; only sets of about the same size are compared."""
    wanted = sorted(_word_set(text))
    n, k = F.size(words), len(wanted)
    shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted])))
    return F.when((n >= k * 0.8 - 1e-9) & (n * 0.8 - 1e-9 <= k), shared / (n + k - shared) > 0.8).otherwise(False)


def fallback_fill(accepted: DataFrame, requests: DataFrame, subject: str = "blockchain", difficulty: str = "medium") -> DataFrame:
    """Rows that bring every assessment to its requested count, cycling through the templates.

    The text about to be used is held against all texts used before, accepted ones and fallbacks: round one tries the
    plain text, every later round the prefixed one, and either gives way to the replacing form if it is too like one. A
    prefixed text that was used is too like itself, and what kept it from being used stays, so from the third round on
    it is always the replacing form. Different templates are never alike.
    """
    templates = lx.FALLBACK_TEMPLATES
    forms = [fallback_forms(t[0], subject) for t in templates]
    words = F.array_distinct(F.split(tx.normalize_text(F.col("question_text")), " "))
    seen = accepted.select(KEY, words.alias("words")).groupBy(KEY).agg(
        F.count("*").alias("n"),
        *[F.bool_or(_like(F.col("words"), forms[t][f])).alias(f"seen_{t}_{f}") for t in range(len(templates)) for f in (0, 1)],
    )
    short = requests.select(KEY, "requested").join(seen, KEY, "left").withColumn("missing", F.col("requested") - F.coalesce("n", F.lit(0)))
    rows = short.filter("missing > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("missing") - 1)))
    size = len(templates)
    turn, round_no = (F.col("i") % size).cast("int"), F.floor(F.col("i") / size)

    def text(t: int) -> Column:
        plain, prefixed, other = forms[t]
        met = [F.coalesce(f"seen_{t}_{f}", F.lit(False)) for f in (0, 1)]
        like_first = F.when(met[0], F.lit(_alike(prefixed, other))).otherwise(F.lit(_alike(prefixed, plain)))
        return (
            F.when(round_no == 0, F.when(met[0], F.lit(other)).otherwise(F.lit(plain)))
            .when((round_no == 1) & ~met[1] & ~like_first, F.lit(prefixed))
            .otherwise(F.lit(other))
        )

    def of(column: int) -> Column:
        return F.get(F.array(*[F.array(*map(F.lit, t[column])) if column == 2 else F.lit(t[column]) for t in templates]), turn)

    return rows.select(
        KEY,
        "i",
        F.get(F.array(*[text(t) for t in range(size)]), turn).alias("question_text"),
        of(1).alias("correct_answer"),
        of(2).alias("distractor_texts"),
        F.lit(lx.FALLBACK_MISCONCEPTION).alias("misconception_type"),
        F.lit(lx.FALLBACK_REASON).alias("misconception_explanation"),
        F.concat(F.lit(lx.FALLBACK_EXPLANATION), of(3)).alias("explanation"),
        F.lit(difficulty).alias("difficulty"),
        F.lit("understand").alias("bloom_level"),
        of(3).alias("source_context"),
        turn.cast("bigint").alias("template_used"),
    )


def guaranteed_set(accepted: DataFrame, requests: DataFrame, subject: str = "blockchain") -> DataFrame:
    """Exactly the requested number of rows per assessment: accepted questions in order, then fallbacks. The accepted ones are
    written once, as they are ranked, counted and compared."""
    order = W.partitionBy(KEY).orderBy(IDX)
    accepted = written(accepted.select(KEY, IDX, "question_text"), scratch(accepted.sparkSession))
    first = exact_count(accepted, requests)
    kept = first.withColumn("place", F.row_number().over(order).cast("bigint")).select(KEY, "place", "question_text", F.lit("generated").alias("origin"))
    counts = accepted.groupBy(KEY).agg(F.count("*").alias("n"))
    spare = fallback_fill(accepted, requests, subject).join(counts, KEY, "left")
    return kept.unionByName(spare.select(KEY, (F.coalesce("n", F.lit(0)) + F.col("i") + 1).alias("place"), "question_text", F.lit("fallback").alias("origin")))


def overlay(questions: DataFrame, listed: DataFrame, fresh: DataFrame) -> DataFrame:
    """Replace the questions at listed indices by new ones: the i-th listed index takes the i-th new one.

    listed: assessment_id, slot, question_index; fresh: assessment_id, slot, question_text.
    Indices outside the assessment and slots without a new question change nothing.
    """
    new = listed.join(fresh, [KEY, "slot"]).select(KEY, IDX, F.col("question_text").alias("new_text"))
    return questions.join(new, [KEY, IDX], "left").select(
        KEY, IDX, F.coalesce("new_text", "question_text").alias("question_text"), F.col("new_text").isNotNull().alias("replaced")
    )


def regenerate_candidates(scored: DataFrame, listed: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Questions below the threshold or explicitly listed."""
    marks = listed.select(KEY, IDX).distinct().withColumn("listed", F.lit(True))
    rows = scored.select(KEY, IDX, "overall_score").join(marks, [KEY, IDX], "left")
    below = F.col("overall_score") < threshold
    return rows.filter(below | F.col("listed")).select(
        KEY, IDX, "overall_score", F.coalesce("listed", F.lit(False)).alias("listed")
    )


def difficulty_mix(questions: DataFrame, quota: dict[str, int]) -> DataFrame:
    """The first questions of each difficulty up to its quota."""
    order = W.partitionBy(KEY, "difficulty").orderBy(IDX)
    limit = tx.lookup(F.col("difficulty"), {k: str(v) for k, v in quota.items()}, "0").cast("int")
    ranked = questions.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(quota.values()))
    return ranked.filter(F.col("n") <= limit).drop("n")


def cached_reuse(cached: DataFrame, entries: DataFrame, requests: DataFrame, as_of: str, ttl_days: int = 7) -> DataFrame:
    """First requested questions of a fresh cached set that is large enough.

    cached: questions with a dense index; entries: assessment_id, cached_at; requests: requested.
    """
    sizes = cached.groupBy(KEY).agg(F.count("*").alias("n"))
    oldest = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days))
    usable = (
        entries.filter(F.col("cached_at") >= oldest)
        .join(sizes, KEY)
        .join(requests, KEY)
        .filter(F.col("n") >= F.col("requested"))
        .select(KEY, "requested")
    )
    return cached.join(usable, KEY).filter(F.col(IDX) < F.col("requested")).drop("requested")


def seeded_shuffle(questions: DataFrame, seed: str) -> DataFrame:
    """A repeatable random order."""
    key = F.md5(F.concat_ws("|", KEY, IDX, F.lit(seed)))
    return questions.withColumn("shuffle_key", key).orderBy("shuffle_key", KEY, IDX)


def concat_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b)
    return out

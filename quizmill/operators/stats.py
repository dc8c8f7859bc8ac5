"""Assessment-level statistics over a scored question bank.

Plain hash aggregates: every one combines map-side, so a huge assessment costs no more
than many small ones. Ranked results (top terms, top issues) rank aggregated counts only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.functions import text as tx
from quizmill.functions.frames import hold
from quizmill.sources.stores import written
from quizmill.streaming.progress import scratch

KEY = "assessment_id"


def round3(c: Column) -> Column:
    """Three decimals, insensitive to the summation order of the parts."""
    return F.round(F.round(c, 9), 3)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def _overview() -> tuple[dict, list]:
    """Sums and values of the overview; every part below comes as such a pair, so that parts can share one aggregate."""
    grades = [label for _, label in lx.GRADE_BANDS] + [lx.GRADE_LAST]
    names = {g: "grade_" + g.replace("+", "_plus").replace("-", "_minus").lower() for g in grades}
    sums = {
        "total_questions": F.count("*"),
        "mean_score": F.avg("overall_score"),
        "high_quality_questions": count_where(F.col("quality_grade").isin(*lx.HIGH_GRADES)),
        **{n: count_where(F.col("quality_grade") == g) for g, n in names.items()},
    }
    share = F.round(F.round(F.col("high_quality_questions") * 100 / F.col("total_questions"), 9), 1)
    return sums, [
        F.col("total_questions"),
        round3(F.col("mean_score")).alias("average_quality_score"),
        rules.grade(F.round("mean_score", 9)).alias("overall_grade"),
        F.col("high_quality_questions"),
        share.alias("high_quality_percentage"),
        *map(F.col, names.values()),
    ]


def _distribution() -> tuple[dict, list]:
    sums = {
        "mean_score": F.avg("overall_score"),
        "deviation": F.stddev_samp("overall_score"),
        "lowest": F.min("overall_score"),
        "highest": F.max("overall_score"),
        "quartiles": F.percentile("overall_score", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))),
    }
    return sums, [
        round3(F.col("mean_score")).alias("mean"),
        round3(F.get("quartiles", F.lit(1))).alias("median"),
        round3(F.coalesce("deviation", F.lit(0.0))).alias("std_dev"),
        round3(F.col("lowest")).alias("min_score"),
        round3(F.col("highest")).alias("max_score"),
        round3(F.get("quartiles", F.lit(0))).alias("q1"),
        round3(F.get("quartiles", F.lit(2))).alias("q3"),
    ]


def _balance() -> tuple[dict, list]:
    kinds = {k: k.lower() for k in lx.IDEAL_DIFFICULTY}
    sums = {"total_questions": F.count("*"), **{f"{n}_count": count_where(F.upper("difficulty") == k) for k, n in kinds.items()}}
    share = {n: F.col(f"{n}_count") / F.col("total_questions") for n in kinds.values()}
    gap = sum(F.abs(share[kinds[k]] - v) for k, v in lx.IDEAL_DIFFICULTY.items())
    balance = F.round(1.0 - gap / 2, 9)
    return sums, [
        *[F.col(f"{n}_count") for n in share],
        *[F.round(F.round(F.col(f"{n}_count") * 100 / F.col("total_questions"), 9), 1).alias(f"{n}_percent") for n in share],
        F.round(balance, 3).alias("balance_score"),
        (balance > 0.8).alias("well_balanced"),
    ]


def _score() -> tuple[dict, list]:
    sums = {
        "total_questions": F.count("*"),
        "mean_score": F.avg("overall_score"),
        "deviation": F.stddev_samp("overall_score"),
        "levels": F.count_distinct("bloom_level"),
    }
    steady = F.when(F.col("total_questions") > 1, F.greatest(F.lit(0.0), (0.2 - F.col("deviation")) * 0.5)).otherwise(0.0)
    varied = F.when(F.col("levels") >= 3, 0.05).otherwise(0.0)
    return sums, [round3(F.least(F.lit(1.0), F.col("mean_score") + steady + varied)).alias("quality_score")]


def _advice() -> tuple[dict, list]:
    m = lx.ASSESSMENT_ADVICE
    lead, tail = m["low"]
    sums = {
        "total_questions": F.count("*"),
        "low": count_where(F.col("overall_score") < 0.6),
        "predicted_easy": count_where(F.col("predicted_level") == "EASY"),
        "predicted_hard": count_where(F.col("predicted_level") == "HARD"),
        "levels": F.count_distinct("bloom_level"),
    }
    easy, hard = (F.col(f"predicted_{k}") / F.col("total_questions") for k in ("easy", "hard"))
    own = tx.issues(
        (F.col("low") > 0, F.concat(F.lit(lead), F.col("low"), F.lit(tail))),
        (easy > 0.5, m["easy"]),
        ((easy <= 0.5) & (hard > 0.4), m["hard"]),
        (F.col("levels") < 3, m["levels"]),
    )
    return sums, [own.alias("own_advice")]


def gathered(rows: DataFrame, *parts: tuple[dict, list]) -> DataFrame:
    """One aggregate per assessment for all parts; a sum that several parts name is the same one."""
    sums = {name: c for part, _ in parts for name, c in part.items()}
    values = [c for _, part in parts for c in part]
    return rows.groupBy(KEY).agg(*[c.alias(n) for n, c in sums.items()]).select(KEY, *values)


def overview(scored: DataFrame) -> DataFrame:
    """Size, mean score and its grade, share of high grades, one count column per grade."""
    return gathered(scored, _overview())


def score_distribution(scored: DataFrame) -> DataFrame:
    return gathered(scored, _distribution())


def difficulty_balance(bank: DataFrame) -> DataFrame:
    return gathered(bank, _balance())


def question_terms(bigrams: bool, text: str = "question_text") -> tuple[Column, Column]:
    """Words of two letters or more without stop words, and pairs of neighbours among them (none unless asked for)."""
    words = F.filter(
        F.regexp_extract_all(F.lower(text), F.lit("(" + tx.WORD + "{2,})"), F.lit(1)),
        lambda w: ~w.isin(*lx.STOP_WORDS),
    )
    if not bigrams:
        return words, F.array().cast("array<string>")
    pairs = F.filter(
        F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)),
        lambda p: p.isNotNull(),
    )
    return words, pairs


def term_counts(bank: DataFrame, bigrams: bool, text: str = "question_text") -> DataFrame:
    """(assessment, question, term, tf): words of two letters or more, stop words removed, and once the empty term of every
    question."""
    terms = F.concat(F.array(F.lit("")), *[F.coalesce(t, F.array().cast("array<string>")) for t in question_terms(bigrams, text)])
    return (
        bank.select(KEY, "question_index", F.explode(terms).alias("term"))
        .groupBy(KEY, "question_index", "term")
        .agg(F.count("*").alias("tf"))
    )


def weighted_terms(tf: DataFrame, keep: int | None = None) -> DataFrame:
    """L2-normalised tf-idf weights per question of term_counts(); optionally only the most frequent terms.

    One chain of windows: rows are read once, and where they come placed by assessment none is shuffled. The empty term is the
    first of its assessment, so all rows after it know the number of questions.
    """
    per = W.partitionBy(KEY, "term")
    n = F.sum(F.when(F.col("term") == "", F.col("tf"))).over(W.partitionBy(KEY).orderBy("term"))
    terms = tf.withColumns({"cf": F.sum("tf").over(per), "df": F.count("*").over(per), "n": n}).filter("term <> ''")
    if keep is not None:
        order = W.partitionBy(KEY).orderBy(F.desc("cf"), "term")
        terms = terms.withColumn("rk", F.dense_rank().over(order)).filter(F.col("rk") <= keep)
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = terms.withColumn("w", F.col("tf") * idf)
    # one window group is the terms of one question
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(KEY, "question_index")))
    return raw.select(KEY, "question_index", "term", (F.col("w") / norm).alias("weight"))


def assessment_sizes(bank: DataFrame) -> DataFrame:
    return bank.groupBy(KEY).agg(F.count("*").alias("n"))


def concept_coverage(bank: DataFrame, vocabulary: int = 50, top: int = 10) -> DataFrame:
    """Top terms by summed weight, among the most frequent single words and word pairs."""
    weights = weighted_terms(term_counts(bank, bigrams=True), keep=vocabulary)
    sums = weights.groupBy(KEY, "term").agg(F.round(F.sum("weight"), 9).alias("s"))
    # at most vocabulary rows per assessment are left here
    order = W.partitionBy(KEY).orderBy(F.desc("s"), "term")
    return (
        sums.withColumn("concept_diversity", F.count("*").over(W.partitionBy(KEY)))
        .withColumn("term_rank", F.row_number().over(order))
        .filter(F.col("term_rank") <= top)
        .select(
            KEY,
            F.col("term_rank").cast("bigint").alias("term_rank"),
            F.col("term").alias("concept"),
            F.round("s", 3).alias("score"),
            "concept_diversity",
            F.when(F.col("concept_diversity") >= 5, "good").otherwise("limited").alias("coverage"),
        )
    )


def diversity(square: Column, n: Column) -> Column:
    """One minus the mean pairwise cosine of n unit vectors, from the squared length of their sum."""
    return F.round(F.when(square.isNull() | (n < 2), 0.5).otherwise(1 - (square - n) / F.greatest(n * (n - 1), F.lit(1))), 9)


def content_diversity(bank: DataFrame) -> DataFrame:
    """One minus the mean pairwise cosine. The sum over all pairs of unit vectors is the squared
    length of their sum, so no pair is ever formed."""
    sizes = bank.groupBy(KEY).agg(
        F.count("*").alias("n"), F.count_distinct("question_type").alias("types")
    )
    weights = weighted_terms(term_counts(bank, bigrams=False))
    per_term = weights.groupBy(KEY, "term").agg(F.sum("weight").alias("s"))
    square = per_term.groupBy(KEY).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    n = F.col("n")
    content = diversity(F.col("square"), n)
    types = F.round(F.col("types") / n, 9)
    return sizes.join(square, KEY, "left").select(
        KEY,
        F.round(types, 3).alias("type_diversity"),
        F.round(content, 3).alias("content_diversity"),
        round3((types + content) / 2).alias("overall_diversity"),
        F.when(content > 0.7, "high").when(content > 0.4, "medium").otherwise("low").alias("diversity_level"),
    )


def misconception_counts(bank: DataFrame) -> DataFrame:
    return (
        bank.select(KEY, F.explode("distractors").alias("d"))
        .groupBy(KEY, F.col("d.misconception_type").alias("misconception_type"))
        .agg(F.count("*").alias("uses"))
    )


def misconception_usage(bank: DataFrame, top: int = 5) -> DataFrame:
    counts = misconception_counts(bank)
    totals = counts.groupBy(KEY).agg(
        F.sum("uses").alias("total_distractors"), F.count("*").alias("unique_misconceptions")
    )
    order = W.partitionBy(KEY).orderBy(F.desc("uses"), "misconception_type")
    best = counts.withColumn("use_rank", F.row_number().over(order)).filter(F.col("use_rank") <= top)
    return best.join(totals, KEY).select(
        KEY,
        F.col("use_rank").cast("bigint").alias("use_rank"),
        "misconception_type",
        "uses",
        "total_distractors",
        "unique_misconceptions",
        F.round(F.col("unique_misconceptions") / F.col("total_distractors"), 6).alias("diversity_score"),
    )


def common_issues(scored: DataFrame, top: int = 3, share: float = 0.3) -> DataFrame:
    """Issues among the top ones that touch more than a share of the questions. Reads the scored questions twice."""
    sizes = assessment_sizes(scored)
    counts = (
        scored.select(
            KEY, F.explode(F.concat("clarity_issues", "distractor_issues", "language_issues")).alias("issue")
        )
        .groupBy(KEY, "issue")
        .agg(F.count("*").alias("hits"))
    )
    order = W.partitionBy(KEY).orderBy(F.desc("hits"), "issue")
    return (
        counts.withColumn("issue_rank", F.row_number().over(order))
        .filter(F.col("issue_rank") <= top)
        .join(sizes, KEY)
        .filter(F.col("hits") > F.col("n") * share)
    )


def assessment_advice(scored: DataFrame) -> DataFrame:
    """recommendations: array of texts per assessment. What they rest on is written once and read three times."""
    read = [KEY, "overall_score", "predicted_level", "bloom_level", "clarity_issues", "distractor_issues", "language_issues"]
    scored = written(scored.select(*read), scratch(scored.sparkSession))
    own = gathered(scored, _advice())
    texts = F.transform(
        F.array_sort(F.collect_list(F.struct("issue_rank", "issue"))),
        lambda s: F.concat(F.lit(lx.ASSESSMENT_ADVICE["issue"]), s["issue"]),
    )
    common = common_issues(scored).groupBy(KEY).agg(texts.alias("common"))
    return own.join(common, KEY, "left").select(
        KEY, F.concat("own_advice", F.coalesce("common", F.array().cast("array<string>"))).alias("recommendations")
    )


def assessment_score(scored: DataFrame) -> DataFrame:
    return gathered(scored, _score())


def share_bias(bank: DataFrame) -> DataFrame:
    """Share of each answer letter; biased when one letter takes more than 40 %."""
    letters = ["A", "B", "C", "D"]
    agg = bank.groupBy(KEY).agg(
        F.count("*").alias("n"),
        *[count_where(F.col("correct_position") == p).alias(p) for p in letters],
    )
    top = F.greatest(*[F.col(p) / F.col("n") for p in letters])
    return agg.select(
        KEY,
        *[F.round(F.col(p) / F.col("n"), 6).alias("share_" + p.lower()) for p in letters],
        F.round(top, 6).alias("max_share"),
        (top > 0.4).alias("bias_detected"),
    )


def difficulty_variety(bank: DataFrame) -> DataFrame:
    kinds = list(lx.IDEAL_DIFFICULTY)
    agg = bank.groupBy(KEY).agg(
        F.count("*").alias("n"),
        F.count_distinct("difficulty").alias("variety_score"),
        *[count_where(F.upper("difficulty") == k).alias(k) for k in kinds],
    )
    return agg.select(
        KEY,
        F.col("n").alias("total_questions"),
        "variety_score",
        *[F.round(F.col(k) / F.col("n"), 6).alias("share_" + k.lower()) for k in kinds],
    )


def full_analysis(scored: DataFrame, vocabulary: int = 50, top: int = 10) -> DataFrame:
    """Every assessment-level figure on one row, from one aggregate over questions and one chain over counted terms.

    Words, word pairs, issues, misconceptions and the questions themselves are counted together as terms of five kinds;
    their totals give ranks and inverse frequencies. Every step groups by the assessment first: where `scored` comes placed by
    it (bridge.question_bank, placed), no term is shuffled, elsewhere the counts are, once. Windows sort and spill; arrays
    hold at most `vocabulary` terms.
    """
    words, pairs = question_terms(True)
    kinds = {
        "word": words, "pair": pairs, "issue": F.concat("clarity_issues", "distractor_issues", "language_issues"),
        "misconception": F.transform("distractors", lambda x: x["misconception_type"]), "question": F.array(F.lit("")),
    }

    def tagged(kind: str, terms: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    counts = (
        scored.select(KEY, "question_index", F.inline(F.concat(*[tagged(k, a) for k, a in kinds.items()])))
        .groupBy(KEY, "question_index", "kind", "term")
        .agg(F.count("*").alias("tf"))
    )
    textual = F.col("kind").isin("word", "pair")
    per = W.partitionBy(KEY, "kind", "term")
    # equal terms are of one kind within a group (a pair holds a space, a word none), so a dense rank numbers the distinct ones
    order = W.partitionBy(KEY, F.when(textual, "text").otherwise(F.col("kind"))).orderBy(F.desc("cf"), "term")
    n = F.sum(F.when(F.col("kind") == "question", F.col("tf"))).over(W.partitionBy(KEY))
    terms = counts.withColumns({"cf": F.sum("tf").over(per), "df": F.count("*").over(per)}).withColumns({"rk": F.dense_rank().over(order), "n": n})
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    wide = terms.withColumns(
        {"w": F.col("tf") * idf, "counted": textual & (F.col("rk") <= vocabulary), "word": F.col("kind") == "word"}
    )
    question = W.partitionBy(KEY, "question_index")
    unit = {c: F.when(F.col(c), F.col("w") / F.sqrt(F.sum(F.when(F.col(c), F.col("w") * F.col("w"))).over(question))) for c in ("counted", "word")}
    weighed = wide.withColumns({"counted_w": unit["counted"], "word_w": unit["word"]})
    per_term = weighed.groupBy(KEY, "kind", "term", "rk", "cf", "n").agg(F.round(F.sum("counted_w"), 9).alias("covers"), F.sum("word_w").alias("s"))
    listed = F.collect_list(F.when(F.col("covers").isNotNull(), F.struct((-F.col("covers")).alias("by"), "term")))
    common = (F.col("kind") == "issue") & (F.col("rk") <= 3) & (F.col("cf") > F.col("n") * 0.3)
    about = per_term.groupBy(KEY).agg(
        F.max("n").alias("n"),
        F.sum(F.col("s") * F.col("s")).alias("square"),
        F.array_sort(listed).alias("listed"),
        F.array_sort(F.collect_list(F.when(common, F.struct("rk", "term")))).alias("common"),
        F.count_if(F.col("kind") == "misconception").alias("unique_misconceptions"),
    )
    advice = F.transform("common", lambda s: F.concat(F.lit(lx.ASSESSMENT_ADVICE["issue"]), s["term"]))
    base = gathered(scored, _overview(), _distribution(), _balance(), _score(), _advice())
    return base.join(about, KEY).select(
        KEY, "total_questions", "average_quality_score", "overall_grade", "high_quality_percentage", "median", "std_dev",
        "balance_score", "well_balanced",
        F.round(diversity(F.col("square"), F.col("n")), 3).alias("content_diversity"),
        "quality_score",
        F.array_join(F.concat("own_advice", advice), " | ").alias("recommendations"),
        F.array_join(F.transform(F.slice("listed", 1, top), lambda s: s["term"]), ", ").alias("top_concepts"),
        "unique_misconceptions",
    )


def system_advice() -> Column:
    m = lx.SYSTEM_ADVICE
    return tx.issues(
        (F.col("success_rate") < 0.8, m["success"]),
        (F.col("generation_time") > 60, m["time"]),
        (F.col("average_quality_score") < 0.6, m["quality"]),
    )


def quality_alerts(over: DataFrame, balance: DataFrame) -> DataFrame:
    """One row per alert."""
    low = over.filter(F.col("high_quality_percentage") < 50).select(
        KEY,
        F.lit("warning").alias("level"),
        F.concat(F.lit("Only "), F.format_number("high_quality_percentage", 1), F.lit("% of questions are high quality")).alias("message"),
    )
    skew = balance.filter(~F.col("well_balanced")).select(
        KEY, F.lit("info").alias("level"), F.lit("Difficulty distribution is not well balanced").alias("message")
    )
    return low.unionByName(skew)


def chart_series(scored: DataFrame) -> DataFrame:
    """Histograms behind the charts: grade letter, difficulty, misconception type."""
    pairs = F.array(
        F.struct(F.lit("quality").alias("chart"), F.expr("left(quality_grade, 1)").alias("label")),
        F.struct(F.lit("difficulty").alias("chart"), F.col("difficulty").alias("label")),
    )
    kinds = F.transform(
        "distractors", lambda d: F.struct(F.lit("misconception").alias("chart"), d["misconception_type"].alias("label"))
    )
    return (
        scored.select(KEY, F.inline(F.concat(pairs, kinds)))
        .groupBy(KEY, "chart", "label")
        .agg(F.count("*").alias("value"))
    )


def quality_bins(scores: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    label = F.when(c <= 0.5, "low").when(c <= 0.8, "medium").otherwise("high")
    return scores.groupBy(KEY, label.alias("bin")).agg(F.count("*").alias("questions"))


def low_quality(scores: DataFrame, column: str, limit: float = 0.7, cut: int = 100) -> DataFrame:
    rows = scores.select(
        KEY,
        (F.col("question_index") + 1).alias("question_number"),
        F.substring("question_text", 1, cut).alias("preview"),
        F.col(column).alias("s"),
    )
    rows = hold(rows, score=F.col("s")).drop("s").filter(F.col("score") < limit)
    # a sort reads its rows twice, so they are written before
    return written(rows, scratch(rows.sparkSession)).orderBy("score", KEY, "question_number")


def concept_sets(bank: DataFrame) -> DataFrame:
    """Distinct concepts per assessment: the tagged one and the keywords in the text."""
    found = F.transform(tx.present(F.lower("question_text"), lx.UI_CONCEPTS), lambda w: F.initcap(w))
    rows = bank.select(KEY, F.explode(F.concat(F.array("concept"), found)).alias("concept_name"))
    return rows.filter("concept_name <> ''").groupBy(KEY, "concept_name").agg(F.count("*").alias("mentions"))


def decimate(series: DataFrame, max_points: int) -> DataFrame:
    """Every ceil(n / max_points)-th point of each assessment's series, by position."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n") / max_points))
    return series.join(assessment_sizes(series), KEY).filter(F.col("question_index") % step == 0).drop("n")


def generation_statistics(accepted: DataFrame, requests: DataFrame) -> DataFrame:
    """requests: one row per assessment with requested and generation_time."""
    n = F.coalesce("n", F.lit(0))
    return requests.join(assessment_sizes(accepted), KEY, "left").select(
        KEY,
        "requested",
        n.alias("generated"),
        F.round(n / F.col("requested"), 6).alias("success_rate"),
        F.when(n > 0, F.round(F.col("generation_time") / n, 6)).otherwise(0.0).alias("time_per_question"),
        (n == F.col("requested")).alias("exact_count"),
    )


def pipeline_metrics(bank: DataFrame) -> DataFrame:
    """Duplicates, placeholders, short options and distributions per assessment."""
    whole = F.lower(
        F.concat_ws(
            "\n", "question_text", F.array_join(rules.option_texts(), "\n"), "explanation",
            F.array_join(F.transform("distractors", lambda d: d["explanation"]), "\n"),
        )
    )
    lengths = rules.option_words(3)
    # identical texts meet in one group first, so duplicates need no distinct count per assessment
    per_text = bank.select(
        KEY,
        F.xxhash64("question_text").alias("text_hash"),
        "question_text",
        tx.any_word(whole, lx.REPORT_PLACEHOLDERS).alias("placeholder"),
        F.size(F.filter(lengths, lambda k: k < 3)).alias("short"),
        rules.total(lengths).alias("words"),
        F.size(lengths).alias("options"),
        "difficulty",
        "correct_position",
    ).groupBy(KEY, "text_hash", "question_text").agg(
        F.count("*").alias("n"),
        count_where(F.col("placeholder")).alias("placeholders"),
        F.sum("short").alias("short"),
        F.sum("words").alias("words"),
        F.sum("options").alias("options"),
        *[count_where(F.col("difficulty") == d).alias(d) for d in ("easy", "medium", "hard")],
        *[count_where(F.col("correct_position") == p).alias(p) for p in "ABCD"],
    )
    agg = per_text.groupBy(KEY).agg(
        F.sum("n").alias("total_questions"),
        F.sum(F.col("n") - 1).alias("duplicate_questions"),
        F.sum("placeholders").alias("placeholder_count"),
        F.sum("short").alias("short_options_count"),
        F.round(F.sum("words") / F.sum("options"), 6).alias("avg_option_length"),
        *[F.sum(d).alias(d + "_questions") for d in ("easy", "medium", "hard")],
        *[F.sum(p).alias("position_" + p.lower()) for p in "ABCD"],
    )
    found = F.col("placeholder_count") + F.col("short_options_count") + F.col("duplicate_questions")
    return agg.withColumn(
        "verdict",
        F.when(found == 0, "excellent").when(found <= 2, "good").when(found <= 5, "fair").otherwise("poor"),
    )

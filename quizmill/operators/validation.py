"""Question validation: issue lists per question, issue tables, scores and reports."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.functions import text as tx
from quizmill.functions.frames import hold
from quizmill.operators import stats
from quizmill.operators.dedupe import later_copies, text_key
from quizmill.sources.stores import written
from quizmill.streaming.progress import scratch

KEY = "assessment_id"
ISSUE = "struct<severity:string,issue_type:string,description:string,suggestion:string>"


def fill(template: str, **parts: Column | str) -> Column:
    """The template with its {names} replaced by columns."""
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    cols = []
    for p in pieces:
        if p.startswith("{"):
            value = parts[p[1:-1]]
            cols.append(F.lit(value) if isinstance(value, str) else value.cast("string"))
        else:
            cols.append(F.lit(p))
    return F.concat(*cols)


def issue(kind: str, **parts: Column | str) -> Column:
    severity, issue_type, description, suggestion = lx.VALIDATION[kind]
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(issue_type).alias("issue_type"),
        fill(description, **parts).alias("description"),
        fill(suggestion, **parts).alias("suggestion"),
    )


def found(*pairs: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, value) for cond, value in pairs]))


def bounded(pattern: str) -> str:
    """Word boundaries as explicit character tests, alike for every script."""
    edge = r"[^\p{L}\p{N}_]"
    inner = re.fullmatch(r"\\b(.*)\\b", pattern)
    return f"(?:^|{edge}){inner[1]}(?:{edge}|$)" if inner else pattern


def text_issues(text: Column, field: str, low: Column | None = None, n: Column | None = None) -> Column:
    """Problems of one text field; an empty field has no further issues. Its lower case and its words may be given where they
    are known. A placeholder's pattern is tried only where the sign it holds stands in the text."""
    is_question = field == "question_text"
    least = lx.QUESTION_WORDS_MIN if is_question else lx.OPTION_WORDS_MIN
    most = lx.QUESTION_WORDS_MAX if is_question else lx.OPTION_WORDS_MAX
    low, n = F.lower(text) if low is None else low, tx.word_count(text) if n is None else n
    checks = [
        (F.contains(low, F.lit(sign)) & F.rlike(text, F.lit("(?i)" + bounded(p))), issue("placeholder", field=field, text=F.left(text, F.lit(50))))
        for p, sign in zip(lx.PLACEHOLDER_PATTERNS, lx.PLACEHOLDER_SIGNS, strict=True)
    ]
    checks.append((n < least, issue("short", field=field, n=n, limit=str(least))))
    checks.append((n > most, issue("long", field=field, n=n, limit=str(most))))
    if not is_question:
        checks.append((F.endswith(text, F.lit("?")), issue("question_mark", field=field)))
    return F.when(
        text.isNull() | (F.trim(text) == ""), F.array(issue("empty", field=field))
    ).otherwise(found(*checks))


def option(letter: str) -> Column:
    """Text of an option: the answer at A, distractors after it; null when missing."""
    return F.col(f"option_{letter}")


def with_options(bank: DataFrame) -> DataFrame:
    """Adds option_A to option_D, their lower case and option_lengths, computed once per question."""
    texts = hold(bank, option_list=rules.option_texts(3))
    each = {f"option_{k}": F.get("option_list", F.lit(i)) for i, k in enumerate("ABCD")}
    low = {f"low_{k}": F.lower(c) for k, c in zip("ABCD", each.values(), strict=True)}
    return hold(texts, option_lengths=F.transform("option_list", tx.word_count), **each, **low)


def option_issues() -> Column:
    """Reads the columns of with_options()."""
    lengths = F.col("option_lengths")
    mean = rules.total(lengths) / F.size(lengths)
    words = {k: F.get(lengths, F.lit(i)) for i, k in enumerate("ABCD")}
    missing = found(*[(option(k).isNull(), issue("missing_option", key=k)) for k in "ABCD"])
    texts = [
        F.when(option(k).isNull(), F.array().cast(f"array<{ISSUE}>")).otherwise(text_issues(option(k), f"option_{k}", F.col(f"low_{k}"), words[k]))
        for k in "ABCD"
    ]
    uneven = found(
        *[
            (
                (F.size(lengths) >= 3) & (F.abs(words[k] - mean) > mean * 0.75),
                issue("unbalanced", key=k),
            )
            for k in "ABCD"
        ]
    )
    return F.concat(missing, *texts, uneven)


def field_issues() -> Column:
    position, level = F.col("correct_position"), F.lower("difficulty")
    return found(
        *[
            (F.col(c).isNull(), issue("missing_field", field=f))
            for c, f in [("question_text", "question_text"), ("correct_answer", "options"), ("correct_position", "correct_position")]
        ],
        (~F.coalesce(position, F.lit("")).isin("A", "B", "C", "D"), issue("position", value=F.coalesce(position, F.lit("")))),
        (~F.coalesce(level, F.lit("")).isin("easy", "medium", "hard"), issue("difficulty", value=F.coalesce(level, F.lit("")))),
    )


def issue_rows(bank: DataFrame, issues: Column) -> DataFrame:
    """quality_issues: one row per issue, question numbers from one."""
    return with_options(bank).select(KEY, (F.col("question_index") + 1).alias("question_id"), F.inline(issues))


def _all_issues(rows: DataFrame) -> DataFrame:
    """The issues of examined() questions, those that are copies among them."""
    own = rows.select(KEY, (F.col("question_index") + 1).alias("question_id"), F.inline("issues"))
    return own.unionByName(_copy_issues(rows))


def _copy_issues(keyed: DataFrame) -> DataFrame:
    dup = later_copies(keyed.select(KEY, "question_index", "text_key"))
    return dup.select(
        KEY,
        (F.col("question_index") + 1).alias("question_id"),
        F.inline(F.array(issue("duplicate", n=F.col("first_index") + 1))),
    )


def own_issues() -> Column:
    """Everything wrong with a question by itself; reads the columns of with_options(), low_question and question_length."""
    question = text_issues(F.col("question_text"), "question_text", F.col("low_question"), F.col("question_length"))
    return F.concat(field_issues(), question, option_issues())


def copy_counts(keyed: DataFrame) -> DataFrame:
    """Questions per assessment whose text an earlier one has: two map-side counts, no question meets another."""
    texts = keyed.filter("text_key IS NOT NULL").groupBy(KEY, "text_key").agg(F.count("*").alias("n"))
    return texts.groupBy(KEY).agg(F.sum(F.col("n") - 1).alias("copies"))


def examined(bank: DataFrame) -> DataFrame:
    """(assessment_id, question_index, correct_position, difficulty, text_key, issues): what is wrong with each question by
    itself."""
    rows = hold(with_options(bank), low_question=F.lower("question_text"), question_length=tx.word_count(F.col("question_text")))
    return rows.select(KEY, "question_index", "correct_position", "difficulty", text_key().alias("text_key"), own_issues().alias("issues"))


def validation_scores(bank: DataFrame) -> DataFrame:
    """Severity counts and the 0-100 score of each assessment."""
    return _scores(written(examined(bank).withColumn("issues", F.transform("issues", lambda x: F.struct(x["severity"]))), scratch(bank.sparkSession)))


def _scores(rows: DataFrame) -> DataFrame:
    """validation_scores() of examined() questions."""
    severities = ("critical", "major", "minor")

    def equals(severity: str) -> Callable[[Column], Column]:
        return lambda x: x == severity

    copy_severity = lx.VALIDATION["duplicate"][0]
    own = {f"own_{s}": F.sum(F.size(F.filter("issues.severity", equals(s)))) for s in severities}
    letters = {f"at_{p}": F.count_if(F.col("correct_position") == p) for p in "ABCD"}
    shape = rows.groupBy(KEY).agg(F.count("*").alias("total_questions"), F.count_distinct("difficulty").alias("variety_score"), *[c.alias(n) for n, c in (own | letters).items()])
    top = F.greatest(*[F.col(n) / F.col("total_questions") for n in letters])
    copies = F.coalesce("copies", F.lit(0))
    joined = shape.join(copy_counts(rows), KEY, "left").select(
        KEY, (top > 0.4).alias("bias_detected"), F.round(top, 6).alias("max_share"), "total_questions", "variety_score",
        *[(F.col(f"own_{s}") + (copies if s == copy_severity else 0)).alias(f"{s}_issues") for s in severities],
        copies.alias("duplicate_questions"),
    )
    score = (
        100
        - F.col("critical_issues") * 20
        - F.col("major_issues") * 10
        - F.col("minor_issues") * 2
        + F.when(F.col("bias_detected"), 0).otherwise(5)
        + F.when(F.col("variety_score") >= 2, 5).otherwise(0)
    )
    return joined.withColumn("overall_score", F.greatest(F.lit(0), F.least(F.lit(100), score)))


def report_lines(bank: DataFrame, shown: int = 10) -> DataFrame:
    """The text report as (assessment_id, section, seq, line): write it sorted, or per assessment.

    Sections are rows of their own, so no assessment is gathered into one value. Questions are examined once and written, as
    scores, details and copies each read them.
    """
    rows = written(examined(bank), scratch(bank.sparkSession))
    scores, issues = _scores(rows), _all_issues(rows)
    rank = W.partitionBy(KEY, "severity").orderBy("question_id", "issue_type", "description")
    top = issues.withColumn("seq", F.row_number().over(rank)).filter(F.col("seq") <= shown)
    bullet = F.concat(F.lit("   • Q"), F.col("question_id"), F.lit(": "), F.col("description"), F.lit("\n     → "), F.col("suggestion"))
    section = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "major", 4).otherwise(5)
    detail = top.select(KEY, section.alias("section"), F.col("seq").cast("bigint").alias("seq"), bullet.alias("line"))

    total = F.col("critical_issues") + F.col("major_issues") + F.col("minor_issues")
    rule = "=" * 60
    head = [
        (1, 1, F.lit(rule)), (1, 2, F.lit(lx.REPORT_TITLE)), (1, 3, F.lit(rule)),
        (2, 1, F.lit("📊 SUMMARY:")),
        (2, 2, F.concat(F.lit("   Overall Score: "), F.col("overall_score"), F.lit(".0/100"))),
        (2, 3, F.concat(F.lit("   Total Questions: "), F.col("total_questions"))),
        (2, 4, F.concat(F.lit("   Total Issues: "), total)),
        (2, 5, F.concat(F.lit("   Critical: "), F.col("critical_issues"))),
        (2, 6, F.concat(F.lit("   Major: "), F.col("major_issues"))),
        (2, 7, F.concat(F.lit("   Minor: "), F.col("minor_issues"))),
        (2, 8, F.concat(F.lit("🎯 GRADE: "), tx.bands(F.col("overall_score"), lx.REPORT_GRADES, lx.REPORT_GRADE_LAST))),
    ]
    for i, s in enumerate(("critical", "major", "minor")):
        n = F.col(f"{s}_issues")
        head.append((3 + i, 0, F.when(n > 0, F.concat(F.lit(f"   {s.upper()} ISSUES ("), n, F.lit("):")))))
        more = F.concat(F.lit("     ... and "), n - shown, F.lit(f" more {s} issues"))
        head.append((3 + i, shown + 1, F.when(n > shown, more)))
    share = F.format_number(F.col("max_share") * 100, 1)
    head.append((6, 1, F.when(F.col("bias_detected"), F.concat(F.lit("⚠️  POSITION BIAS DETECTED: "), share, F.lit("%")))))
    head.append((7, 0, F.lit("💡 RECOMMENDATIONS:")))
    for i, (name, text) in enumerate(lx.REPORT_ADVICE, 1):
        cond = F.col(name) if name == "bias_detected" else F.col(name) > 0
        head.append((7, i, F.when(cond, F.lit(text))))
    head.append((8, 1, F.lit(lx.REPORT_LAST)))
    lines = F.array(
        *[
            F.struct(F.lit(sec).alias("section"), F.lit(seq).cast("bigint").alias("seq"), text.alias("line"))
            for sec, seq, text in head
        ]
    )
    return scores.select(KEY, F.inline(lines)).filter(F.col("line").isNotNull()).unionByName(detail)


def constrain(df: DataFrame, rules_by_name: dict[str, Column]) -> DataFrame:
    """Adds errors (names of the broken rules) and valid."""
    errors = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in rules_by_name.items()]))
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


def question_constraints() -> dict[str, Column]:
    n = F.size("distractors")
    return {
        "question_text_min_length": F.length("question_text") >= 10,
        "question_text_not_blank": F.trim("question_text") != "",
        "correct_answer_not_blank": F.trim("correct_answer") != "",
        "explanation_not_blank": F.trim("explanation") != "",
        "distractor_count": n.between(1, 4),
        "distractor_text_not_blank": F.forall("distractors", lambda d: F.trim(d["text"]) != ""),
        "distractor_type_not_blank": F.forall("distractors", lambda d: F.trim(d["misconception_type"]) != ""),
        "difficulty_domain": F.col("difficulty").isin("easy", "medium", "hard"),
        "question_type_domain": F.col("question_type").isin("multiple_choice", "true_false", "short_answer"),
        "option_keys": n >= 3,
        "options_beyond_d": n <= 3,  # formats and views show A to D
        "correct_position_domain": F.col("correct_position").isin("A", "B", "C", "D"),
    }


def request_constraints() -> dict[str, Column]:
    mix = F.col("easy_quota") + F.col("medium_quota") + F.col("hard_quota")
    return {
        "num_questions_1_20": F.col("num_questions").between(1, 20),
        "num_questions_1_50": F.col("num_questions").between(1, 50),
        "mix_sums_to_total": mix == F.col("num_questions"),
        "page_num_positive": F.col("page_num") >= 1,
        "end_after_start": F.col("end_char") > F.col("start_char"),
        "progress_0_1": F.col("progress").between(0.0, 1.0),
        "chunk_size_1_2000": F.col("chunk_size").between(1, 2000),
        "overlap_below_size": (F.col("chunk_overlap") >= 0) & (F.col("chunk_overlap") < F.col("chunk_size")),
        "max_file_size_1_100": F.col("max_file_mb").between(1, 100),
    }



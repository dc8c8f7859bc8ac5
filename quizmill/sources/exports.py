"""Assessment exports as rows: JSON, course-system CSV and XML, plain text, Markdown.

Every export is one or more rows per question with a sort position, so writing a huge
assessment never gathers it in one value. The writers below sort inside partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.functions.frames import hold

KEY, IDX = "assessment_id", "question_index"
LETTERS = ["A", "B", "C", "D"]


def number() -> Column:
    return F.col(IDX) + 1


def with_options(bank: DataFrame) -> DataFrame:
    """Adds texts: the options in letter order, answer at A."""
    return hold(bank, texts=rules.option_texts(3))


def correct_letter() -> Column:
    """Letter of the first option equal to the answer."""
    at = F.array_position("texts", F.col("correct_answer"))
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), (at - 1).cast("int"))


def export_json(bank: DataFrame, teacher: bool = True, explanations: bool = True, difficulty: bool = True, metadata: bool = False) -> DataFrame:
    """One JSON document per question; switches drop answers, explanations or difficulty, or add metadata."""
    option = lambda t, i: F.struct(t.alias("text"), (i == 0).alias("is_correct"))
    letters = F.slice(F.array(*[F.lit(x) for x in LETTERS]), 1, F.size("texts"))
    fields = [
        number().alias("id"),
        "question_text",
        "question_type",
        *(["difficulty"] if difficulty else []),
        F.map_from_arrays(letters, F.transform("texts", option)).alias("options"),
        *(["correct_answer"] if teacher else []),
        *(["explanation"] if explanations else []),
        *(["distractors"] if teacher else []),
        *([F.struct("concept", "perspective", "source_file").alias("metadata")] if metadata else []),
    ]
    return with_options(bank).select(KEY, IDX, F.to_json(F.struct(*fields)).alias("document"))


def export_header(bank: DataFrame, teacher: bool = True, explanations: bool = True, difficulty: bool = True) -> DataFrame:
    """The document around the questions: version, format, source, statistics and the switches it was written with."""
    switches = {"include_explanations": explanations, "include_difficulty": difficulty, "teacher_version": teacher}
    counts = [F.count_if(F.col("difficulty") == k).alias(k) for k in ("easy", "medium", "hard")]
    rows = bank.groupBy(KEY).agg(F.min("source_file").alias("source_file"), F.count("*").alias("questions"), *counts)
    return rows.select(
        KEY,
        F.to_json(
            F.struct(
                F.lit(lx.EXPORT_VERSION).alias("version"),
                F.lit(lx.EXPORT_FORMAT).alias("format"),
                "source_file",
                F.struct("questions", "easy", "medium", "hard").alias("statistics"),
                F.struct(*[F.lit(v).alias(k) for k, v in switches.items()]).alias("configuration"),
            )
        ).alias("header"),
    )


def export_canvas(bank: DataFrame) -> DataFrame:
    """The nineteen course-system columns; the CSV writer doubles the quotes."""
    cols = [
        F.concat(F.lit("Question "), number()), F.col("question_text"), F.lit("multiple_choice_question"), F.lit("1"),
        F.col("explanation"), F.lit(lx.CANVAS_INCORRECT), F.lit(""),
    ]
    for i in range(4):
        text = F.coalesce(F.get("texts", F.lit(i)), F.lit(""))
        right = text == F.col("correct_answer")
        cols += [text, F.when(right, F.col("explanation")).otherwise(lx.CANVAS_INCORRECT), F.when(right, "100").otherwise("0")]
    return with_options(bank).select(KEY, IDX, *[c.alias(n) for c, n in zip(cols, lx.CANVAS_HEADER)])


def export_forms(bank: DataFrame) -> DataFrame:
    """Question, four options, the number of the last option equal to the answer, explanation."""
    last = F.size("texts") - F.array_position(F.reverse("texts"), F.col("correct_answer")) + 1
    position = F.when(F.array_contains("texts", F.col("correct_answer")), last).otherwise(0)
    cols = [F.col("question_text")]
    cols += [F.coalesce(F.get("texts", F.lit(i)), F.lit("")) for i in range(4)]
    cols += [position.cast("string"), F.col("explanation")]
    return with_options(bank).select(KEY, IDX, *[c.alias(n) for c, n in zip(cols, lx.FORMS_HEADER)])


def to_xml(item: list[Column], tag: str) -> Column:
    """The item as XML. Whether the writer escapes a right angle bracket depends on where its buffer ends; here it is only
    escaped where XML asks for it."""
    return F.replace(F.replace(F.to_xml(F.struct(*item), {"rowTag": tag}), F.lit("&gt;"), F.lit(">")), F.lit("]]>"), F.lit("]]&gt;"))


def export_qti(bank: DataFrame, teacher: bool = True) -> DataFrame:
    """One QTI item per question."""
    name = F.concat(F.lit("response_"), number())
    labels = F.transform(
        "texts",
        lambda t, i: F.struct(
            F.get(F.array(*[F.lit(x) for x in LETTERS]), i).alias("_ident"),
            F.struct(F.struct(F.lit("text/plain").alias("_texttype"), t.alias("_VALUE")).alias("mattext")).alias("material"),
        ),
    )
    presentation = F.struct(
        F.struct(
            F.struct(
                F.lit("text/html").alias("_texttype"), F.concat(F.lit("<p>"), "question_text", F.lit("</p>")).alias("_VALUE")
            ).alias("mattext")
        ).alias("material"),
        F.struct(
            name.alias("_ident"), F.lit("Single").alias("_rcardinality"),
            F.struct(labels.alias("response_label")).alias("render_choice"),
        ).alias("response_lid"),
    )
    scoring = F.struct(
        F.struct(
            F.struct(
                F.lit("100").alias("_maxvalue"), F.lit("0").alias("_minvalue"), F.lit("SCORE").alias("_varname"), F.lit("Decimal").alias("_vartype")
            ).alias("decvar")
        ).alias("outcomes"),
        F.struct(
            F.lit("No").alias("_continue"),
            F.struct(F.struct(name.alias("_respident"), correct_letter().alias("_VALUE")).alias("varequal")).alias("conditionvar"),
            F.struct(F.lit("Set").alias("_action"), F.lit("SCORE").alias("_varname"), F.lit("100").alias("_VALUE")).alias("setvar"),
        ).alias("respcondition"),
    )
    item = [
        F.concat(F.lit("question_"), number()).alias("_ident"),
        F.concat(F.lit("Question "), number()).alias("_title"),
        presentation.alias("presentation"),
        *([scoring.alias("resprocessing")] if teacher else []),
    ]
    return with_options(bank).select(KEY, IDX, to_xml(item, "item").alias("xml"))


def _moodle() -> list[Column]:
    """Parts of a multiple-choice question element, with feedback per option."""

    def html(*parts: Column | str) -> Column:
        return F.concat(F.lit("<p>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("</p>"))

    def answer(t: Column) -> Column:
        right = t == F.col("correct_answer")
        why = F.coalesce(F.get(F.filter("distractors", lambda d: d["text"] == t), F.lit(0))["explanation"], F.lit(""))
        feedback = F.when(right, html("Correct! ", F.col("explanation"))).otherwise(html("Incorrect. ", why))
        return F.struct(
            F.when(right, "100").otherwise("0").alias("_fraction"),
            F.lit("html").alias("_format"),
            html(t).alias("text"),
            F.struct(F.lit("html").alias("_format"), feedback.alias("text")).alias("feedback"),
        )

    return [
        F.lit("multichoice").alias("_type"),
        F.struct(F.concat(F.lit("Question "), number()).alias("text")).alias("name"),
        F.struct(F.lit("html").alias("_format"), html(F.col("question_text")).alias("text")).alias("questiontext"),
        F.lit("1").alias("defaultgrade"), F.lit("0.1").alias("penalty"), F.lit("0").alias("hidden"),
        F.lit("true").alias("single"), F.lit("true").alias("shuffleanswers"),
        F.transform("texts", answer).alias("answer"),
    ]


def export_moodle(bank: DataFrame) -> DataFrame:
    """One multiple-choice question element per question."""
    return with_options(bank).select(KEY, IDX, to_xml(_moodle(), "question").alias("xml"))


#: Questions in one document of a whole bank.
DOCUMENT = 10_000


def write_bank(bank: DataFrame, path: str) -> None:
    """XML documents of question elements that name their assessment in `idnumber`. A task writes the questions that it has,
    so the number of files follows that of the questions, not of the assessments, and nothing is shuffled."""
    own = F.concat(F.coalesce(F.col(KEY).cast("string"), F.lit("")), F.lit("-"), F.col(IDX)).alias("idnumber")
    items = with_options(bank).select(own, *_moodle())
    items.write.format("xml").option("rootTag", "quiz").option("rowTag", "question").option("maxRecordsPerFile", DOCUMENT).mode("overwrite").save(path)


def write_moodle(bank: DataFrame, path: str) -> None:
    """XML documents of question elements, a folder per assessment: for assessments that are handed out one by one, whole banks
    are for write_bank(). An assessment's questions are dealt by number, so one of any size is written by as many tasks as it
    needs; each file is a document of its own."""
    items = with_options(bank).select(KEY, F.floor(F.col(IDX) / 10_000).alias("part"), *_moodle())
    items.repartition(KEY, "part").drop("part").write.format("xml").option("rootTag", "quiz").option("rowTag", "question").mode("overwrite").partitionBy(KEY).save(path)


#: Question elements as they are read; `broken` takes the text of an element that is none.
MOODLE = (
    "idnumber string, _type string, name struct<text: string>, questiontext struct<_format: string, text: string>, defaultgrade string, penalty string, hidden string, single string, shuffleanswers string, "
    "answer array<struct<_fraction: string, _format: string, text: string, feedback: struct<_format: string, text: string>>>, broken string"
)


def read_moodle(spark: SparkSession, path: str) -> DataFrame:
    """(assessment_id, question_index, question_text, correct_answer, texts, feedback, broken) from question documents. The
    assessment is told by the folder, or by the element. An element that can't be read has its text in `broken` and nulls
    elsewhere; others go on."""
    reader = spark.read.format("xml").option("rowTag", "question").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("ignoreSurroundingSpaces", "false")
    rows = reader.schema(f"{MOODLE}, {KEY} bigint").load(path)

    def bare(c: Column) -> Column:
        return F.regexp_replace(c, r"(?s)^<p>(.*)</p>$", "$1")

    number_of = F.try_to_number(F.regexp_extract(F.col("name.text"), r"(\d+)\s*$", 1), F.lit("9999999999")).cast("bigint")
    right = F.filter("answer", lambda a: a["_fraction"] == "100")
    named = F.coalesce("idnumber", F.regexp_extract("broken", r"<idnumber>([^<]*)</idnumber>", 1))
    told = F.regexp_extract(named, r"^(-?\d+)-\d+$", 1).try_cast("bigint")
    return rows.select(
        F.coalesce(KEY, told).alias(KEY), (number_of - 1).alias(IDX), bare(F.col("questiontext.text")).alias("question_text"), bare(F.get(right, F.lit(0))["text"]).alias("correct_answer"),
        F.transform("answer", lambda a: bare(a["text"])).alias("texts"), F.transform("answer", lambda a: bare(a["feedback"]["text"])).alias("feedback"), "broken",
    )




def answer_key(bank: DataFrame) -> DataFrame:
    letter = correct_letter()
    shown = F.coalesce(F.concat(letter, F.lit(". "), F.col("correct_answer")), F.col("correct_answer"))
    why = F.coalesce(F.nullif(F.col("explanation"), F.lit("")), F.lit(lx.NO_EXPLANATION))
    return with_options(bank).select(KEY, IDX, letter.alias("letter"), shown.alias("answer"), why.alias("explanation"))


def _sections(bank: DataFrame, header: Column, question: Column, key_head: str, key: Column, teacher: bool) -> DataFrame:
    """section 1 header, 2 questions; in the teacher version 3 key header, 4 key lines."""
    heads = bank.groupBy(KEY).agg(F.count("*").alias("n")).select(
        KEY,
        F.inline(
            F.array(
                F.struct(F.lit(1).alias("section"), F.lit(0).cast("bigint").alias("seq"), header.alias("block")),
                F.struct(F.lit(3).alias("section"), F.lit(0).cast("bigint").alias("seq"), F.lit(key_head).alias("block")),
            )
        ),
    )
    body = with_options(bank).select(
        KEY,
        F.inline(
            F.array(
                F.struct(F.lit(2).alias("section"), number().alias("seq"), question.alias("block")),
                F.struct(F.lit(4).alias("section"), number().alias("seq"), key.alias("block")),
            )
        ),
    )
    every = heads.unionByName(body)
    return every if teacher else every.filter(F.col("section") <= 2)


def _option_lines(line: Column) -> Column:
    """The option lines of a question, one below the other."""
    return F.array_join(F.transform("texts", line), "\n")


def _letter(i: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in LETTERS]), i)


def _badge(left: str, right: str, shown: bool) -> list[Column]:
    return [F.lit(left), F.col("difficulty"), F.lit(right)] if shown else []


def export_text(bank: DataFrame, teacher: bool = True, explanations: bool = True, difficulty: bool = True) -> DataFrame:
    """Plain text blocks: header and questions; the teacher version marks and explains answers and ends with a key."""
    rule = "=" * 60
    header = F.concat(F.lit(f"{rule}\nASSESSMENT\n{rule}\n\nTotal Questions: "), F.col("n"), F.lit(f"\nVersion: {'Teacher' if teacher else 'Student'}\n"))
    marked = F.col("correct_answer") if teacher else F.lit(None)
    options = _option_lines(lambda t, i: F.concat(F.when(t == marked, ">>> ").otherwise("    "), _letter(i), F.lit(". "), t))
    reason = [F.lit("\n\nExplanation: "), F.col("explanation")] if teacher and explanations else []
    question = F.concat(
        F.lit("QUESTION "), number(), *_badge(" [", "]", difficulty), F.lit("\n" + "-" * 20 + "\n"), "question_text", F.lit("\n\n"),
        options, *reason, F.lit("\n"),
    )
    key = F.concat(number(), F.lit(". "), correct_letter(), F.lit(" - "), "correct_answer", F.lit("\n   Explanation: "), "explanation")
    return _sections(bank, header, question, f"{rule}\nANSWER KEY\n{rule}", key, teacher)


def export_markdown(bank: DataFrame, teacher: bool = True, explanations: bool = True, difficulty: bool = True) -> DataFrame:
    """Markdown blocks, as in export_text(); pipes in the answer table are escaped."""
    header = F.concat(F.lit("# Assessment\n\n## Assessment Information\n\n- **Total Questions:** "), F.col("n"), F.lit(f"\n- **Version:** {'Teacher' if teacher else 'Student'}\n"))
    marked = F.col("correct_answer") if teacher else F.lit(None)
    reason = [F.lit("\n\n> **Explanation:** "), F.col("explanation")] if teacher and explanations else []
    options = _option_lines(
        lambda t, i: F.when(
            t == marked, F.concat(F.lit("- **"), _letter(i), F.lit(".** **"), t, F.lit("** ✅"))
        ).otherwise(F.concat(F.lit("- "), _letter(i), F.lit(". "), t))
    )
    question = F.concat(
        F.lit("### Question "), number(), *_badge(" `[", "]`", difficulty), F.lit("\n\n"), "question_text", F.lit("\n\n"),
        options, *reason, F.lit("\n"),
    )
    pipe = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    key = F.concat(
        F.lit("| "), number(), F.lit(" | "), correct_letter(), F.lit(". "), pipe(F.col("correct_answer")), F.lit(" | "), pipe(F.col("explanation")), F.lit(" |")
    )
    return _sections(bank, header, question, "## Answer Key\n\n| Question | Answer | Explanation |\n|----------|--------|-------------|", key, teacher)


def layout(bank: DataFrame, per_page: int = 5, seed: str = "0") -> DataFrame:
    """Sort keys for the three orders, the page of each question, and the keys to split by."""
    rank = F.when(F.col("difficulty") == "easy", 1).when(F.col("difficulty") == "medium", 2).otherwise(3)
    return bank.select(
        KEY,
        IDX,
        rank.cast("bigint").alias("difficulty_rank"),
        F.md5(F.concat_ws("|", KEY, IDX, F.lit(seed))).alias("random_key"),
        F.ceil(number() / per_page).alias("page_number"),
        F.col("difficulty").alias("split_difficulty"),
        F.col("concept").alias("split_concept"),
    )


# --- writers ----------------------------------------------------------------------------


def write_blocks(blocks: DataFrame, path: str) -> None:
    """Text files in order: ranges of (assessment, section, position), so a large assessment spans files."""
    ordered = blocks.repartitionByRange(KEY, "section", "seq").sortWithinPartitions(KEY, "section", "seq")
    ordered.select(F.col("block").alias("value")).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange(KEY, IDX).sortWithinPartitions(KEY, IDX).drop(KEY, IDX).write.mode("overwrite").option(
        "quoteAll", True
    ).option("escape", '"').option("header", True).csv(path)


def write_split(rows: DataFrame, path: str, by: str) -> None:
    rows.write.mode("overwrite").partitionBy(by).json(path)

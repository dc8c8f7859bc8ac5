"""Generated responses: text holding a JSON array of questions, parsed to normalised rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions.frames import hold
from quizmill.operators.validation import fill

ITEM = (
    "array<struct<question_text:string,concept_tested:string,correct_position:string,"
    "overall_explanation:string,options:map<string,string>>>"
)
ANY_ITEM = "struct<question_text:string,concept_tested:string,overall_explanation:string,correct_position:string,options:variant>"
ANY_OPTION = "struct<key:string,label:string,text:string,is_correct:variant,explanation:struct<misconception_name:string,why_its_wrong:string>>"
OPTION = "text string, is_correct boolean, explanation struct<misconception_name:string,why_its_wrong:string>"


def parse(responses: DataFrame) -> DataFrame:
    """One row per question in each response; text without a valid array gives no rows.

    Option values arrive as text: a plain option is its own text, a detailed one is its JSON.
    """
    body = F.regexp_extract("content", r"(?s)\[.*\]", 0)
    parsed = hold(responses, items=F.from_json(body, ITEM))
    rest = [c for c in responses.columns if c != "content"]
    return parsed.select(*rest, F.posexplode("items").alias("position", "item")).filter(
        F.col("item").isNotNull()
    ).select(*rest, F.col("position").cast("bigint").alias("position"), "item.*")


def _option(e: Column, correct: Column) -> Column:
    detail = F.from_json(e["value"], OPTION)
    detailed = F.startswith(e["value"], F.lit("{"))
    return F.struct(
        e["key"].alias("key"),
        F.trim(F.when(detailed, detail["text"]).otherwise(e["value"])).alias("text"),
        F.coalesce(F.when(detailed, detail["is_correct"]).otherwise(e["key"] == correct), F.lit(False)).alias("is_correct"),
        detail["explanation"]["misconception_name"].alias("misconception_type"),
        detail["explanation"]["why_its_wrong"].alias("explanation"),
    )


def normalize(questions: DataFrame) -> DataFrame:
    """Question rows with one answer and three distractors; reject holds the reason, null when accepted."""
    options = F.transform(
        F.coalesce(F.map_entries("options"), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: _option(e, F.col("correct_position")),
    )
    return _accepted(hold(questions, parts=options))


def parse_any(responses: DataFrame) -> DataFrame:
    """One row per item of each response's array, whatever shape its items and options have; text without a valid array
    gives no rows (nor does an array with an object that names a key twice).

    Each row has `parts`, its options as (key, text, is_correct, misconception_type, explanation), and `fault`, set where the
    item itself is unusable: no object, or options that are neither a map, a list nor text. Options may be a map of texts or
    of details; a list of either, lettered by position unless an entry names its own key or label; or one text with an option
    a line, each behind its letter. An explanation that is not an object tells nothing.
    """
    body = F.try_parse_json(F.regexp_extract("content", r"(?s)\[.*\]", 0))
    rest = [c for c in responses.columns if c != "content"]

    def told(value: Column, kind: str) -> Column:
        """The variant in the given shape, null where it has another: one reading names all fields, no schema is derived."""
        return F.try_variant_get(value, "$", kind)

    found = hold(responses.select(*rest, body.alias("body")), items=told(F.col("body"), "array<variant>")).filter(F.col("items").isNotNull())
    items = found.select(*rest, F.posexplode("items").alias("pos", "raw"))
    read = hold(items.select(*rest, F.col("pos").cast("bigint").alias("position"), "raw"), item=told(F.col("raw"), ANY_ITEM))
    options = F.col("item")["options"]
    shaped = hold(read.drop("raw"), as_map=told(options, "map<string,variant>"), as_list=told(options, "array<variant>"), correct_position=F.col("item")["correct_position"])
    other = F.col("as_map").isNull() & F.col("as_list").isNull()
    shaped = hold(shaped, as_text=F.when(other & (F.schema_of_variant(options) == "STRING"), told(options, "string")))
    letters = F.array(*[F.lit(chr(65 + i)) for i in range(26)])

    def detail(key: Column, value: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), told(value, ANY_OPTION).alias("d"))

    def part(e: Column) -> Column:
        key, value, d = e["key"], e["value"], e["d"]
        detailed = d.isNotNull()
        own = F.coalesce(d["key"], d["label"])
        named = F.coalesce(own, key)
        text = F.when(detailed, d["text"]).otherwise(told(value, "string"))
        right = F.when(d["is_correct"].isNotNull() & ~F.is_variant_null(d["is_correct"]), F.coalesce(told(d["is_correct"], "boolean"), F.lit(False)))
        return F.struct(
            named.alias("key"),
            F.trim(text).alias("text"),
            F.coalesce(right, F.when(~detailed | own.isNotNull(), named == F.col("correct_position")), F.lit(False)).alias("is_correct"),
            d["explanation"]["misconception_name"].alias("misconception_type"),
            d["explanation"]["why_its_wrong"].alias("explanation"),
        )

    lines = F.filter(F.split("as_text", r"\R"), lambda x: F.trim(x) != "")
    marked = r"^\s*\(?([A-Za-z])[).:]\s*(.*)$"

    def line(x: Column, i: Column) -> Column:
        lettered = F.regexp_like(x, F.lit(marked))
        key = F.when(lettered, F.upper(F.regexp_extract(x, marked, 1))).otherwise(F.get(letters, i))
        text = F.trim(F.when(lettered, F.regexp_extract(x, marked, 2)).otherwise(x))
        none = F.lit(None).cast("string")
        return F.struct(key.alias("key"), text.alias("text"), F.coalesce(key == F.col("correct_position"), F.lit(False)).alias("is_correct"), none.alias("misconception_type"), none.alias("explanation"))

    parts = F.coalesce(
        F.transform(F.transform(F.map_entries("as_map"), lambda e: detail(e["key"], e["value"])), part),
        F.transform(F.transform("as_list", lambda v, i: detail(F.get(letters, i), v)), part),
        F.transform(lines, line),
        F.array().cast("array<struct<key:string,text:string,is_correct:boolean,misconception_type:string,explanation:string>>"),
    )
    readable = F.col("as_map").isNotNull() | F.col("as_list").isNotNull() | F.col("as_text").isNotNull()
    fault = F.when(F.col("item").isNull(), "not an object").when(options.isNotNull() & ~F.is_variant_null(options) & ~readable, "unreadable options")
    fields = ("question_text", "concept_tested", "overall_explanation")
    return shaped.select(*rest, "position", *[F.col("item")[f].alias(f) for f in fields], "correct_position", parts.alias("parts"), fault.alias("fault"))


def normalize_any(items: DataFrame) -> DataFrame:
    """normalize() for parse_any(): the rejects of items that are no questions come first."""
    graded = _accepted(items)
    return graded.withColumn("reject", F.coalesce("fault", "reject")).drop("fault")


def _accepted(rows: DataFrame) -> DataFrame:
    """Question rows from their options in `parts`."""
    d = lx.RESPONSE_DEFAULTS
    right = F.filter("parts", lambda o: o["is_correct"])
    wrong = F.filter("parts", lambda o: ~o["is_correct"])
    text = F.trim(F.coalesce("question_text", F.lit("")))
    concept = F.coalesce("concept_tested", F.lit(d["concept"]))
    reject = (
        F.when(text == "", "missing question text")
        .when(F.size("parts") != 4, "expected 4 options")
        .when(F.exists("parts", lambda o: F.coalesce(o["text"], F.lit("")) == ""), "empty option text")
        .when(F.size(right) > 1, "multiple correct answers")
        .when(F.size(right) == 0, "no correct answer")
        .when(F.size(wrong) != 3, "expected 3 distractors")
    )
    distractors = F.transform(
        wrong,
        lambda o: F.struct(
            o["text"].alias("text"),
            F.coalesce(o["misconception_type"], F.lit(d["misconception"])).alias("misconception_type"),
            F.coalesce(o["explanation"], fill(d["why_wrong"], perspective=F.col("perspective"))).alias("explanation"),
        ),
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("parts", "options", "question_text", "overall_explanation", "concept_tested", "correct_position")],
        text.alias("question_text"),
        concept.alias("concept"),
        F.get(right, F.lit(0))["text"].alias("correct_answer"),
        distractors.alias("distractors"),
        F.coalesce(
            "overall_explanation", fill(d["explanation"], perspective=F.col("perspective"), concept=concept)
        ).alias("explanation"),
        reject.alias("reject"),
    )

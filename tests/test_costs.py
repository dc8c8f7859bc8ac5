"""What a plan must not do again: steps whose cost was found too high on large tables."""

import io
import re
from contextlib import redirect_stdout

import pyarrow as pa
from pyspark.sql import functions as F

from quizmill.functions import linear
from quizmill.functions import text as tx
from quizmill.operators import chunking, dedupe, validation
from quizmill.plans import registry
from quizmill.plans.retrieve import indexed

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    text = out.getvalue()
    return text[text.index("== Optimized Logical Plan"):]


def test_variant_shapes_are_read_without_deriving_schemas(spark):
    """Only text among the options is told by its schema; arrays, items and details are read in their shape."""
    plan = plan_of(registry.queries()["llm_response_shapes"](spark, SF))
    logical = plan[: plan.index("== Physical Plan")]
    assert logical.count("schemaOfVariant(") <= 1


def test_long_patterns_run_in_linear_time(spark):
    """Cleaning, units, element counts and chunk flags leave no long pattern to the JVM and ask each one once a row."""
    for name in ("chunk_record", "chunk_size_profile", "semantic_units", "doc_summary", "stem_chunks", "doc_complexity"):
        plan = plan_of(registry.queries()[name](spark, SF))
        logical = plan[: plan.index("== Physical Plan")]
        assert "Diagram" not in logical and "begin" not in logical, name
        assert "regexp_count(" not in logical, name
    plan = plan_of(registry.queries()["chunk_record"](spark, SF))
    # one step cleans, one cuts paragraphs, one tests and counts
    assert plan[plan.index("== Physical Plan"):].count("ArrowEvalPython") <= 3


def test_paragraphs_are_cut_and_counted(spark):
    rows = spark.createDataFrame([(1, "A b. C d e! F\n \n x\n\n"), (2, ""), (3, None), (4, "\n\none two three. four"), (5, "a b c")], "i int, t string")
    got = {r.i: [tuple(p) for p in r.p] for r in rows.select("i", linear.parts(F.col("t"), 3).alias("p")).collect()}
    assert got == {
        1: [(0, "A b.", 2), (0, "C d e!", 3), (0, "F", 1), (1, "x", 1)], 2: [], 3: [],
        4: [(0, "one two three.", 3), (0, "four", 1)], 5: [(0, "a b c", 3)],
    }


def test_cleaning_keeps_spans_and_mends_gaps(spark):
    texts = ["a  b$x  y$cD  1.e", "no span  atAll", None, "", " \n lead `c  d` 2.x \n", "$a$$b  c$", "x =  y"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.c for r in rows.select("i", tx.clean_text(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["a b$x  y$c D 1. e", "no span at All", None, "", "lead `c  d` 2. x", "$a$$b  c$", "x =  y"]


def bank_passes(spark, name: str) -> int:
    """How often the plan cuts the documents into questions."""
    plan = plan_of(registry.queries()[name](spark, SF))
    return plan[plan.index("== Physical Plan"):].count("documents.parquet")


def test_the_report_examines_questions_once(spark):
    """Each question is examined once and written; scores, details and copies read what was written."""
    assert bank_passes(spark, "quality_report") == 0
    assert bank_passes(spark, "validation_score") == 0


def test_placeholder_signs_stand_wherever_patterns_match(spark):
    texts = ["Option  A", "CHOICE b", "[Fill]", "{X}", "an XXXX", "wait....", "PlaceHolder", "INSERT \t Text", "Answer  HERE", "plain words only"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = rows.select("i", F.explode(validation.text_issues(F.col("t"), "option_A")).alias("x")).filter("x.issue_type = 'placeholder'")
    assert sorted(r.i for r in found.collect()) == list(range(9))


def test_words_are_counted_without_a_list_of_them(spark):
    texts = ["", " ", "\t\n", "a", " a", "a ", "a  b\nc\x0bd", "é ∑x \U0001F600 $1 \\", "x" * 5000, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.word_count(F.col("t")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 4, 5, 1, None]
    assert "regexp_extract_all" not in plan_of(rows)


def test_terms_are_weighed_where_their_assessment_lies(spark):
    assert bank_passes(spark, "concept_coverage") == 1
    plan = plan_of(registry.queries()["concept_coverage"](spark, SF))
    assert plan[plan.index("== Physical Plan"):].count("Exchange ") == 1


def test_the_gate_is_passed_once(spark):
    """Concepts are told used or free by one pass."""
    assert bank_passes(spark, "used_concepts") == 1


def test_concepts_of_mixed_and_unknown_questions(spark):
    rows = [(1, "A", True), (1, "a", False), (1, "b", False), (1, "b", None), (1, "c", None), (1, "", True), (1, None, True), (2, "a", False)]
    got = dedupe.concept_states(spark.createDataFrame(rows, "assessment_id long, concept string, passes boolean")).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "used"), (1, "b", "free"), (2, "a", "free")]


def test_accepted_questions_are_written_before_they_are_ranked_and_compared(spark):
    # the requests are read from the documents, twice
    assert bank_passes(spark, "guaranteed_set") == 2


def test_scores_are_made_once_for_lists_and_advice(spark):
    """Scored questions are written before a sort, or several counts, read them again."""
    assert bank_passes(spark, "low_quality_list") == 0
    assert bank_passes(spark, "assessment_recommendations") == 0


def test_syllables_are_vowel_groups_and_one_for_words_without(spark):
    texts = ["", "Why", "rhythm bcd 123", "  Queue\tAEIOU x-ray ", "éa ooze", "zzz " * 40, "b" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.syllables(F.col("t")).alias("n"))
    want = [sum(max(1, len(re.findall("[aeiouy]+", w))) for w in t.lower().split()) for t in texts]
    assert [r.n for r in rows.orderBy("i").collect()] == want
    assert "regexp_extract_all" not in plan_of(rows)


def test_the_index_holds_vectors_once_and_no_texts(spark):
    stored = spark.read.parquet(f"{indexed(spark, SF)}/rows")
    assert sorted(stored.columns) == ["cell", "chunk_id", "collection", "doc_id", "embedding", "length"]


def test_pages_come_back_cut_not_once_per_pattern(spark):
    """One copy of a page goes to the worker and its pieces come back; no column holds a marked copy of it."""
    plan = plan_of(registry.queries()["stem_chunks"](spark, SF))
    assert "marks(" not in plan and "ArrowEvalPython" not in plan and plan.count("MapInArrow") >= 1


def test_a_worker_cuts_a_few_megabytes_at_a_time():
    page = "$E = mc^2$ where α ≤ β\n" + "plain words of a text " * 100
    n = 32 * linear.STEP // len(page.encode())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1] * n), "page_num": pa.array(range(n)), "text": pa.array([page] * n)})
    pool, before = pa.proxy_memory_pool(pa.default_memory_pool()), pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        rows = sum(made.num_rows for made in chunking._cut_at_elements(iter([batch])))
    finally:
        pa.set_memory_pool(before)
    assert rows == 4 * n and 0 < pool.max_memory() < 8 * linear.STEP


def test_pages_are_cut_at_their_elements(spark):
    texts = {
        1: "a\x01b $x$ c\x02d",  # signs that marks are made of
        2: "\x0b a $x$ \n b \x0b",
        3: "$a$ |x|y| z",
        4: "b $a$ |x|y|",
        5: "Figure 1: see $x$\n`y`é$z$",
        6: " \n",
        7: None,
        8: "",
    }
    rows = spark.createDataFrame([(i, 1, t) for i, t in texts.items()], "doc_id int, page_num long, text string")
    got: dict = {}
    for r in chunking.stem_chunks(rows).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.content_type))
        assert (r.chunk_index, r.id) == (len(got[r.doc_id]) - 1, f"chunk_1_{r.chunk_index}")
    assert got == {
        1: [("a\x01b", "text"), ("$x$", "equation"), ("c\x02d", "text")],
        2: [("\x0b a", "text"), ("$x$", "equation"), ("b \x0b", "text")],
        3: [("$a$", "equation"), ("|x|y| z", "text")],
        4: [("b $a$ |x|y|", "table")],
        5: [("Figure 1: see $x$", "figure"), ("`y`", "code"), ("é", "text"), ("$z$", "equation")],
    }

"""Finders of the user's own, frequent values, question documents."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.operators import chunking, finders, frequent
from quizmill.sources import bridge, exports

SF = "/root/testdata/sf0.001"


def equations(text):
    for name, pattern in lx.NAMED_EQUATIONS:
        for m in re.finditer(pattern, text, re.DOTALL | re.IGNORECASE):
            yield name, m.group(1), m.group(0), m.start()


def test_a_finder_finds_what_the_library_finds(spark):
    pages = bridge.doc_pages(spark, SF)
    columns = ["doc_id", "page_num", "kind", "start_pos", "end_pos", "full_match", "content"]
    own = collections.Counter(map(tuple, finders.elements(pages, equations).select(columns).collect()))
    assert own and own == collections.Counter(map(tuple, chunking.detect_equations(pages).select(columns).collect()))


def test_finders_take_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100000), (4, "é😀a")], "id long, text string")
    got = finders.elements(rows, lambda t: [("letter", None, c, i) for i, c in enumerate(t[:3])])
    assert got.columns == ["id", "kind", "content", "full_match", "start_pos", "end_pos"]
    assert [(r.id, r.full_match) for r in got.orderBy("id", "start_pos").collect()] == [(3, "x")] * 3 + [(4, "é"), (4, "😀"), (4, "a")]
    assert finders.elements(rows.filter("false"), equations).count() == 0


def test_a_finder_that_fails_says_so(spark):
    def broken(text):
        raise ValueError("no such element")

    with pytest.raises(Exception, match="no such element"):
        finders.elements(spark.createDataFrame([(1, "a")], "id long, text string"), broken).collect()


def values(spark, n):
    """Group 1: one value in many, then a long tail; group 2: no value stands out; group 3: few values; 4: nulls only."""
    i = F.col("id")
    tail = spark.range(n).select(F.lit(1).alias("g"), F.when(i % 3 == 0, "a").when(i % 7 == 0, "b").when(i % 11 == 0, "c").otherwise(i.cast("string")).alias("v"))
    flat = spark.range(n).select(F.lit(2).alias("g"), (i % (n // 3)).cast("string").alias("v"))
    few = spark.range(100).select(F.lit(3).alias("g"), (i % 2).cast("string").alias("v"))
    return tail.union(flat).union(few).union(spark.range(5).select(F.lit(4).alias("g"), F.lit(None).cast("string").alias("v")))


@pytest.mark.parametrize("by", [["g"], []])
def test_frequent_values_are_exact(spark, by):
    rows = values(spark, 6000)
    exact = collections.defaultdict(collections.Counter)
    for r in rows.filter("v IS NOT NULL").collect():
        exact[r.g if by else None][r.v] += 1
    want = [(*([g] if by else []), v, n, k + 1) for g, c in exact.items() for k, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3])]
    got = frequent.top_values(rows, "v", by, 3, tracked=64)
    assert got.columns == [*by, "v", "uses", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert frequent.top_values(rows.filter("false"), "v", by, 3).count() == 0


def test_sketches_miss_no_value_beyond_their_error(spark):
    rows, tracked = values(spark, 20000), 64
    named = collections.defaultdict(set)
    for r in frequent.candidates(rows, "v", ["g"], tracked).collect():
        named[r.g].add(r.v)
    for r in rows.filter("v IS NOT NULL").groupBy("g", "v").count().collect():
        total = {1: 20000, 2: 20000, 3: 100}[r.g]
        assert r.v in named[r.g] or r["count"] <= total * frequent.ERROR / tracked


def test_documents_read_back_equal_the_bank(spark, tmp_path):
    path = str(tmp_path / "quiz")
    bank = bridge.question_bank(spark, SF).filter("assessment_id < 20")
    exports.write_moodle(bank, path)
    assert len(list((tmp_path / "quiz").glob("assessment_id=*"))) == bank.select("assessment_id").distinct().count()
    back = exports.read_moodle(spark, path)
    want = collections.Counter((r.assessment_id, r.question_index, r.question_text, r.correct_answer, tuple(r.texts)) for r in exports.with_options(bank).collect())
    assert collections.Counter((r.assessment_id, r.question_index, r.question_text, r.correct_answer, tuple(r.texts)) for r in back.collect()) == want
    assert not any(r.broken for r in back.collect())


def test_a_broken_element_is_kept_apart(spark, tmp_path):
    folder = tmp_path / "quiz" / "assessment_id=7"
    folder.mkdir(parents=True)
    good = '<question type="multichoice"><name><text>Question 3</text></name><questiontext format="html"><text>&lt;p&gt;Why?&lt;/p&gt;</text></questiontext><answer fraction="100" format="html"><text>&lt;p&gt;So&lt;/p&gt;</text></answer></question>'
    (folder / "a.xml").write_text(f"<quiz>{good}<question><name><text>Question 4</name></question>{good.replace('3', '5')}</quiz>")
    rows = exports.read_moodle(spark, str(tmp_path / "quiz")).collect()
    assert any(r.broken and "Question 4" in r.broken and r.question_text is None for r in rows)
    assert (7, 2, "Why?", "So", ["So"]) in [(r.assessment_id, r.question_index, r.question_text, r.correct_answer, r.texts) for r in rows if not r.broken]


def test_a_whole_bank_takes_few_documents(spark, tmp_path):
    path = tmp_path / "quiz"
    bank = bridge.question_bank(spark, SF).coalesce(2)
    exports.write_bank(bank, str(path))
    assert len(list(path.rglob("*.xml"))) <= 2
    want = collections.Counter((r.assessment_id, r.question_index, r.question_text) for r in bank.collect())
    assert collections.Counter((r.assessment_id, r.question_index, r.question_text) for r in exports.read_moodle(spark, str(path)).collect()) == want
    (path / "a.xml").write_text("<quiz><question><idnumber>-7-3</idnumber><name><text>Question 4</name></question></quiz>")
    assert [r.assessment_id for r in exports.read_moodle(spark, str(path)).filter("broken IS NOT NULL").collect()] == [-7]

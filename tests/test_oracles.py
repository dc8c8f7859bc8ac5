"""A spread of registered queries against their SQL; oracle_check.py runs them all."""

import pytest
from oracle_check import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SPREAD = [
    "assessment_overview", "recommendations", "concept_coverage", "content_diversity", "quality_report", "near_duplicates",
    "session_upsert", "step_durations", "progress_log", "rate_window", "clean_text", "chunk_record", "link_chunks",
    "vector_topk", "context_budget", "distractor_select", "fallback_fill", "llm_question_normalize", "export_json", "progress_stream",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

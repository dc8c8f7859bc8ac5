"""Hand-derived cases for the rules."""

import pytest
from pyspark.sql import functions as F

from quizmill.functions import rewrites as rw
from quizmill.functions import rules
from quizmill.functions import text as tx
from quizmill.operators import chunking, oplog, retrieval, stats, validation

DISTRACTOR = "array<struct<text:string,misconception_type:string,explanation:string,closeness_score:bigint>>"


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


def bank(spark, rows):
    """rows: (assessment, index, question, answer, [(text, type, closeness)], difficulty, position)."""
    data = [
        (a, i, q, ans, [(t, k, "why", c) for t, k, c in ds], "because", diff, pos, "multiple_choice", "x", "definitional")
        for a, i, q, ans, ds, diff, pos in rows
    ]
    return spark.createDataFrame(
        data,
        "assessment_id bigint, question_index bigint, question_text string, correct_answer string, distractors "
        + DISTRACTOR
        + ", explanation string, difficulty string, correct_position string, question_type string, concept string, perspective string",
    )


GOOD = [("one two three", "a", 7), ("four five six", "b", 6), ("seven eight nine", "c", 5)]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("camelCase 3apples.End", "camel Case 3 apples. End"),
        ("Value 3.14 here", "Value 3. 14 here"),
        ("  keep $aB  c$  andX  ", "keep $aB  c$ and X"),
        ("a•b", "a• b"),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, tx.clean_text) == clean


@pytest.mark.parametrize(
    "text, kind, score",
    [
        ("Definition: a hash is one way.", "definition", 0.7),
        ("Peer-to-peer example", "equation", 0.8),
        ("Introduction", "normal", 0.6),
    ],
)
def test_chunk_type_and_score(spark, text, kind, score):
    assert one(spark, text, tx.chunk_type) == kind
    assert one(spark, text, tx.importance_score) == pytest.approx(score)


@pytest.mark.parametrize("n, sizes", [(400, [400]), (401, [400, 41]), (760, [400, 400]), (1000, [400, 400, 280])])
def test_simple_chunks(spark, n, sizes):
    df = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "doc_id bigint, text string")
    got = [len(r.text.split()) for r in chunking.simple_chunks(df).orderBy("chunk_no").collect()]
    assert got == sizes


def test_pack_units(spark):
    words = [f"w{i}" for i in range(27)]
    units, at = [], 0
    for n in (6, 4, 5, 12):
        units.append(" ".join(words[at : at + n]))
        at += n
    df = spark.createDataFrame([(1, 1, "", units)], "doc_id bigint, page_num bigint, text string, units array<string>")
    chunks = chunking.pack_units(df, size=10, overlap=3).first()["chunks"]
    assert [c["text"].split() for c in chunks] == [words[0:10], words[7:15], words[12:27]]


def test_long_sentence_is_one_unit(spark):
    text = " ".join(["word"] * 250) + "."
    df = spark.createDataFrame([(1, 1, text)], "doc_id bigint, page_num bigint, text string")
    assert [len(u.split()) for u in chunking.semantic_units(df).first()["units"]] == [250]


def test_distractor_quality(spark):
    b = bank(spark, [(1, 0, "What is X?", "ans wer", GOOD, "easy", "A")])
    row = b.select(*[c.alias(n) for n, c in rules.distractor_quality().items()], rules.distractor_issues().alias("i")).first()
    assert (row.average_closeness, row.strong_count, row.weak_count, row.distractor_diversity) == (6, 2, 0, 1)
    assert row.distractor_score == pytest.approx(0.66)
    assert row.i == []


@pytest.mark.parametrize(
    "q, level, score", [("Compare and explain consensus", "understand", 0.333333), ("What is a cause?", "apply", 0.5)]
)
def test_bloom(spark, q, level, score):
    b = bank(spark, [(1, 0, q, "a", GOOD, "easy", "A")]).withColumn("l", rules.bloom_level())
    row = b.select("l", rules.bloom_score(F.col("l")).alias("s")).first()
    assert (row.l, row.s) == (level, pytest.approx(score))


def test_clarity_without_options(spark):
    b = bank(spark, [(1, 0, "What is X?", "a", GOOD, "easy", "A")]).withColumn("i", rules.clarity_issues(False))
    row = b.select("i", rules.clarity_score(F.col("i")).alias("s")).first()
    assert (len(row.i), row.s) == (1, pytest.approx(0.8))


def test_grades(spark):
    df = spark.createDataFrame([(x,) for x in (0.9, 0.85, 0.849, 0.5, 0.49)], "s double")
    assert [r[0] for r in df.select(rules.grade(F.col("s"))).collect()] == ["A+", "A", "A-", "C-", "D"]


def test_gate_allows_one_failure(spark):
    b = bank(spark, [(1, 0, "Is this another good question?", "right answer here", GOOD, "easy", "A")])
    row = b.select(rules.six_checks()["no_negative"].alias("n"), rules.six_check_pass().alias("p")).first()
    assert (row.n, row.p) == (False, True)


def test_difficulty_balance(spark):
    rows = [(1, i, "q", "a", GOOD, d, "A") for i, d in enumerate(["easy"] * 3 + ["medium"] * 5 + ["hard"] * 2)]
    rows += [(2, i, "q", "a", GOOD, "medium", "A") for i in range(4)]
    got = {r.assessment_id: (r.balance_score, r.well_balanced) for r in stats.difficulty_balance(bank(spark, rows)).collect()}
    assert got == {1: (1.0, True), 2: (0.5, False)}


def test_assessment_score(spark):
    df = spark.createDataFrame([(1, 0.6, "apply"), (1, 0.8, "create")], "assessment_id bigint, overall_score double, bloom_level string")
    assert stats.assessment_score(df).first()["quality_score"] == pytest.approx(0.729)


def test_validation_score(spark):
    four = [("a second good option", "a", 7), ("a third good option", "b", 6), ("a fourth good option", "c", 5)]
    rows = [
        (1, 0, "What does the first long question ask?", "a first good option", four, "easy", "A"),
        (1, 1, "What does the second long question ask?", "a first good option", four, "hard", "B"),
    ]
    row = validation.validation_scores(bank(spark, rows)).first()
    assert (row.critical_issues, row.major_issues, row.minor_issues) == (0, 0, 0)
    assert (row.bias_detected, row.max_share, row.variety_score, row.overall_score) == (True, 0.5, 2, 100)


REWRITES = {
    "wallet_vs_node": ("A wallet stores the private key", "A wallet stores the blockchain data"),
    "mining_vs_validating": ("Miners validate transactions", "Miners generate new cryptocurrency"),
    "public_vs_private_key": ("A private key signs and the public key verifies", "A public key signs and the private key verifies"),
    "hash_vs_encryption": ("A hash is one-way", "A hash is two-way"),
    "blockchain_as_database": ("A blockchain is distributed and immutable", "A blockchain is centralized and updateable"),
    "decentralization_equals_speed": ("Decentralized systems are slower over time", "Decentralized systems are faster over time"),
    "consensus_is_voting": ("A consensus mechanism is used", "A voting system is used"),
    "immutable_means_unhackable": ("Immutable records cannot be changed", "Immutable records cannot be changed, making it completely secure from all attacks"),
    "pow_vs_pos": ("It uses proof of work", "It uses proof of stake"),
    "gas_fees_purpose": ("Gas measures execution cost", "Gas measures network fee"),
    "smart_contract_capabilities": ("A smart contract needs an oracle", "A smart contract needs an built-in internet access"),
}


@pytest.mark.parametrize("name", REWRITES)
def test_rewrites(spark, name):
    answer, wrong = REWRITES[name]
    assert one(spark, answer, rw.REWRITES[name]) == wrong
    assert one(spark, "Nothing of note", rw.REWRITES[name]) is None


def test_merkle_rewrite(spark):
    from quizmill.lexicon import MERKLE_PURPOSES

    got = one(spark, "A Merkle tree enables verification", rw.merkle_tree_purpose)
    assert got in ["A Merkle tree enables " + p for p in MERKLE_PURPOSES]


def test_query_expand(spark):
    assert one(spark, "Explain mining", retrieval.query_expand) == "Explain mining proof of work computation validation"


def test_similarity_boost(spark):
    df = spark.createDataFrame([(0.2, None)], "distance double, importance_score double")
    row = retrieval.boost(df).first()
    assert (row.similarity_score, row.final_score) == (pytest.approx(0.8), pytest.approx(0.71))


def test_mmr(spark):
    rows = [("q", 1, "c1", "a b c", 0.9, 0.9), ("q", 1, "c2", "a b d", 0.8, 0.8), ("q", 1, "c3", "x y z", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "query_id string, collection bigint, chunk_id string, text string, similarity_score double, final_score double")
    got = retrieval.diversify(df, 2, 0.3).orderBy("pick").collect()
    assert [r.chunk_id for r in got] == ["c1", "c3"]


@pytest.mark.parametrize("limit, lengths, size", [(200, [80, 90, 50], 185), (400, [80, 90, 300], 353)])
def test_context_budget(spark, limit, lengths, size):
    rows = [("q", f"c{i}", 1, i, "A", "x" * n) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "query_id string, chunk_id string, page_num bigint, chunk_index bigint, section string, text string")
    assert len(retrieval.build_context(df, limit).first()["context"]) == size


def test_rate_window(spark):
    rows = [(i, "completions", float(i)) for i in range(20)] + [(20, "completions", 30.0), (21, "x", 0.0), (22, "x", 60.0)]
    df = spark.createDataFrame(rows, "event_id bigint, endpoint string, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r for r in oplog.rate_window(df).collect()}
    assert (got[20].calls_minute, got[20].at_limit, got[20].wait_seconds) == (20, True, 49.0)
    assert got[22].calls_minute == 0


def test_estimates(spark):
    mb = 1024 * 1024
    df = spark.createDataFrame([(10, mb), (1, mb // 10), (500, mb)], "p bigint, b bigint")
    assert [r[0] for r in df.select(oplog.processing_estimate(F.col("p"), F.col("b"))).collect()] == [24, 10, 300]
    eta = spark.range(1).select(oplog.completion_eta(F.lit("completions"), F.lit(10))).first()[0]
    assert eta == 30


def test_cache_stats(spark):
    df = spark.createDataFrame([("q", "hit"), ("q", "miss"), ("q", "expired")], "cache_type string, operation string")
    row = oplog.cache_stats(df).first()
    assert (row.hits, row.misses, row.evictions, row.hit_rate_percent) == (1, 1, 1, 50.0)


def test_request_limits(spark):
    df = spark.createDataFrame(
        [(25, 10, 10, 5, 1, 0, 5, 0.5, 500, 50, 10)],
        "num_questions int, easy_quota int, medium_quota int, hard_quota int, page_num int, start_char int, end_char int, progress double, chunk_size int, chunk_overlap int, max_file_mb int",
    )
    row = validation.constrain(df, validation.request_constraints()).first()
    assert (row.errors, row.valid) == (["num_questions_1_20"], False)

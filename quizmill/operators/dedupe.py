"""Duplicate questions: exact copies, near copies, and order-dependent admission."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.functions import text as tx
from quizmill.session import ensure_checkpoint_dir
from quizmill.sources.stores import written
from quizmill.streaming.progress import scratch

KEY = "assessment_id"
IDX = "question_index"
#: Resemblances of an assessment that one task settles; with more it takes rounds.
FEW_EDGES = 200_000


def text_key(text: str = "question_text") -> Column:
    return F.sha2(F.trim(F.lower(text)), 256)


def exact_duplicates(bank: DataFrame, text: str = "question_text") -> DataFrame:
    """Later rows whose trimmed lower-case text already occurred, with the first row's index."""
    return later_copies(bank.select(KEY, IDX, text_key(text).alias("text_key")))


def later_copies(keyed: DataFrame) -> DataFrame:
    """exact_duplicates() of (assessment_id, question_index, text_key).

    Texts are grouped first (map-side combined), and only groups with copies are joined back, so a
    group holding most of the rows is one build row and a split probe side.
    """
    firsts = (
        keyed.groupBy(KEY, "text_key")
        .agg(F.min(IDX).alias("first_index"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    return keyed.join(firsts, [KEY, "text_key"]).filter(F.col(IDX) > F.col("first_index")).drop("text_key")


def token_set(text: Column) -> Column:
    """Distinct words, longest first. Any fixed order keeps the prefix filter exact; long words are
    rare words, and this order needs no count over the corpus."""
    words = F.array_distinct(F.filter(F.split(tx.normalize_text(text), " "), lambda w: w != ""))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(ranked, lambda s: s["w"])


def distinct_sets(bank: DataFrame, text: str = "question_text") -> DataFrame:
    """(assessment, question, tokens, rep_index): rep_index is the first question with the same words. Word sets are made
    once and written, as whatever compares them reads them several times."""
    spark = bank.sparkSession
    sets = bank.select(KEY, IDX, token_set(F.col(text)).alias("tokens")).withColumn(
        "set_key", F.sha2(F.array_join("tokens", " "), 256)
    )
    sets = written(sets, scratch(spark))
    reps = sets.groupBy(KEY, "set_key").agg(F.min(IDX).alias("rep_index"))
    return written(sets.join(reps, [KEY, "set_key"]).drop("set_key"), scratch(spark))


def similar_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """All pairs of different word sets with Jaccard above the threshold, inside an assessment.

    Prefix filter: two sets that similar share a word among their first size - ceil(t*size) + 1 words. Rows of word, index,
    size and place meet on those words; sizes must be within the threshold, and what can still be shared from the place on
    must be enough. Word sets are fetched for the pairs that are left.
    """
    n = F.size("tokens")
    length = (n - F.ceil(n * threshold - 1e-9) + 1).cast("int")
    index = reps.filter(n > 0).select(KEY, IDX, n.alias("n"), F.posexplode(F.slice("tokens", 1, length)).alias("place", "token"))
    a, b = (index.select(KEY, "token", *[F.col(c).alias(f"{c}_{side}") for c in (IDX, "n", "place")]) for side in "ab")
    enough = (F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9
    met = (
        a.join(b, [KEY, "token"])
        .filter(F.col(f"{IDX}_a") < F.col(f"{IDX}_b"))
        .filter((F.col("n_a") >= F.col("n_b") * threshold - 1e-9) & (F.col("n_b") >= F.col("n_a") * threshold - 1e-9))
        .filter(F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= enough)
        .select(KEY, F.col(f"{IDX}_b").alias(IDX), F.col(f"{IDX}_a").alias("near_index"))
        .distinct()
    )
    near = reps.select(KEY, F.col(IDX).alias("near_index"), F.col("tokens").alias("near_tokens"))
    shared = F.size(F.array_intersect("tokens", "near_tokens"))
    similarity = shared / (F.size("tokens") + F.size("near_tokens") - shared)
    both = met.join(near, [KEY, "near_index"]).join(reps.select(KEY, IDX, "tokens"), [KEY, IDX])
    return both.select(KEY, IDX, "near_index", similarity.alias("similarity")).filter(F.col("similarity") > threshold)


def near_duplicates(bank: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Every question's representative (rep_index: the first with the same words) and the representatives' earlier
    resemblances.

    Questions with the same words are one star: every copy points at the first, and only the first is compared with other
    word sets, so a group of copies adds one row per copy, not per pair. Nothing is lost: a question resembles every other
    one with its rep_index, and all copies of whatever its representative resembles.
    """
    sets = distinct_sets(bank)
    copies = sets.filter(F.col(IDX) > F.col("rep_index")).select(
        KEY, IDX, F.col("rep_index").alias("near_index"), F.lit(1.0).alias("similarity"), "rep_index"
    )
    reps = sets.filter(F.col(IDX) == F.col("rep_index")).select(KEY, IDX, "tokens")
    return copies.unionByName(similar_pairs(reps, threshold).withColumn("rep_index", F.col(IDX)))


def _admitted(edges: pd.DataFrame) -> pd.DataFrame:
    """One assessment's questions with a resembling one, in order: those that resemble none accepted before them."""
    earlier = edges.groupby(IDX)["near_index"].apply(list).to_dict()
    accepted: set[int] = set()
    for i in sorted({*edges[IDX], *edges["near_index"]}):
        if accepted.isdisjoint(earlier.get(i, ())):
            accepted.add(i)
    return pd.DataFrame({KEY: edges[KEY].iloc[0], IDX: sorted(accepted)})


def greedy_admit(bank: DataFrame, threshold: float = 0.8, few: int = FEW_EDGES) -> DataFrame:
    """Accept questions in order unless they resemble one already accepted.

    Rows without an edge are accepted at once and copies rejected at once. An assessment of up to `few` edges is settled in
    one pass over them. Larger ones are settled in rounds: a row with an accepted earlier neighbour is rejected, a row whose
    earlier neighbours are all rejected is accepted, and only undecided rows and their edges go into the next round.
    """
    ensure_checkpoint_dir(bank.sparkSession)
    sets = distinct_sets(bank)
    reps = sets.filter(F.col(IDX) == F.col("rep_index")).select(KEY, IDX, "tokens")
    edges = similar_pairs(reps, threshold).select(KEY, IDX, "near_index").checkpoint()
    open_rows = edges.select(KEY, IDX).unionByName(edges.select(KEY, F.col("near_index").alias(IDX))).distinct()
    free = reps.select(KEY, IDX).join(open_rows, [KEY, IDX], "left_anti")
    crowded = edges.groupBy(KEY).agg(F.count("*").alias("n")).filter(F.col("n") > few).select(KEY)
    kinds = f"{KEY} {dict(edges.dtypes)[KEY]}, {IDX} {dict(edges.dtypes)[IDX]}"
    settled = edges.join(crowded, KEY, "left_anti").groupBy(KEY).applyInPandas(_admitted, kinds)
    return free.unionByName(settled).unionByName(_in_rounds(edges.join(crowded, KEY, "left_semi")))


def _in_rounds(edges: DataFrame) -> DataFrame:
    """Accepted rows of assessments with any number of edges."""
    edges = edges.checkpoint()
    undecided = edges.select(KEY, IDX).unionByName(edges.select(KEY, F.col("near_index").alias(IDX))).distinct().checkpoint()
    out, remaining = edges.select(KEY, IDX).limit(0), edges
    while not undecided.isEmpty():
        blocked = remaining.select(KEY, IDX).distinct()
        accepted = undecided.join(blocked, [KEY, IDX], "left_anti").checkpoint()
        out = out.unionByName(accepted)
        near = accepted.withColumnRenamed(IDX, "near_index")
        rejected = remaining.join(near, [KEY, "near_index"], "left_semi").select(KEY, IDX).distinct().checkpoint()
        settled = accepted.unionByName(rejected)
        undecided = undecided.join(settled, [KEY, IDX], "left_anti").checkpoint()
        done = settled.withColumnRenamed(IDX, "near_index")
        remaining = remaining.join(rejected, [KEY, IDX], "left_anti").join(done, [KEY, "near_index"], "left_anti").checkpoint()
    return out


def concept_states(checked: DataFrame) -> DataFrame:
    """(assessment_id, concept, state) of questions with `passes`: a concept is used if one of its questions passes, free if
    none does."""
    told = checked.select(KEY, F.lower("concept").alias("concept"), "passes").filter("concept <> '' AND passes IS NOT NULL")
    used = told.groupBy(KEY, "concept").agg(F.bool_or("passes").alias("used"))
    return used.select(KEY, "concept", F.when(F.col("used"), "used").otherwise("free").alias("state"))

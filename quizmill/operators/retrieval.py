"""Embedding cache and vector retrieval for many queries at once.

A query searches one collection, so queries meet chunks by an equi-join on the collection; with
few queries Spark broadcasts them by their measured size, otherwise it shuffles with skew handling.
Top-k is row_number() <= k, which Spark prunes before the shuffle: a collection of any size
sends at most k rows per input partition and query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill import lexicon as lx
from quizmill.functions import vectors as vx
from quizmill.functions.frames import hold


def content_hash(content: Column, difficulty: Column, count: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("_", content, difficulty, count.cast("string")), 256), F.lit(16))


def query_key(query: Column, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", query, *[p.cast("string") for p in parts]))


def embed_input(payload: Column, index: Column) -> Column:
    """Text of a payload: field text, else field content, else the payload; blank gets a stand-in."""
    inner = F.coalesce(F.get_json_object(payload, "$.text"), F.get_json_object(payload, "$.content"), payload)
    text = F.when(F.startswith(payload, F.lit("{")), inner).otherwise(payload)
    return F.when(F.trim(text) == "", F.concat(F.lit("Empty text content "), index.cast("string"))).otherwise(text)


def split_by_cache(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) as distinct text hashes."""
    wanted = texts.select(F.sha2("text", 256).alias("text_hash")).distinct()
    keys = cache.select("text_hash")
    return wanted.join(keys, "text_hash", "left_semi"), wanted.join(keys, "text_hash", "left_anti")


def backfill(texts: DataFrame, cache: DataFrame, fresh: DataFrame, dim: int) -> DataFrame:
    """Every text with its cached vector, else the fresh one, else zeros."""
    keyed = texts.withColumn("text_hash", F.sha2("text", 256))
    known = cache.select("text_hash", F.col("embedding").alias("cached"))
    new = fresh.select("text_hash", F.col("embedding").alias("new"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return (
        keyed.join(known, "text_hash", "left")
        .join(new, "text_hash", "left")
        .withColumn("vector_source", F.when(F.col("cached").isNotNull(), "cache").when(F.col("new").isNotNull(), "new").otherwise("zero"))
        .withColumn("embedding", F.coalesce("cached", "new", zeros))
        .drop("cached", "new")
    )


def text_vectors(texts: DataFrame, dim: int = 256) -> DataFrame:
    """Hashed tf-idf unit vectors: one narrow pass plus one aggregate of dim counters."""
    stages = [
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"[^\p{L}\p{N}_]+"),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim),
        IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="unit"),
    ]
    model = Pipeline(stages=stages).fit(texts)
    return model.transform(texts).withColumn("embedding", vector_to_array("unit", "float32")).drop(
        "tokens", "tf", "tfidf", "unit"
    )


def query_expand(query: Column) -> Column:
    """The query followed by the synonyms of every known term in it."""
    low = F.lower(query)
    extra = [F.when(F.contains(low, F.lit(term)), F.lit(" ".join(words))) for term, words in lx.SYNONYMS.items()]
    return F.concat_ws(" ", query, *extra)


def candidates_for(top_k: int, most: int = lx.MAX_CANDIDATES) -> int:
    """Candidates fetched for a top_k that is diversified: three times as many, up to `most`, and never fewer than top_k."""
    return max(top_k, min(top_k * 3, most))


def top_chunks(queries: DataFrame, chunks: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest chunks of each query inside its collection.

    queries: query_id, collection, vector; chunks: collection, chunk_id, embedding, ...
    """
    asked, stored = queries.select("query_id", "collection", "vector"), chunks
    if metric == "cosine":  # lengths once a row, not once a pair
        asked, stored = hold(asked, asked_length=vx.norm(F.col("vector"))), hold(stored, stored_length=vx.norm(F.col("embedding")))
        apart = 1.0 - vx.dot(F.col("embedding"), F.col("vector")) / (F.col("stored_length") * F.col("asked_length"))
    else:
        apart = vx.distance(F.col("embedding"), F.col("vector"), metric)
    scored = hold(asked.join(stored, "collection"), distance=F.round(apart, 9))
    order = W.partitionBy("query_id").orderBy("distance", "chunk_id")
    return (
        scored.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .drop("vector", "embedding", "asked_length", "stored_length")
    )


def boost(found: DataFrame, with_importance: bool = True) -> DataFrame:
    """Similarity and the final score mixing it with importance."""
    similarity = 1.0 - F.col("distance")
    final = similarity * 0.7 + F.coalesce("importance_score", F.lit(0.5)) * 0.3
    return found.withColumns(
        {
            "similarity_score": F.round(similarity, 9),
            "final_score": F.round(final if with_importance else similarity, 9),
        }
    )


def best_by_final(boosted: DataFrame, top_k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("final_score"), "chunk_id")
    return boosted.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= top_k)


def _pick_diverse(rows: pd.DataFrame, top_k: int, diversity: float) -> pd.DataFrame:
    """Positions chosen one by one: relevance against mean word overlap with those chosen before."""
    rows = rows.sort_values(["final_score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
    if diversity <= 0 or len(rows) <= top_k:
        return rows.head(top_k)
    words = [t.split() for t in rows["text"]]
    sets = [set(w) for w in words]
    overlap_sum = [0.0] * len(rows)
    chosen, left = [0], list(range(1, len(rows)))
    while len(chosen) < top_k and left:
        last = chosen[-1]
        best, best_score = None, -1.0
        for i in left:
            longest = max(len(words[i]), len(words[last]))
            if longest:
                overlap_sum[i] += len(sets[i] & sets[last]) / longest
            score = diversity * rows["similarity_score"][i] - (1 - diversity) * overlap_sum[i] / len(chosen)
            if score > best_score:
                best, best_score = i, score
        if best is None:
            break
        chosen.append(best)
        left.remove(best)
    return rows.iloc[chosen]


def diversify(boosted: DataFrame, top_k: int, diversity: float = 0.3) -> DataFrame:
    """Diverse top_k per query. A group is one query's candidates: as many rows as candidates_for() names."""
    columns = ["query_id", "collection", "chunk_id", "text", "similarity_score", "final_score"]
    schema = boosted.select(*columns).schema.add("pick", T.LongType())

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        out = _pick_diverse(rows, top_k, diversity)[columns]
        return out.assign(pick=range(1, len(out) + 1))

    return boosted.select(*columns).groupBy("query_id").applyInPandas(pick, schema)


def with_neighbours(found: DataFrame, chunks: DataFrame, cut: int = 200) -> DataFrame:
    """Adds the leading characters of the previous and next chunk of the same collection."""
    out = found
    for side in ("prev", "next"):
        near = chunks.select(
            "collection",
            F.col("chunk_id").alias(f"{side}_chunk"),
            F.concat(F.substring("text", 1, cut), F.lit("...")).alias(f"{side}_text"),
        )
        out = out.join(near, ["collection", f"{side}_chunk"], "left")
    return out


READING = ["page", "position", "chunk_id"]


def reading_order(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {"page": F.coalesce("page_num", F.lit(0)), "position": F.coalesce("chunk_index", F.lit(0))}
    ).orderBy("query_id", *READING)


def context_pieces(found: DataFrame, limit: int = lx.CONTEXT_LIMIT) -> DataFrame:
    """What each chunk adds to its query's context; groups are the few chunks of one query.

    Chunks follow each other in reading order until one does not fit. That one is cut if it has no
    new section header and more than the minimum room is left; later ones add nothing.
    """
    w = W.partitionBy("query_id").orderBy("page", "position", "chunk_id")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = found.withColumns(
        {
            "page": F.coalesce("page_num", F.lit(0)),
            "position": F.coalesce("chunk_index", F.lit(0)),
        }
    )
    rows = rows.withColumns(
        {"n": F.row_number().over(w), "last": F.lead("chunk_id").over(w).isNull(), "previous": F.lag("section").over(w)}
    )
    fresh = F.col("section").isNotNull() & (F.col("section") != "") & (
        (F.col("n") == 1) | ~F.col("section").eqNullSafe(F.col("previous"))
    )
    rows = rows.withColumn(
        "header", F.when(fresh, F.concat(F.lit("\n=== "), "section", F.lit(" ===\n"))).otherwise("")
    )
    size = F.length("header") + F.length("text")
    rows = rows.withColumn("start", F.coalesce(F.sum(size + 2).over(before), F.lit(0)))
    rows = rows.withColumn("over", F.col("start") + size > limit)
    rows = rows.withColumn("over_before", F.coalesce(F.max("over").over(before), F.lit(False)))
    room = F.lit(limit) - F.col("start") - lx.CONTEXT_RESERVE
    whole = F.concat("header", "text", F.when(F.col("last"), "").otherwise("\n\n"))
    part = F.concat(F.left("text", room.cast("int")), F.lit("..."))
    piece = (
        F.when(F.col("over_before"), "")
        .when(~F.col("over"), whole)
        .when((F.col("header") == "") & (room > lx.CONTEXT_MIN_ROOM), part)
        .otherwise("")
    )
    return rows.withColumn("piece", piece)


def build_context(found: DataFrame, limit: int = lx.CONTEXT_LIMIT) -> DataFrame:
    pieces = context_pieces(found, limit)
    ordered = F.array_sort(F.collect_list(F.struct("n", "piece")))
    return pieces.groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda s: s["piece"]), "").alias("context")
    )


def retrieval_stats(found: DataFrame, kept: DataFrame) -> DataFrame:
    first = found.groupBy("query_id").agg(F.count("*").alias("initial_results"))
    after = kept.groupBy("query_id").agg(
        F.count("*").alias("total_chunks"), F.sum(F.length("text")).alias("context_length")
    )
    return first.join(after, "query_id", "left").na.fill(0, ["total_chunks", "context_length"])


def probe_queries(collections: DataFrame, probe_vectors: DataFrame, n_questions: int) -> DataFrame:
    """The fixed probes for every collection. probe_vectors: probe (0-based), vector."""
    used = min(n_questions * 2, 12) // 2
    last = F.lit(min(used, len(lx.PROBES)) - 1).cast("bigint")
    return (
        collections.select("collection", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("probe"))
        .join(probe_vectors, "probe")
        .withColumn("query_id", F.concat_ws("-", "collection", "probe"))
    )


def multi_query_union(collections: DataFrame, probe_vectors: DataFrame, chunks: DataFrame, n_questions: int, top_k: int = 5, per_probe: int = 2) -> DataFrame:
    """The first chunks that the retriever gives each probe (candidates, boosted by importance, diversified to top_k), in
    probe order, capped; a collection without any gets the fallback text."""
    queries = probe_queries(collections, probe_vectors, n_questions)
    picked = diversify(boost(top_chunks(queries, chunks, candidates_for(top_k))), top_k).filter(F.col("pick") <= per_probe)
    found = picked.withColumn("probe", F.substring_index("query_id", "-", -1).cast("bigint"))
    order = W.partitionBy("collection").orderBy("probe", "pick")
    kept = (
        found.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= min(n_questions * 2, 12))
        .select("collection", "n", F.get(F.array(*[F.lit(p) for p in lx.PROBES]), F.col("probe").cast("int")).alias("query"), "chunk_id", "text")
    )
    every = collections.select("collection").distinct().join(kept, "collection", "left")
    none = F.col("n").isNull()
    return every.select(
        "collection", F.coalesce("n", F.lit(1)).alias("n"), F.when(none, "fallback").otherwise(F.col("query")).alias("query"), "chunk_id",
        F.when(none, lx.PROBE_FALLBACK).otherwise(F.col("text")).alias("text"),
    )


def flatten_metadata(df: DataFrame, *columns: str) -> Column:
    """One MAP<STRING,STRING>: nested values as JSON, the rest as text."""
    kinds = dict(df.dtypes)
    entries = []
    for c in columns:
        nested = kinds[c].startswith(("array", "map", "struct"))
        entries += [F.lit(c), F.to_json(c) if nested else F.col(c).cast("string")]
    return F.create_map(*entries)


def store_rows(chunks: DataFrame) -> DataFrame:
    """Rows as stored: text falls back to content, empty text gets a stand-in. Of rows with one id the one stored last
    stays (stored_at), of those the greatest text, so the survivor doesn't depend on how rows are dealt."""
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("content"), F.lit(""))
    filled = F.when(F.trim(text) == "", F.concat(F.lit("Empty chunk content "), F.col("chunk_index"))).otherwise(text)
    rows = chunks.withColumn("text", filled).drop("content")
    rest = [c for c in rows.columns if c not in ("collection", "chunk_id")]
    last = F.max_by(F.struct(*rest), F.struct("stored_at", "text")).alias("r")
    return rows.groupBy("collection", "chunk_id").agg(last).select("collection", "chunk_id", "r.*")


def collection_catalog(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("collection").agg(F.count("*").alias("chunk_count"))



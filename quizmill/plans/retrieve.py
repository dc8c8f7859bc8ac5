"""Registered queries on hashing, the embedding cache and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.operators import retrieval as rt
from quizmill.operators import vector_index as vi
from quizmill.plans import sql as S
from quizmill.plans.common import bank, flat
from quizmill.session import load
from quizmill.sources import bridge, stores
from quizmill.streaming.progress import scratch

QUERIES: dict = {}
ORACLES: dict = {}
TOP_K = 10


def add(name, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body) if ctes else body


def docs(s, d):
    return load(s, d, "documents").select("doc_id", "text", "source")


add(
    "content_hash",
    lambda s, d: docs(s, d).select(
        "doc_id",
        F.sha2("text", 256).alias("text_hash"),
        rt.content_hash(F.col("text"), F.lit("medium"), F.col("doc_id") % 12).alias("content_hash"),
        rt.query_key(F.col("text"), F.lit(10), F.lit("0.3"), F.col("source"), F.lit("{}"), F.lit(True)).alias("query_key"),
    ),
    None,
    "SELECT doc_id, sha256(text) AS text_hash, left(sha256(text || '_medium_' || (doc_id % 12)), 16) AS content_hash, md5(text || ':10:0.3:' || source || ':{}:true') AS query_key FROM documents",
)


def payloads(s, d):
    c = load(s, d, "conversations")
    i = F.col("turn")
    payload = (
        F.when(i % 7 == 6, F.lit("  "))
        .when(i % 3 == 1, F.to_json(F.struct(F.col("text").alias("text"))))
        .when(i % 3 == 2, F.to_json(F.struct(F.col("text").alias("content"))))
        .otherwise(F.col("text"))
    )
    return c.select("conv_id", "turn", payload.alias("payload"))


add(
    "embed_input_normalize",
    lambda s, d: payloads(s, d).select("conv_id", "turn", rt.embed_input(F.col("payload"), F.col("turn")).alias("text")),
    None,
    "SELECT conv_id, turn, CASE WHEN turn % 7 = 6 THEN 'Empty text content ' || turn ELSE text END AS text FROM conversations",
)


def cache_state(s, d):
    c = load(s, d, "conversations")
    cache = c.filter(F.col("role") == "user").select(F.sha2("text", 256).alias("text_hash")).distinct()
    hits, misses = rt.split_by_cache(c, cache)
    return hits.withColumn("state", F.lit("cached")).unionByName(misses.withColumn("state", F.lit("to_embed")))


add(
    "embed_cache_misses",
    cache_state,
    None,
    "SELECT sha256(text) AS text_hash, CASE WHEN bool_or(role = 'user') THEN 'cached' ELSE 'to_embed' END AS state FROM conversations GROUP BY 1",
)


def kept_vectors(s, d):
    """Three rounds of embedding against one store: even documents, all documents, all once more. A round embeds what the
    store lacks and keeps it; texts without a vector are asked for again. Texts are hashed where they are read, once: no text
    is shuffled, and every round works on hashes."""
    texts = stores.written(stores.hashed(docs(s, d)).select("doc_id", "text_hash"), f"{scratch(s)}/texts")
    vectors = load(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(texts, "doc_id")
    made = stores.written(vectors.groupBy("text_hash").agg(F.min_by("embedding", "doc_id").alias("embedding")), f"{scratch(s)}/made")
    store = stores.VectorStore(s, scratch(s))
    rounds = []
    for n, asked in enumerate((texts.filter("doc_id % 2 = 0"), texts, texts), 1):
        before = store.known(asked).select("text_hash").withColumn("state", F.lit("cached"))
        state = before.unionByName(store.missing(asked).join(made, "text_hash", "left_semi").withColumn("state", F.lit("embedded")))
        counts = asked.select("text_hash").distinct().join(state, "text_hash", "left")
        counts = counts.groupBy(F.coalesce("state", F.lit("without")).alias("state")).agg(F.count("*").alias("texts")).withColumn("round", F.lit(n).cast("bigint"))
        rounds.append(stores.written(counts, f"{scratch(s)}/round"))
        store.add(store.missing(asked).join(made, "text_hash"))
    return rounds[0].unionByName(rounds[1]).unionByName(rounds[2])


add(
    "embed_store",
    kept_vectors,
    [
        S.VECTORS,
        "kh AS (SELECT DISTINCT sha256(text) AS h FROM chunk_vectors)",
        "dh AS (SELECT sha256(text) AS h, bool_or(doc_id % 2 = 0) AS early FROM documents GROUP BY 1)",
        "st AS (SELECT 1::BIGINT AS round, CASE WHEN h IN (SELECT h FROM kh) THEN 'embedded' ELSE 'without' END AS state FROM dh WHERE early UNION ALL "
        "SELECT 2, CASE WHEN h NOT IN (SELECT h FROM kh) THEN 'without' WHEN early THEN 'cached' ELSE 'embedded' END FROM dh UNION ALL "
        "SELECT 3, CASE WHEN h IN (SELECT h FROM kh) THEN 'cached' ELSE 'without' END FROM dh)",
    ],
    "SELECT round, state, count(*) AS texts FROM st GROUP BY 1, 2",
)


def filled(s, d):
    """Cached vectors for even documents, new ones for the rest that have any."""
    v = bridge.chunk_vectors(s, d).select("doc_id", "text", "embedding")
    keyed = v.withColumn("text_hash", F.sha2("text", 256))
    per_hash = F.min_by("embedding", "doc_id").alias("embedding")
    cache = keyed.filter(F.col("doc_id") % 2 == 0).groupBy("text_hash").agg(per_hash)
    fresh = keyed.filter(F.col("doc_id") % 2 == 1).groupBy("text_hash").agg(per_hash)
    return rt.backfill(docs(s, d).select("doc_id", "text"), cache, fresh, 64)


add(
    "embed_backfill",
    lambda s, d: filled(s, d).select(
        "doc_id", "vector_source", F.size("embedding").cast("bigint").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("vector_sum"),
    ),
    [
        S.VECTORS,
        "kv AS (SELECT doc_id, sha256(text) h, embedding FROM chunk_vectors)",
        "ca AS (SELECT h, arg_min(embedding, doc_id) e FROM kv WHERE doc_id % 2 = 0 GROUP BY 1)",
        "fr AS (SELECT h, arg_min(embedding, doc_id) e FROM kv WHERE doc_id % 2 = 1 GROUP BY 1)",
    ],
    "SELECT d.doc_id, CASE WHEN ca.e IS NOT NULL THEN 'cache' WHEN fr.e IS NOT NULL THEN 'new' ELSE 'zero' END AS vector_source, coalesce(len(ca.e), len(fr.e), 64) AS dim, "
    "round(coalesce(list_sum([x::DOUBLE FOR x IN ca.e]), list_sum([x::DOUBLE FOR x IN fr.e]), 0e0), 6) AS vector_sum "
    "FROM documents d LEFT JOIN ca ON ca.h = sha256(d.text) LEFT JOIN fr ON fr.h = sha256(d.text)",
)
# hashed features have no SQL twin; tests check unit length and repeatability
add(
    "text_vectors",
    lambda s, d: rt.text_vectors(docs(s, d).select("doc_id", "text")).select(
        "doc_id", F.size("embedding").alias("dim"),
        F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 3).alias("length"),
    ),
)
syn = ", ".join(f"CASE WHEN contains(lower(correct_answer), {S.lit(t)}) THEN {S.lit(' '.join(w))} END" for t, w in lx.SYNONYMS.items())
add(
    "query_expand",
    lambda s, d: bank(s, d).select("assessment_id", "question_index", rt.query_expand(F.col("correct_answer")).alias("expanded")),
    [S.BANK],
    f"SELECT assessment_id, question_index, concat_ws(' ', correct_answer, {syn}) AS expanded FROM bank",
)

# --- retrieval -------------------------------------------------------------------------


def queries_of(s, d):
    """One query per collection: its mean vector."""
    return bridge.centroids(s, d).select(
        F.concat(F.lit("q"), "label").alias("query_id"), F.col("label").alias("collection"), "vector"
    )


def found(s, d):
    return rt.top_chunks(queries_of(s, d), bridge.chunk_vectors(s, d), rt.candidates_for(TOP_K))


K30 = rt.candidates_for(TOP_K)


def topk_sql(where: str = "") -> str:
    return f"""
near_all AS (SELECT 'q' || q.label AS query_id, c.*, round(1 - list_cosine_similarity([x::DOUBLE FOR x IN c.embedding], q.vector), 9) AS distance
  FROM centroids q JOIN chunk_vectors c ON c.collection = q.label {where}),
topk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM near_all QUALIFY rank <= {K30}),
boosted AS (SELECT *, round(1 - distance, 9) AS similarity_score, round((1 - distance) * 0.7e0 + coalesce(importance_score, 0.5e0) * 0.3e0, 9) AS final_score FROM topk),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS final_rank FROM boosted QUALIFY final_rank <= {TOP_K})
"""


V = [S.VECTORS, topk_sql()]
add(
    "vector_topk",
    lambda s, d: flat(found(s, d).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")),
    V,
    "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM topk",
)


def indexed(s, d):
    """The stored chunks in an inverted-file index, written in two parts. What a search returns is indexed, texts stay where
    they are."""
    path, chunks = scratch(s), bridge.chunk_vectors(s, d).select("collection", "chunk_id", "doc_id", "embedding")
    later = F.col("doc_id") % 5 == 0
    vi.build(chunks.filter(~later), path)
    vi.append(chunks.filter(later), s.read.parquet(f"{path}/centres"), path)
    return path


def index_topk(s, d):
    """The nearest chunks by the index: first the nearest cells, then every cell that can hold a nearer chunk."""
    hits = vi.search(s, indexed(s, d), queries_of(s, d), K30, exact=True)
    return flat(hits.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank"))


add("vector_topk_index", index_topk, V, "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM topk")
add(
    "metadata_filter",
    lambda s, d: flat(
        rt.top_chunks(queries_of(s, d), bridge.chunk_vectors(s, d).filter(F.col("section") == "Part 1"), K30).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rank")
    ),
    [S.VECTORS, topk_sql("AND c.section = 'Part 1'")],
    "SELECT query_id, chunk_id, round(distance, 6) AS distance, rank FROM topk",
)
add(
    "similarity_boost",
    lambda s, d: rt.boost(found(s, d)).select(
        "query_id", "chunk_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("final_score", 6).alias("final_score")
    ),
    V,
    "SELECT query_id, chunk_id, round(similarity_score, 6) AS similarity_score, round(final_score, 6) AS final_score FROM boosted",
)


def mmr_sql(candidates: str, top_k: int, diversity: float = 0.3) -> str:
    """Picks one by one from (query_id, chunk_id, text, similarity_score, final_score): a list of places grows per query."""
    return f"""
mm AS (SELECT query_id, chunk_id, text, final_score, similarity_score AS sim, regexp_extract_all(text, '\\S+') AS ws, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) AS i,
  count(*) OVER (PARTITION BY query_id) AS n FROM {candidates}),
ov AS (SELECT a.query_id, a.i, b.i AS j, coalesce(len(list_intersect(list_distinct(a.ws), list_distinct(b.ws))) / nullif(greatest(len(a.ws), len(b.ws)), 0), 0) AS o FROM mm a JOIN mm b ON a.query_id = b.query_id AND a.i <> b.i),
picks AS (SELECT query_id, 1 AS step, [i] AS chosen FROM mm WHERE i = 1 AND n > {top_k} UNION ALL
  SELECT query_id, step + 1, list_append(chosen, (list(i ORDER BY score DESC, i))[1]) FROM (
    SELECT p.query_id, p.step, p.chosen, m.i, {diversity}e0 * any_value(m.sim) - (1 - {diversity}e0) * sum(ov.o) / len(p.chosen) AS score
    FROM picks p JOIN mm m ON m.query_id = p.query_id AND NOT list_contains(p.chosen, m.i) JOIN ov ON ov.query_id = m.query_id AND ov.i = m.i AND list_contains(p.chosen, ov.j)
    WHERE p.step < {top_k} GROUP BY p.query_id, p.step, p.chosen, m.i) GROUP BY query_id, step, chosen),
diverse AS (SELECT m.query_id, list_position(p.chosen, m.i)::BIGINT AS pick, m.chunk_id, m.final_score FROM picks p JOIN mm m ON m.query_id = p.query_id AND list_contains(p.chosen, m.i) WHERE p.step = {top_k}
  UNION ALL SELECT query_id, i AS pick, chunk_id, final_score FROM mm WHERE n <= {top_k})
"""


add(
    "mmr_rerank",
    lambda s, d: rt.diversify(rt.boost(found(s, d)), TOP_K, 0.3).select("query_id", "pick", "chunk_id", F.round("final_score", 6).alias("final_score")),
    V + [mmr_sql("boosted", TOP_K)],
    "SELECT query_id, pick, chunk_id, round(final_score, 6) AS final_score FROM diverse",
)


def best(s, d):
    return rt.best_by_final(rt.boost(found(s, d)), TOP_K)


add(
    "neighbor_context",
    lambda s, d: rt.with_neighbours(best(s, d), bridge.chunk_vectors(s, d)).select("query_id", "chunk_id", "prev_text", "next_text"),
    V,
    "SELECT query_id, b.chunk_id, left(p.text, 200) || '...' AS prev_text, left(n.text, 200) || '...' AS next_text FROM best b "
    "LEFT JOIN chunk_vectors p ON p.collection = b.collection AND p.chunk_id = b.prev_chunk LEFT JOIN chunk_vectors n ON n.collection = b.collection AND n.chunk_id = b.next_chunk",
)
add(
    "reading_order",
    lambda s, d: rt.reading_order(best(s, d)).select("query_id", "page", "position", "chunk_id"),
    V,
    "SELECT query_id, coalesce(page_num, 0) AS page, coalesce(chunk_index, 0) AS position, chunk_id FROM best ORDER BY 1, 2, 3, 4",
)
CONTEXT = f"""
cx1 AS (SELECT *, row_number() OVER w n, lead(chunk_id) OVER w IS NULL last, CASE WHEN section IS NOT NULL AND (row_number() OVER w = 1 OR section IS DISTINCT FROM lag(section) OVER w)
  THEN chr(10) || '=== ' || section || ' ===' || chr(10) ELSE '' END header FROM best WINDOW w AS (PARTITION BY query_id ORDER BY coalesce(page_num, 0), coalesce(chunk_index, 0), chunk_id)),
cx2 AS (SELECT *, coalesce(sum(length(header) + length(text) + 2) OVER (PARTITION BY query_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM cx1),
cx3 AS (SELECT *, min(CASE WHEN start + length(header) + length(text) > {lx.CONTEXT_LIMIT} THEN n END) OVER (PARTITION BY query_id) stop FROM cx2),
context AS (SELECT query_id, string_agg(CASE WHEN stop IS NULL OR n < stop THEN header || text || CASE WHEN last THEN '' ELSE chr(10) || chr(10) END
  WHEN n = stop AND header = '' AND {lx.CONTEXT_LIMIT} - start - 50 > 100 THEN left(text, CAST({lx.CONTEXT_LIMIT} - start - 50 AS BIGINT)) || '...' ELSE '' END, '' ORDER BY n) AS context FROM cx3 GROUP BY 1)
"""
add("context_budget", lambda s, d: rt.build_context(best(s, d)), V + [CONTEXT], "SELECT * FROM context")
add(
    "retrieval_stats",
    lambda s, d: rt.retrieval_stats(found(s, d), best(s, d)),
    V,
    "SELECT query_id, count(*) AS initial_results, count(*) FILTER (final_rank IS NOT NULL) AS total_chunks, CAST(coalesce(sum(length(text)) FILTER (final_rank IS NOT NULL), 0) AS BIGINT) AS context_length "
    "FROM (SELECT t.query_id, t.text, b.final_rank FROM topk t LEFT JOIN best b ON b.query_id = t.query_id AND b.chunk_id = t.chunk_id) GROUP BY 1",
)


def probe_union(s, d):
    c = bridge.centroids(s, d)
    collections = c.select(F.col("label").alias("collection"))
    vectors = c.select(F.col("label").alias("probe"), "vector")
    return flat(rt.multi_query_union(collections, vectors, bridge.chunk_vectors(s, d), 5).drop("text"))


add(
    "multi_query_union",
    probe_union,
    [
        S.VECTORS,
        """pr AS (SELECT c.collection, q.label AS probe, c.chunk_id, c.text, c.importance_score, round(1 - list_cosine_similarity([x::DOUBLE FOR x IN c.embedding], q.vector), 9) AS distance
  FROM centroids q JOIN chunk_vectors c ON q.label < 5),
pk AS (SELECT *, collection || '-' || probe AS query_id, round(1 - distance, 9) AS similarity_score, round((1 - distance) * 0.7e0 + coalesce(importance_score, 0.5e0) * 0.3e0, 9) AS final_score FROM pr
  QUALIFY row_number() OVER (PARTITION BY collection, probe ORDER BY distance, chunk_id) <= 15)""",
        mmr_sql("pk", 5),
    ],
    f"SELECT collection, row_number() OVER (PARTITION BY collection ORDER BY probe, pick) AS n, ({S.arr(lx.PROBES)})[probe + 1] AS query, chunk_id "
    "FROM (SELECT split_part(query_id, '-', 1)::BIGINT AS collection, split_part(query_id, '-', 2)::BIGINT AS probe, pick, chunk_id FROM diverse WHERE pick <= 2) QUALIFY n <= 10",
)

# --- stored chunks -----------------------------------------------------------------------


def incoming(s, d):
    """Chunks arriving twice, some without text; the second time every third one has changed."""
    c = bridge.chunk_vectors(s, d).select(
        "collection", "chunk_id", "chunk_index",
        F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 8 != 0, F.col("text")).alias("content"),
        F.lit("2024-01-01 00:00:00").alias("stored_at"),
        (F.col("doc_id") % 3 == 0).alias("changes"),
    )
    again = c.withColumn("text", F.when(F.col("changes"), F.concat(F.lit("revised: "), F.coalesce("text", "content", F.lit("")))).otherwise(F.col("text")))
    later = again.withColumn("stored_at", F.when(F.col("changes"), "2024-01-02 00:00:00").otherwise(F.col("stored_at")))
    return later.unionByName(c).drop("changes")


add(
    "chunk_store_append",
    lambda s, d: rt.store_rows(incoming(s, d)),
    [S.VECTORS],
    "SELECT collection, chunk_id, chunk_index, CASE WHEN doc_id % 3 = 0 THEN 'revised: ' || CASE WHEN doc_id % 8 <> 0 THEN text ELSE '' END WHEN doc_id % 8 <> 0 THEN text ELSE 'Empty chunk content ' || chunk_index END AS text, "
    "CASE WHEN doc_id % 3 = 0 THEN '2024-01-02 00:00:00' ELSE '2024-01-01 00:00:00' END AS stored_at FROM chunk_vectors",
)
add(
    "collection_catalog",
    lambda s, d: rt.collection_catalog(bridge.chunk_vectors(s, d)),
    [S.VECTORS],
    "SELECT collection, count(*) AS chunk_count FROM chunk_vectors GROUP BY 1",
)
add(
    "chunk_dedupe_ids",
    lambda s, d: incoming(s, d).dropDuplicates(["collection", "chunk_id"]).select("collection", "chunk_id"),
    [S.VECTORS],
    "SELECT DISTINCT collection, chunk_id FROM chunk_vectors",
)


def metadata(s, d):
    b = bank(s, d).withColumn("kinds", F.transform("distractors", lambda x: x["misconception_type"]))
    m = rt.flatten_metadata(b, "kinds", "difficulty", "question_index")
    return b.select("assessment_id", F.col("question_index").alias("q"), F.explode(m).alias("name", "value"))


add(
    "metadata_flatten",
    metadata,
    [S.BANK],
    """SELECT assessment_id, question_index AS q, unnest(['kinds', 'difficulty', 'question_index']) AS name,
  unnest(['[' || coalesce(array_to_string(['"' || x.misconception_type || '"' FOR x IN distractors], ','), '') || ']', difficulty, CAST(question_index AS VARCHAR)]) AS value FROM bank""",
)

"""Registered queries on misconception distractors and question-set assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rewrites as rw
from quizmill.operators import assembly, distractors, scoring
from quizmill.plans import sql as S
from quizmill.plans.common import bank, flat, scored
from quizmill.plans.ops import AS_OF, REQUESTS, requests
from quizmill.session import load

K = ["assessment_id", "question_index"]
KS = "assessment_id, question_index"
QUERIES: dict = {}
ORACLES: dict = {}
B = [S.BANK]


def add(name, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body)


# --- patterns: the SQL side states each rewrite on its own ---------------------------------


def chain(pairs) -> str:
    x = "a"
    for old, new in pairs:
        x = f"replace({x}, {S.lit(old)}, {S.lit(new)})"
    return x


def when(cond: str, value: str) -> str:
    return f"CASE WHEN {cond} THEN {value} END"


def has(*words: str) -> str:
    return " AND ".join(f"contains(l, {S.lit(w)})" for w in words)


KEYS = [("private key", "@1"), ("public key", "private key"), ("@1", "public key"), ("Private key", "@1"), ("Public key", "Private key"), ("@1", "Public key")]
POS = [("proof of work", "@1"), ("proof of stake", "proof of work"), ("@1", "proof of stake")] + lx.STAKE_SWAPS
REWRITE_SQL = {
    "wallet_vs_node": f"CASE WHEN {has('wallet')} AND ({has('key')} OR {has('private')}) THEN {chain([('private key', 'blockchain data'), ('keys', 'blockchain')])} "
    f"WHEN {has('node', 'validat')} THEN {chain([('node', 'wallet'), ('Node', 'Wallet')])} END",
    "mining_vs_validating": f"CASE WHEN ({has('mining')} OR {has('miner')}) AND {has('validat', 'transaction')} THEN {chain([('validate transactions', 'generate new cryptocurrency')])} "
    f"WHEN ({has('mining')} OR {has('miner')}) AND {has('block', 'create')} THEN {chain([('create new blocks', 'mine cryptocurrency rewards')])} END",
    "public_vs_private_key": f"nullif({chain(KEYS)}, a)",
    "hash_vs_encryption": when(has("hash"), f"nullif({chain(lx.HASH_SWAPS)}, a)"),
    "blockchain_as_database": when(has("blockchain"), f"nullif({chain(lx.DATABASE_SWAPS)}, a)"),
    "decentralization_equals_speed": f"CASE WHEN {has('decentral')} AND ({has('slow')} OR {has('time')}) THEN {chain([('slower', 'faster'), ('slow', 'fast')])} "
    f"WHEN {has('decentral', 'consensus')} THEN a || {S.lit(lx.SPEED_CLAUSE)} END",
    "consensus_is_voting": when(has("consensus"), f"nullif({chain(lx.VOTING_SWAPS)}, a)"),
    "immutable_means_unhackable": f"CASE WHEN ({has('immutable')} OR {has('tamper')}) AND {has('cannot be changed')} THEN a || {S.lit(lx.UNHACKABLE_CLAUSE)} "
    f"WHEN ({has('immutable')} OR {has('tamper')}) AND {has('permanent')} THEN {chain([('permanent', 'hack-proof')])} END",
    "pow_vs_pos": f"nullif({chain(POS)}, a)",
    "gas_fees_purpose": when(has("gas"), f"nullif({chain(lx.GAS_SWAPS)}, a)"),
    "smart_contract_capabilities": f"CASE WHEN {has('smart contract')} AND ({has('oracle')} OR {has('external')}) THEN {chain([('oracle', 'built-in internet access')])} "
    f"WHEN {has('smart contract', 'blockchain', 'data')} THEN a || {S.lit(lx.API_CLAUSE)} END",
    "merkle_tree_purpose": when(f"({has('merkle')} OR {has('tree')}) AND {has('verif')}", f"replace(a, 'verification', ({S.arr(lx.MERKLE_PURPOSES)})[ascii(md5(a)) % 4 + 1])"),
}


def words_of(concepts) -> list[str]:
    return [w for c in concepts for w in lx.CONCEPT_WORDS[c]]


parts = [
    f"SELECT {KS}, difficulty, a, l, {S.lit(n)} AS pattern, {low} AS low, {high} AS high, difficulty IN ({', '.join(S.lit(x) for x in levels)}) AND {S.any_word('l', words_of(concepts))} AS applies, "
    f"{REWRITE_SQL[n]} AS distractor FROM ans"
    for n, levels, (low, high), concepts in lx.PATTERNS
]
PATTERNS = f"ans AS (SELECT *, correct_answer a, lower(correct_answer) l FROM bank),\npat AS ({' UNION ALL '.join(parts)})"
G = B + [PATTERNS]
tags = S.issues(*[(S.any_word("lower(correct_answer)", w), S.lit(c)) for c, w in lx.TAG_WORDS.items()])
add(
    "concept_tags",
    lambda s, d: flat(bank(s, d).select(*K, rw.concept_tags(F.col("correct_answer")).alias("concepts"))),
    B,
    f"SELECT {KS}, {S.join(tags)} AS concepts FROM bank",
)
add("pattern_applicable", lambda s, d: distractors.applicable_patterns(bank(s, d)), G, f"SELECT {KS}, pattern FROM pat WHERE applies")
add(
    "pattern_rewrite",
    lambda s, d: distractors.rewritten(bank(s, d)).select(*K, "pattern", "distractor"),
    G,
    f"SELECT {KS}, pattern, distractor FROM pat WHERE distractor IS NOT NULL",
)
VALID = (
    f"length(a) > 0 AND lower(trim(distractor)) <> lower(trim(a)) AND length(distractor) / length(a) BETWEEN 0.5 AND 2 AND {S.any_word('lower(distractor)', lx.DISTRACTOR_TERMS)}"
)
add(
    "distractor_valid",
    lambda s, d: distractors.rewritten(bank(s, d)).filter(rw.valid_distractor(F.col("distractor"), F.col("correct_answer"))).select(*K, "pattern", "distractor"),
    G,
    f"SELECT {KS}, pattern, distractor FROM pat WHERE distractor IS NOT NULL AND {VALID}",
)
add(
    "distractor_select",
    lambda s, d: distractors.select_distractors(bank(s, d)),
    G + [
        f"drawn AS (SELECT *, md5(assessment_id || '|' || question_index || '|' || pattern || '|0') draw FROM pat WHERE applies AND distractor IS NOT NULL AND {VALID})"
    ],
    f"SELECT {KS}, row_number() OVER (PARTITION BY {KS} ORDER BY draw) AS choice, difficulty, pattern, distractor, CAST(low + ascii(draw) % (high - low + 1) AS BIGINT) AS closeness FROM drawn QUALIFY choice <= 3",
)
facts = [(n, g, k) for n, levels, _, concepts in lx.PATTERNS for g, k in [("difficulty", x) for x in levels] + [("concept", c) for c in concepts]]
add(
    "pattern_registry",
    lambda s, d: distractors.used_registry(distractors.applicable_patterns(bank(s, d))),
    G + [f"facts(p, grouping_name, entry) AS (VALUES {', '.join(f'({S.lit(n)}, {S.lit(g)}, {S.lit(k)})' for n, g, k in facts)})"],
    'SELECT pattern, answers, grouping_name AS "grouping", entry FROM (SELECT pattern, count(*) AS answers FROM pat WHERE applies GROUP BY 1) JOIN facts ON p = pattern',
)

# --- assembly ---------------------------------------------------------------------------------


def accepted(s, d):
    return scoring.gated(bank(s, d))


GR = B + [S.GATE, REQUESTS]
add(
    "exact_count",
    lambda s, d: assembly.exact_count(accepted(s, d).select(*K, "question_text"), requests(s, d)),
    GR,
    f"SELECT {KS}, question_text FROM (SELECT g.assessment_id, question_index, question_text, requested, row_number() OVER (PARTITION BY g.assessment_id ORDER BY question_index) n FROM gate g "
    "JOIN requests r ON r.assessment_id = g.assessment_id WHERE passed >= 5) WHERE n <= requested",
)
T = lx.FALLBACK_TEMPLATES
LOOKALIKES = [q for q, *_ in T] + [f"In blockchain systems, {q.lower()}" for q, *_ in T]


def accepted_lookalikes(s, d):
    """Accepted questions; of every assessment but each seventh the first one reads like a fallback of some form."""
    rows = accepted(s, d).select(*K, "question_text")
    first = (F.col("question_index") == 0) & (F.col("assessment_id") % 7 < len(LOOKALIKES))
    text = F.get(F.array(*map(F.lit, LOOKALIKES)), (F.col("assessment_id") % 7).cast("int"))
    return rows.withColumn("question_text", F.when(first, text).otherwise(F.col("question_text")))


def word_set(x: str) -> str:
    return f"list_distinct([w FOR w IN regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+') IF w <> ''])"


def seen_sql(t: int, form: int) -> str:
    text = S.lit([T[t][0], f"In blockchain systems, {T[t][0].lower()}"][form])
    mine = word_set(text)
    return f"bool_or(len(list_intersect(ws, {mine})) / len(list_distinct(list_concat(ws, {mine}))) > 0.8e0) AS s{t}{form}"


LOOK = [
    f"acc AS (SELECT assessment_id, question_index, CASE WHEN question_index = 0 AND assessment_id % 7 < {len(LOOKALIKES)} THEN ({S.arr(LOOKALIKES)})[assessment_id % 7 + 1] ELSE question_text END AS question_text FROM gate WHERE passed >= 5)",
    f"aw AS (SELECT *, {word_set('question_text')} AS ws FROM acc)",
    f"seen AS (SELECT assessment_id, count(*) AS n, {', '.join(seen_sql(t, f) for t in range(3) for f in (0, 1))} FROM aw GROUP BY 1)",
    "fr AS (SELECT r.assessment_id, coalesce(n, 0) AS n, unnest(range(0, greatest(0, requested - coalesce(n, 0)))) AS i, "
    + ", ".join(f"coalesce(s{t}{f}, false) AS s{t}{f}" for t in range(3) for f in (0, 1))
    + " FROM requests r LEFT JOIN seen ON seen.assessment_id = r.assessment_id)",
]


def form_sql(t: int) -> str:
    # the prefixed second template shares seven of nine words with its plain form and so may follow it; the longer first and
    # third ones may not; every prefixed form may follow its replacing form only if the shared words are few enough
    q = T[t][0]
    plain, prefixed, other = S.lit(q), S.lit(f"In blockchain systems, {q.lower()}"), S.lit(f"Regarding blockchain, {q.lower()}")
    far = lambda a, b: f"len(list_intersect({word_set(a)}, {word_set(b)})) <= 0.8e0 * len(list_distinct(list_concat({word_set(a)}, {word_set(b)})))"
    return (
        f"CASE WHEN i < 3 THEN CASE WHEN s{t}0 THEN {other} ELSE {plain} END WHEN i < 6 AND NOT s{t}1 AND CASE WHEN s{t}0 THEN {far(prefixed, other)} ELSE {far(prefixed, plain)} END THEN {prefixed} ELSE {other} END"
    )


FALLBACK_TEXT = f"CASE i % 3 WHEN 0 THEN {form_sql(0)} WHEN 1 THEN {form_sql(1)} ELSE {form_sql(2)} END"
add(
    "fallback_fill",
    lambda s, d: flat(assembly.fallback_fill(accepted_lookalikes(s, d), requests(s, d))),
    GR + LOOK,
    f"SELECT assessment_id, i, {FALLBACK_TEXT} AS question_text, ({S.arr([t[1] for t in T])})[i % 3 + 1] AS correct_answer, ({S.arr([' | '.join(t[2]) for t in T])})[i % 3 + 1] AS distractor_texts, "
    "'fallback_misconception' AS misconception_type, 'Common misconception addressed by fallback question' AS misconception_explanation, "
    f"'This tests understanding of ' || ({S.arr([t[3] for t in T])})[i % 3 + 1] AS explanation, 'medium' AS difficulty, 'understand' AS bloom_level, ({S.arr([t[3] for t in T])})[i % 3 + 1] AS source_context, i % 3 AS template_used FROM fr",
)
add(
    "guaranteed_set",
    lambda s, d: assembly.guaranteed_set(accepted_lookalikes(s, d), requests(s, d)),
    GR + LOOK,
    "SELECT assessment_id, n AS place, question_text, 'generated' AS origin FROM (SELECT acc.assessment_id, question_text, requested, row_number() OVER (PARTITION BY acc.assessment_id ORDER BY question_index) n FROM acc "
    f"JOIN requests r ON r.assessment_id = acc.assessment_id) WHERE n <= requested UNION ALL SELECT assessment_id, n + i + 1 AS place, {FALLBACK_TEXT} AS question_text, 'fallback' AS origin FROM fr",
)


def listed(s, d):
    """Slots 0-3 of every document ask for questions 0, 2, 5 and 99."""
    slots = F.array(*[F.lit(x).cast("bigint") for x in (0, 2, 5, 99)])
    return load(s, d, "documents").select(F.col("doc_id").alias("assessment_id"), F.posexplode(slots).alias("slot", "question_index"))


LISTED = "listed AS (SELECT doc_id AS assessment_id, unnest([0, 1, 2, 3]) AS slot, unnest([0, 2, 5, 99]) AS question_index FROM documents)"
add(
    "regenerate_overlay",
    lambda s, d: assembly.overlay(
        bank(s, d),
        listed(s, d),
        bank(s, d).select((F.col("assessment_id") - 1).alias("assessment_id"), F.col("question_index").cast("int").alias("slot"), "question_text"),
    ),
    B + [LISTED],
    f"SELECT b.assessment_id, b.question_index, coalesce(f.question_text, b.question_text) AS question_text, f.question_text IS NOT NULL AS replaced FROM bank b LEFT JOIN listed l ON l.assessment_id = b.assessment_id "
    "AND l.question_index = b.question_index LEFT JOIN bank f ON f.assessment_id = b.assessment_id + 1 AND f.question_index = l.slot",
)
add(
    "regenerate_candidates",
    lambda s, d: assembly.regenerate_candidates(scored(s, d), listed(s, d)),
    B + [S.SCORED, LISTED],
    "SELECT s.assessment_id, s.question_index, overall_score, l.slot IS NOT NULL AS listed FROM scored s LEFT JOIN listed l ON l.assessment_id = s.assessment_id AND l.question_index = s.question_index "
    "WHERE overall_score < 0.6e0 OR l.slot IS NOT NULL",
)
QUOTA = {"easy": 2, "medium": 3, "hard": 1}
add(
    "difficulty_mix",
    lambda s, d: assembly.difficulty_mix(bank(s, d).select(*K, "difficulty"), QUOTA),
    B,
    f"SELECT {KS}, difficulty FROM bank QUALIFY row_number() OVER (PARTITION BY assessment_id, difficulty ORDER BY question_index) <= CASE difficulty WHEN 'easy' THEN 2 WHEN 'medium' THEN 3 ELSE 1 END",
)


def entries(s, d):
    day = (F.lit(20) + F.col("doc_id") % 11).cast("int")
    return load(s, d, "documents").select(
        F.col("doc_id").alias("assessment_id"), F.make_timestamp(F.lit(2024), F.lit(1), day, F.lit(12), F.lit(0), F.lit(0)).alias("cached_at")
    )


add(
    "cached_reuse",
    lambda s, d: assembly.cached_reuse(bank(s, d).select(*K), entries(s, d), requests(s, d).select("assessment_id", "requested"), AS_OF),
    B + [REQUESTS],
    f"SELECT b.assessment_id, b.question_index FROM bank b JOIN requests r ON r.assessment_id = b.assessment_id JOIN (SELECT assessment_id, count(*) n FROM bank GROUP BY 1) c ON c.assessment_id = b.assessment_id "
    f"WHERE n >= requested AND question_index < requested AND make_timestamp(2024, 1, 20 + b.assessment_id % 11, 12, 0, 0) >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY",
)
add(
    "seeded_shuffle",
    lambda s, d: assembly.seeded_shuffle(bank(s, d).select(*K), "42"),
    B,
    f"SELECT {KS}, md5(assessment_id || '|' || question_index || '|42') AS shuffle_key FROM bank ORDER BY 3, 1, 2",
)
add(
    "bulk_concat",
    lambda s, d: assembly.concat_batches(*[bank(s, d).filter(F.col("perspective") == p).select(*K, "perspective") for p in lx.PERSPECTIVES]),
    B,
    f"SELECT {KS}, perspective FROM bank",
)

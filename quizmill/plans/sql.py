"""DuckDB text for the oracle side: the same relations and rules, written independently in SQL."""

from __future__ import annotations

from quizmill import lexicon as lx
from quizmill.sources.bridge import CLAUSES, HEADINGS, STEMS


def unicode_words(pattern: str) -> str:
    """RE2 has no look-behind; a match that could start inside a word also starts at its beginning."""
    return pattern.replace(r"\b(", "(").replace(r"\w", r"[\p{L}\p{N}_]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, index: str) -> str:
    return f"({arr(values)})[({index}) + 1]"


def wc(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def any_word(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def count_present(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {lit(w)}) AS BIGINT)" for w in words) + ")"


def present(x: str, words) -> str:
    return f"[w FOR w IN {arr(words)} IF contains({x}, w)]"


def issues(*pairs) -> str:
    inner = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m in pairs)
    return f"list_filter([{inner}], lambda v: v IS NOT NULL)"


def bands(x: str, steps, last: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {v} THEN {lit(l)}" for v, l in steps) + f" ELSE {lit(last)} END"


def lookup(x: str, table: dict, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {lit(default)} END"


def join(x: str, sep: str = " | ") -> str:
    return f"coalesce(array_to_string({x}, {lit(sep)}), '')"


def r3(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 9)), 3) AS DOUBLE)"


def either(patterns, flags: str = "s") -> str:
    return f"(?{flags}:" + "|".join(f"(?:{unicode_words(p)})" for p in patterns) + ")"


EQ_RE = either(lx.EQUATION_PATTERNS, "si")
CODE_RE = either(lx.CODE_PATTERNS)
SECTION_RE = either(lx.SECTION_PATTERNS, "i")


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


# --- relations -------------------------------------------------------------------

PAGES = f"""
page_lines AS (SELECT doc_id, string_split(text, chr(10)) l FROM documents),
page_nums AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(len(l) / 10.0) AS BIGINT))) i FROM page_lines),
page_parts AS (SELECT doc_id, i, {pick(HEADINGS, f"(doc_id + i) % {len(HEADINGS)}")} h,
  array_to_string(list_slice(l, i * 10 + 1, i * 10 + 10), chr(10)) body FROM page_nums),
doc_pages AS (SELECT doc_id, i + 1 AS page_num, CASE WHEN h = '' THEN body ELSE h || chr(10) || body END AS text
  FROM page_parts WHERE trim(CASE WHEN h = '' THEN body ELSE h || chr(10) || body END) <> '')
"""

# headings hold line breaks as real characters
BANK = f"""
bank_s AS (SELECT doc_id a, source, string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) s FROM documents),
bank_q AS (SELECT a, source, s, unnest(range(0, CAST(ceil(len(s) / 5.0) AS BIGINT))) q FROM bank_s),
bank_b AS (SELECT a, source, q, list_slice(s, q * 5 + 1, q * 5 + 5) b,
  {pick(STEMS, f"(a + q) % {len(STEMS)}")} stem, {pick(CLAUSES, f"(a * 5 + q * 7) % {len(CLAUSES)}")} clause FROM bank_q),
bank_t AS (SELECT *, coalesce(b[2], '') sent2,
  CASE WHEN (a + q) % 5 <> 0 AND suffix(b[1], '.') THEN left(b[1], length(b[1]) - 1) || '?' ELSE b[1] END asked FROM bank_b),
bank AS (SELECT a AS assessment_id, q AS question_index,
  CASE WHEN stem = '' THEN asked ELSE stem || ' ' || asked END AS question_text,
  CASE WHEN (a + q) % 7 = 0 THEN 'true_false' ELSE 'multiple_choice' END AS question_type,
  CASE WHEN (a * 3 + q) % 10 < 3 THEN 'easy' WHEN (a * 3 + q) % 10 < 8 THEN 'medium' ELSE 'hard' END AS difficulty,
  CASE WHEN clause = '' THEN sent2 ELSE clause || ': ' || sent2 END AS correct_answer,
  list_transform(list_slice(b, 3, 5), lambda x, i: {{'text': x, 'misconception_type': 'm' || ((a + q * i) % 5),
    'explanation': 'Mixes it up with m' || ((a + q * i) % 5), 'closeness_score': 1 + (a * 7 + q * 5 + i * 3) % 10}}) AS distractors,
  'Stated in ' || source AS explanation, lower(string_split(sent2, ' ')[1]) AS concept,
  {pick(lx.PERSPECTIVES, f"(a + q) % {len(lx.PERSPECTIVES)}")} AS perspective,
  {pick(["A", "B", "C", "D"], "(a * q) % 4")} AS correct_position, source AS source_file FROM bank_t)
"""

_D = "distractors"
_C = "[d.closeness_score FOR d IN distractors]"
_KINDS = "len(list_distinct([d.misconception_type FOR d IN distractors]))"
OPTION_TEXTS = "list_concat([correct_answer], [d.text FOR d IN distractors])"
OPTION_TEXTS3 = "list_concat([correct_answer], [d.text FOR d IN list_slice(distractors, 1, 3)])"


def words_of(texts: str) -> str:
    return f"[len(regexp_extract_all(t, '\\S+')) FOR t IN {texts}]"


def _bloom() -> str:
    hits = {k: count_present("lq", w) for k, w in lx.BLOOM_WORDS.items()}
    best = "greatest(" + ", ".join(hits.values()) + ")"
    out = "CASE "
    for level, words in lx.BLOOM_FALLBACK:
        out += f"WHEN {best} = 0 AND {any_word('lq', words)} THEN {lit(level)} "
    out += f"WHEN {best} = 0 THEN 'understand' "
    for level, n in hits.items():
        out += f"WHEN {n} = {best} THEN {lit(level)} "
    return out + "END"


_m = lx.DISTRACTOR_ISSUES
_c = lx.CLARITY_ISSUES
_l = lx.LANGUAGE_ISSUES
_a = lx.QUESTION_ADVICE

SCORED = f"""
sc0 AS (SELECT *, lower(question_text) lq, greatest(1, {wc('question_text')}) nw, {wc('question_text')} nw0,
  greatest(1, len(regexp_extract_all(question_text, '[.!?]+'))) ns,
  coalesce(list_sum([greatest(1, len(regexp_extract_all(lower(w), '[aeiouy]+'))) FOR w IN regexp_extract_all(question_text, '\\S+')]), 0) nsyl,
  len(distractors) nd, {_C} cl, {_KINDS} kinds,
  {words_of(OPTION_TEXTS3)} ow3, {words_of(OPTION_TEXTS)} ow FROM bank),
sc1 AS (SELECT *, 206.835e0 - 1.015e0 * (nw / ns) - 84.6e0 * (nsyl / nw) AS ease,
  0.39e0 * (nw / ns) + 11.8e0 * (nsyl / nw) - 15.59e0 AS gr,
  coalesce(list_sum(cl), 0) csum, len([x FOR x IN cl IF x >= 6]) strong, len([x FOR x IN cl IF x < 4]) weak,
  coalesce(list_sum([x * x FOR x IN cl]), 0) csq,
  {_bloom()} AS bloom_level,
  {issues(("contains(lq, 'not')", lit(_c['negative'])), ("len(regexp_extract_all(question_text, '[?]')) <> 1", lit(_c['marks'])),
          ("nw0 < 5", lit(_c['short'])), ("nw0 > 30", lit(_c['long'])),
          (f"len({present('lq', lx.AMBIGUOUS_WORDS)}) > 0", lit(_c['ambiguous']) + " || " + f"array_to_string({present('lq', lx.AMBIGUOUS_WORDS)}, ', ')"),
          ("list_max(ow3) > 2 * list_min(ow3)", lit(_c['unbalanced'])))} AS clarity_issues,
  {issues(("NOT regexp_matches(question_text, '^\\p{Lu}')", lit(_l['capital'])), ("NOT regexp_matches(question_text, '[?]\\s*$')", lit(_l['end'])),
          ("contains(question_text, '  ')", lit(_l['spaces'])), ("regexp_matches(question_text, '[\\[\\]{}]')", lit(_l['brackets'])),
          ("nw0 <> len(list_distinct(regexp_extract_all(lq, '\\S+')))", lit(_l['repeat'])))} AS language_issues
  FROM sc0),
sc2 AS (SELECT *, round(ease, 6) AS flesch_score, round(gr, 6) AS grade_level,
  round(greatest(0e0, least(1e0, (ease - 30) / 70)), 6) AS readability_score,
  round(gr, 6) BETWEEN 8 AND 12 AS appropriate,
  {bands('round(ease, 6)', lx.READABILITY_BANDS, lx.READABILITY_LAST)} AS readability_level,
  CASE WHEN nd > 0 THEN strong ELSE 0 END AS strong_count, CASE WHEN nd > 0 THEN weak ELSE 0 END AS weak_count,
  CASE WHEN nd > 0 THEN round(csum / nd, 6) ELSE 0e0 END AS average_closeness,
  CASE WHEN nd > 0 THEN round(kinds / nd, 6) ELSE 0e0 END AS distractor_diversity,
  CASE WHEN nd > 0 THEN round(least(1e0, csum / nd / 10 * 0.6e0 + strong / nd * 0.3e0 + kinds / nd * 0.1e0), 6) ELSE 0e0 END AS distractor_score,
  CASE WHEN nd = 0 THEN [{lit(_m['none'])}] ELSE {issues(("nd < 3", lit(_m['few'])), ("strong < 2", lit(_m['weak'])),
      ("nd > 1 AND nd * csq - csum * csum < nd * (nd - 1)", lit(_m['flat'])), ("kinds = 1", lit(_m['same'])))} END AS distractor_issues,
  round(list_position({arr(lx.BLOOM_WORDS)}, bloom_level) / 6, 6) AS cognitive_score,
  round(greatest(0e0, 1e0 - len(clarity_issues) * 0.2e0), 6) AS clarity_score,
  round(greatest(0e0, 1e0 - len(language_issues) * 0.25e0), 6) AS language_score,
  round(CASE WHEN nd > 0 THEN (least(1e0, nw0 / 20) + csum / nd / 10 + 0.5e0) / 3 ELSE (least(1e0, nw0 / 20) + 0.5e0) / 2 END, 6) AS predicted_score
  FROM sc1),
sc3 AS (SELECT *, CASE WHEN predicted_score < 0.4e0 THEN 'EASY' WHEN predicted_score < 0.7e0 THEN 'MEDIUM' ELSE 'HARD' END AS predicted_level,
  round(readability_score * 0.15e0 + distractor_score * 0.3e0 + cognitive_score * 0.2e0 + clarity_score * 0.25e0 + language_score * 0.1e0, 8) AS overall_score
  FROM sc2),
scored AS (SELECT *, {bands('overall_score', lx.GRADE_BANDS, lx.GRADE_LAST)} AS quality_grade,
  {issues(("readability_score < 0.6e0", lit(_a['readability'])), ("strong_count < 2", lit(_a['strong'])), ("distractor_diversity < 0.5e0", lit(_a['diverse'])),
          ("clarity_score < 0.7e0", lit(_a['clarity']) + " || array_to_string(clarity_issues, ', ')"), ("bloom_level = 'remember'", lit(_a['level'])),
          ("len(language_issues) > 0", lit(_a['grammar'])))} AS recommendations FROM sc3)
"""

_checks = {
    "no_placeholder": f"len([t FOR t IN {OPTION_TEXTS} IF {any_word('lower(t)', lx.GATE_PLACEHOLDERS)}]) = 0",
    "option_length": "len([k FOR k IN ow IF k < 3 OR k > 35]) = 0",
    "distractors_ok": "len(distractors) >= 2 AND len([x FOR x IN distractors IF length(trim(x.text)) < 5]) = 0",
    "clear_question": f"regexp_matches(question_text, '[?]\\s*$') AND {wc('question_text')} BETWEEN 3 AND 25",
    "no_negative": f"NOT {any_word('lower(question_text)', lx.GATE_NEGATIVES)}",
    "balanced": "list_max(ow) <= 2 * list_min(ow)",
}
GATE = (
    "gate AS (SELECT *, "
    + ", ".join(f"({c}) AS {n}" for n, c in _checks.items())
    + ", "
    + " + ".join(f"CAST(({c}) AS BIGINT)" for c in _checks.values())
    + f" AS passed FROM (SELECT *, {words_of(OPTION_TEXTS)} ow FROM bank))"
)

EVENTS = "ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) k FROM events)"

SESSIONS = EVENTS + f""",
session_rows AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS task_id, event_id, ts AS "timestamp",
  {pick(["easy", "medium", "hard"], "event_id % 3")} AS difficulty, 5 + event_id % 20 AS num_questions_requested,
  5 + event_id % 20 - k % 5 AS num_questions_generated, value AS generation_time,
  1 - (k % 10) / 20.0e0 AS success_rate, k / 100.0e0 AS average_quality_score FROM ev)
"""

TASKS = EVENTS + f""",
task_events AS (SELECT user_id AS task_id, event_id, ts, event_type AS step, {pick(list(lx.STAGE_WEIGHTS), f"event_id % {len(lx.STAGE_WEIGHTS)}")} AS stage,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'uploading' ELSE 'processing' END AS status,
  k AS percentage, value FROM ev)
"""

CALLS = EVENTS + """,
api_calls AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'completions' ELSE 'embeddings' END AS endpoint, ts, k AS remaining_calls FROM ev)
"""

CACHE = EVENTS + f""",
cache_events AS (SELECT event_id, {pick(list(lx.TTL_MINUTES), f"user_id % {len(lx.TTL_MINUTES)}")} AS cache_type,
  CASE event_type WHEN 'view' THEN 'hit' WHEN 'click' THEN 'miss' WHEN 'purchase' THEN 'save' WHEN 'error' THEN 'expired' ELSE 'hit' END AS operation,
  ts AS stored_at, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM ev)
"""

VECTORS = """
chunk_vectors AS (SELECT CAST(e.label AS BIGINT) AS collection, 'c' || e.vec_id AS chunk_id, e.vec_id AS doc_id, d.text, e.embedding,
  CASE WHEN e.vec_id % 11 <> 0 THEN (e.vec_id % 100) / 100.0e0 END AS importance_score,
  e.vec_id % 7 AS page_num, e.vec_id % 13 AS chunk_index,
  CASE WHEN e.vec_id % 3 <> 0 THEN 'Part ' || (e.vec_id % 5) END AS section,
  'c' || (e.vec_id - 10) AS prev_chunk, 'c' || (e.vec_id + 10) AS next_chunk
  FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
vector_cells AS (SELECT CAST(label AS BIGINT) AS label, unnest(embedding)::DOUBLE x, generate_subscripts(embedding, 1) dim FROM embeddings),
centroids AS (SELECT label, list(x ORDER BY dim) AS vector FROM (SELECT label, dim, avg(x) x FROM vector_cells GROUP BY 1, 2) GROUP BY 1)
"""


def query(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + body

"""Registered queries on gates, validation and duplicates."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.operators import dedupe, scoring, validation
from quizmill.plans import sql as S
from quizmill.plans.common import bank, flat
from quizmill.plans.questions import BIAS
from quizmill.session import load

K = ["assessment_id", "question_index"]
KS = "assessment_id, question_index"
QUERIES: dict = {}
ORACLES: dict = {}


def add(name, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body)


B = [S.BANK]
names = list(S._checks)

add(
    "six_check_gate",
    lambda s, d: bank(s, d).select(*K, *[c.alias(n) for n, c in rules.six_checks().items()], rules.six_check_pass().alias("passes")),
    B + [S.GATE],
    f"SELECT {KS}, {', '.join(names)}, passed >= 5 AS passes FROM gate",
)

NEAR = """
tok AS (SELECT assessment_id, question_index, list_sort(list_distinct([w FOR w IN string_split(trim(regexp_replace(lower(question_text), '[^\\p{L}\\p{N}_]+', ' ', 'g')), ' ') IF w <> ''])) t FROM bank),
reps AS (SELECT *, min(question_index) OVER (PARTITION BY assessment_id, t) rep FROM tok),
words AS (SELECT assessment_id, question_index, len(t) n, unnest(t) w FROM reps WHERE question_index = rep),
near AS (SELECT assessment_id, question_index, rep AS near_index, 1e0 AS similarity, rep AS rep_index FROM reps WHERE question_index > rep
  UNION ALL SELECT *, question_index AS rep_index FROM (SELECT b.assessment_id, b.question_index, a.question_index AS near_index, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS similarity
  FROM words a JOIN words b ON a.assessment_id = b.assessment_id AND a.w = b.w AND a.question_index < b.question_index GROUP BY 1, 2, 3) WHERE similarity > 0.8e0)
"""
STRICT = (
    f"{S.wc('question_text')} BETWEEN 5 AND 40 AND suffix(question_text, '?') AND {S.wc('correct_answer')} >= 2 AND len(distractors) = 3 "
    f"AND len([t FOR t IN {S.OPTION_TEXTS} IF {S.any_word('lower(t)', lx.STRICT_PLACEHOLDERS)}]) = 0"
)
add(
    "strict_gate",
    lambda s, d: bank(s, d).filter(rules.strict_pass()).select(*K)
    .join(dedupe.near_duplicates(bank(s, d)).select(*K), K, "left_anti"),
    B + [NEAR],
    f"SELECT {KS} FROM bank b WHERE {STRICT} AND NOT EXISTS (SELECT 1 FROM near n WHERE n.assessment_id = b.assessment_id AND n.question_index = b.question_index)",
)

# --- validation --------------------------------------------------------------------


def fill(template: str, **parts: str) -> str:
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    return " || ".join(parts[p[1:-1]] if p.startswith("{") else S.lit(p) for p in pieces)


def issue(kind: str, **parts: str) -> str:
    sev, typ, desc, sug = lx.VALIDATION[kind]
    return f"{{'severity': '{sev}', 'issue_type': '{typ}', 'description': {fill(desc, **parts)}, 'suggestion': {fill(sug, **parts)}}}"


def texts_sql(x: str, field: str) -> str:
    q = field == "question_text"
    lo, hi = (5, 50) if q else (3, 30)
    f = S.lit(field)
    checks = [
        (f"regexp_matches({x}, {S.lit('(?i)' + validation.bounded(p))})", issue("placeholder", field=f, text=f"left({x}, 50)"))
        for p in lx.PLACEHOLDER_PATTERNS
    ]
    checks.append((f"{S.wc(x)} < {lo}", issue("short", field=f, n=S.wc(x), limit=S.lit(str(lo)))))
    checks.append((f"{S.wc(x)} > {hi}", issue("long", field=f, n=S.wc(x), limit=S.lit(str(hi)))))
    if not q:
        checks.append((f"suffix({x}, '?')", issue("question_mark", field=f)))
    return f"CASE WHEN {x} IS NULL OR trim({x}) = '' THEN [{issue('empty', field=f)}] ELSE {S.issues(*checks)} END"


def options_sql() -> str:
    parts = [S.issues(*[(f"opt[{i}] IS NULL", issue("missing_option", key=S.lit(k))) for i, k in enumerate("ABCD", 1)])]
    parts += [f"CASE WHEN opt[{i}] IS NULL THEN [] ELSE {texts_sql(f'opt[{i}]', f'option_{k}')} END" for i, k in enumerate("ABCD", 1)]
    parts.append(
        S.issues(
            *[
                (f"len(ow) >= 3 AND abs(ow[{i}] - list_sum(ow) / len(ow)) > list_sum(ow) / len(ow) * 0.75e0", issue("unbalanced", key=S.lit(k)))
                for i, k in enumerate("ABCD", 1)
            ]
        )
    )
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def fields_sql() -> str:
    return S.issues(
        ("question_text IS NULL", issue("missing_field", field="'question_text'")),
        ("correct_answer IS NULL", issue("missing_field", field="'options'")),
        ("correct_position IS NULL", issue("missing_field", field="'correct_position'")),
        ("coalesce(correct_position, '') NOT IN ('A', 'B', 'C', 'D')", issue("position", value="coalesce(correct_position, '')")),
        ("coalesce(lower(difficulty), '') NOT IN ('easy', 'medium', 'hard')", issue("difficulty", value="coalesce(lower(difficulty), '')")),
    )


# some rows get a letter, level or position outside the allowed values, so the rules have work
def dirty(s, d):
    i = F.col("assessment_id") + F.col("question_index")
    return bank(s, d).withColumns(
        {
            "difficulty": F.when(i % 11 == 0, "expert").otherwise(F.col("difficulty")),
            "correct_position": F.when(i % 13 == 0, "E").when(i % 17 != 0, F.col("correct_position")),
        }
    )


DIRTY = f"""
dirty AS (SELECT * REPLACE (CASE WHEN (assessment_id + question_index) % 11 = 0 THEN 'expert' ELSE difficulty END AS difficulty,
  CASE WHEN (assessment_id + question_index) % 13 = 0 THEN 'E' WHEN (assessment_id + question_index) % 17 <> 0 THEN correct_position END AS correct_position),
  {S.OPTION_TEXTS3} opt, {S.words_of(S.OPTION_TEXTS3)} ow FROM bank)
"""


def issue_query(source: str, expr: str) -> str:
    return f"SELECT assessment_id, question_index + 1 AS question_id, unnest(i, recursive := true) FROM (SELECT assessment_id, question_index, unnest({expr}) i FROM {source})"


add("validate_question", lambda s, d: validation.issue_rows(dirty(s, d), validation.field_issues()), B + [DIRTY], issue_query("dirty", fields_sql()))
add(
    "validate_text",
    lambda s, d: validation.issue_rows(bank(s, d), validation.text_issues(F.col("question_text"), "question_text")),
    B,
    issue_query("bank", texts_sql("question_text", "question_text")),
)
add("validate_options", lambda s, d: validation.issue_rows(bank(s, d), validation.option_issues()), B + [DIRTY], issue_query("dirty", options_sql()))
DUP = "dup AS (SELECT assessment_id, question_index, first_index FROM (SELECT *, min(question_index) OVER (PARTITION BY assessment_id, trim(lower(question_text))) first_index FROM bank) WHERE question_index > first_index)"
add("exact_duplicates", lambda s, d: dedupe.exact_duplicates(bank(s, d)), B + [DUP], "SELECT * FROM dup")
ISSUES = f"""
own AS ({issue_query('dirty', f"list_concat(list_concat({fields_sql()}, {texts_sql('question_text', 'question_text')}), {options_sql()})")}),
all_issues AS (SELECT * FROM own UNION ALL SELECT assessment_id, question_index + 1, 'major', 'duplicate', {fill(lx.VALIDATION['duplicate'][2], n='(first_index + 1)')}, {S.lit(lx.VALIDATION['duplicate'][3])} FROM dup)
"""
VALID = f"""
vi AS (SELECT assessment_id, count(*) FILTER (severity = 'critical') c, count(*) FILTER (severity = 'major') m, count(*) FILTER (severity = 'minor') n,
  count(*) FILTER (issue_type = 'duplicate') d FROM all_issues GROUP BY 1),
vb AS (SELECT assessment_id, count(*) n, count(*) FILTER (correct_position = 'A') a, count(*) FILTER (correct_position = 'B') b,
  count(*) FILTER (correct_position = 'C') c, count(*) FILTER (correct_position = 'D') d, count(DISTINCT difficulty) variety FROM dirty GROUP BY 1),
valid AS (SELECT assessment_id, greatest(a, b, vb.c, vb.d) / vb.n > 0.4e0 AS bias_detected, round(greatest(a, b, vb.c, vb.d) / vb.n, 6) AS max_share, vb.n AS total_questions, variety AS variety_score,
  coalesce(vi.c, 0) AS critical_issues, coalesce(vi.m, 0) AS major_issues, coalesce(vi.n, 0) AS minor_issues, coalesce(vi.d, 0) AS duplicate_questions,
  greatest(0, least(100, 100 - coalesce(vi.c, 0) * 20 - coalesce(vi.m, 0) * 10 - coalesce(vi.n, 0) * 2
    + CASE WHEN greatest(a, b, vb.c, vb.d) / vb.n > 0.4e0 THEN 0 ELSE 5 END + CASE WHEN variety >= 2 THEN 5 ELSE 0 END)) AS overall_score
  FROM vb LEFT JOIN vi USING (assessment_id))
"""
V = B + [DIRTY, DUP, ISSUES, VALID]
add("validation_score", lambda s, d: flat(validation.validation_scores(dirty(s, d))), V, "SELECT * FROM valid")


def report_sql(shown: int = 10) -> str:
    rule = S.lit("=" * 60)
    rows = [
        (1, 1, rule, None), (1, 2, S.lit(lx.REPORT_TITLE), None), (1, 3, rule, None), (2, 1, S.lit("📊 SUMMARY:"), None),
        (2, 2, "'   Overall Score: ' || overall_score || '.0/100'", None), (2, 3, "'   Total Questions: ' || total_questions", None),
        (2, 4, "'   Total Issues: ' || (critical_issues + major_issues + minor_issues)", None),
        (2, 5, "'   Critical: ' || critical_issues", None), (2, 6, "'   Major: ' || major_issues", None), (2, 7, "'   Minor: ' || minor_issues", None),
        (2, 8, S.lit("🎯 GRADE: ") + " || " + S.bands("overall_score", lx.REPORT_GRADES, lx.REPORT_GRADE_LAST), None),
    ]
    for i, sev in enumerate(("critical", "major", "minor")):
        rows.append((3 + i, 0, f"'   {sev.upper()} ISSUES (' || {sev}_issues || '):'", f"{sev}_issues > 0"))
        rows.append((3 + i, shown + 1, f"'     ... and ' || ({sev}_issues - {shown}) || ' more {sev} issues'", f"{sev}_issues > {shown}"))
    rows.append((6, 1, S.lit("⚠️  POSITION BIAS DETECTED: ") + " || format('{:.1f}', max_share * 100) || '%'", "bias_detected"))
    rows.append((7, 0, S.lit("💡 RECOMMENDATIONS:"), None))
    for i, (name, text) in enumerate(lx.REPORT_ADVICE, 1):
        rows.append((7, i, S.lit(text), name if name == "bias_detected" else f"{name} > 0"))
    rows.append((8, 1, S.lit(lx.REPORT_LAST), None))
    parts = [f"SELECT assessment_id, {a}::BIGINT AS section, {b}::BIGINT AS seq, {t} AS line FROM valid" + (f" WHERE {w}" if w else "") for a, b, t, w in rows]
    parts.append(
        "SELECT assessment_id, CASE severity WHEN 'critical' THEN 3 WHEN 'major' THEN 4 ELSE 5 END, seq, '   • Q' || question_id || ': ' || description || chr(10) || '     → ' || suggestion FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY assessment_id, severity ORDER BY question_id, issue_type, description) seq FROM all_issues) WHERE seq <= {shown}"
    )
    return " UNION ALL ".join(parts)


add("quality_report", lambda s, d: flat(validation.report_lines(dirty(s, d))), V, report_sql())

# --- duplicates ----------------------------------------------------------------------

add(
    "normalize_text",
    lambda s, d: bank(s, d).select(*K, dedupe.tx.normalize_text(F.col("question_text")).alias("normalized")),
    B,
    f"SELECT {KS}, trim(regexp_replace(lower(question_text), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS normalized FROM bank",
)
add(
    "near_duplicates",
    lambda s, d: dedupe.near_duplicates(bank(s, d)).withColumn("similarity", F.round("similarity", 6)),
    B + [NEAR],
    "SELECT assessment_id, question_index, near_index, round(similarity, 6) AS similarity, rep_index FROM near",
)
# questions that resemble another are gone through in order, with the list of those accepted; copies never are
add(
    "greedy_admit",
    lambda s, d: dedupe.greedy_admit(scoring.gated(bank(s, d))),
    B + [S.GATE, NEAR.replace("FROM bank)", "FROM gate WHERE passed >= 5)"), """
edge AS (SELECT assessment_id, question_index, list(near_index) AS nears FROM near WHERE similarity < 1 GROUP BY 1, 2),
linked AS (SELECT assessment_id, question_index FROM near WHERE similarity < 1 UNION SELECT assessment_id, near_index FROM near WHERE similarity < 1),
line AS (SELECT l.*, e.nears, row_number() OVER (PARTITION BY l.assessment_id ORDER BY l.question_index) AS k FROM linked l LEFT JOIN edge e ON e.assessment_id = l.assessment_id AND e.question_index = l.question_index),
walk AS (SELECT assessment_id, 1 AS k, [question_index] AS taken FROM line WHERE k = 1 UNION ALL
  SELECT w.assessment_id, w.k + 1, CASE WHEN list_has_any(w.taken, coalesce(l.nears, [])) THEN w.taken ELSE list_append(w.taken, l.question_index) END FROM walk w JOIN line l ON l.assessment_id = w.assessment_id AND l.k = w.k + 1)"""],
    "SELECT r.assessment_id, r.question_index FROM reps r WHERE question_index = rep AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.assessment_id = r.assessment_id AND l.question_index = r.question_index) "
    "UNION ALL SELECT assessment_id, unnest(arg_max(taken, k)) AS question_index FROM walk GROUP BY 1",
)


add(
    "used_concepts",
    lambda s, d: dedupe.concept_states(scoring.checked(bank(s, d))),
    B + [S.GATE],
    "SELECT DISTINCT assessment_id, concept, 'used' AS state FROM gate WHERE passed >= 5 AND concept <> '' UNION ALL "
    "(SELECT assessment_id, concept, 'free' FROM gate WHERE passed < 5 AND concept <> '' EXCEPT SELECT assessment_id, concept, 'free' FROM gate WHERE passed >= 5)",
)

# --- maps and views --------------------------------------------------------------------

types_case = "CASE perspective " + " ".join(f"WHEN {S.lit(k)} THEN {S.lit(' | '.join(v))}" for k, v in lx.PERSPECTIVE_TYPES.items()) + " END"
add(
    "perspective_map",
    lambda s, d: flat(
        bank(s, d).select(*K, "perspective", rules.perspective_bloom(F.col("perspective")).alias("bloom"), rules.perspective_types(F.col("perspective")).alias("question_types"))
    ),
    B,
    f"SELECT {KS}, perspective, {S.lookup('perspective', lx.PERSPECTIVE_BLOOM, 'understand')} AS bloom, {types_case} AS question_types FROM bank",
)
add(
    "options_pivot",
    lambda s, d: bank(s, d).select(*K, F.explode(rules.options_pivot()).alias("letter", "o")).select(*K, "letter", "o.*"),
    B,
    f"""SELECT {KS}, chr(CAST(65 + i AS INTEGER)) AS letter, CASE WHEN i = 0 THEN correct_answer ELSE distractors[i].text END AS text, i = 0 AS is_correct,
  CASE WHEN i = 0 THEN coalesce(nullif(explanation, ''), {S.lit(lx.OPTION_DEFAULTS['why_correct'])}) ELSE coalesce(nullif(distractors[i].explanation, ''), {S.lit(lx.OPTION_DEFAULTS['why_wrong'])}) END AS explanation,
  CASE WHEN i > 0 THEN coalesce(nullif(distractors[i].misconception_type, ''), {S.lit(lx.OPTION_DEFAULTS['misconception'])}) END AS misconception_name,
  CASE WHEN i = 0 THEN {S.lit(lx.OPTION_DEFAULTS['key_points'])} END AS key_points, CASE WHEN i = 0 THEN {S.lit(lx.OPTION_DEFAULTS['example'])} END AS real_world_example,
  CASE WHEN i = 0 THEN {S.lit(lx.OPTION_DEFAULTS['connects'])} END AS connects_to,
  CASE WHEN i > 0 THEN 'Students often select this due to ' || coalesce(nullif(distractors[i].misconception_type, ''), 'surface-level understanding') || '.' END AS why_students_think_this,
  CASE WHEN i > 0 THEN {S.lit(lx.OPTION_DEFAULTS['understanding'])} END AS correct_understanding, CASE WHEN i > 0 THEN {S.lit(lx.OPTION_DEFAULTS['remember'])} END AS remember_this
  FROM (SELECT *, unnest(range(0, len(distractors) + 1)) i FROM bank)""",
)
REASONS = {"no_placeholder": "placeholder found", "option_length": "option length issue", "distractors_ok": "distractor too short"}


def guidance(s, d):
    checks = rules.six_checks()
    reasons = F.array_join(F.array_compact(F.array(*[F.when(~checks[n], F.lit(t)) for n, t in REASONS.items()])), "; ")
    return bank(s, d).select(*K, reasons.alias("reasons")).withColumn("guidance", rules.retry_hints(F.col("reasons")))


hints = " || ".join(
    f"CASE WHEN contains(reasons, {S.lit(w)}) THEN {S.lit(chr(10).join(t) + chr(10))} ELSE '' END" for w, t in lx.RETRY_HINTS
)
add(
    "failure_guidance",
    guidance,
    B + [S.GATE],
    f"SELECT {KS}, reasons, CASE WHEN h = '' THEN {S.lit(lx.RETRY_DEFAULT)} ELSE left(h, length(h) - 1) END AS guidance FROM (SELECT *, {hints} h FROM "
    f"(SELECT *, {S.join(S.issues(*[(f'NOT {n}', S.lit(t)) for n, t in REASONS.items()]), '; ')} AS reasons FROM gate))",
)


def constraint_rows(s, d):
    q = validation.constrain(bank(s, d), validation.question_constraints()).select(
        F.lit("question").alias("record"), F.col("assessment_id").alias("record_id"), F.col("question_index").alias("part"), "errors", "valid"
    )
    i = F.col("doc_id")
    requests = load(s, d, "documents").select(
        i.alias("record_id"),
        (i % 55).alias("num_questions"),
        (i % 20).alias("easy_quota"), F.lit(3).alias("medium_quota"), (i % 9).alias("hard_quota"),
        (i % 4).alias("page_num"), (i % 100).alias("start_char"), (i % 70 + 20).alias("end_char"),
        ((i % 12) / 10.0).alias("progress"), (i % 2100).alias("chunk_size"), (i % 300).alias("chunk_overlap"), (i % 120).alias("max_file_mb"),
    )
    r = validation.constrain(requests, validation.request_constraints()).select(
        F.lit("request").alias("record"), "record_id", F.lit(0).cast("bigint").alias("part"), "errors", "valid"
    )
    return flat(q.unionByName(r))


_qc = {
    "question_text_min_length": "length(question_text) >= 10", "question_text_not_blank": "trim(question_text) <> ''",
    "correct_answer_not_blank": "trim(correct_answer) <> ''", "explanation_not_blank": "trim(explanation) <> ''",
    "distractor_count": "len(distractors) BETWEEN 1 AND 4", "distractor_text_not_blank": "len([x FOR x IN distractors IF trim(x.text) = '']) = 0",
    "distractor_type_not_blank": "len([x FOR x IN distractors IF trim(x.misconception_type) = '']) = 0",
    "difficulty_domain": "difficulty IN ('easy', 'medium', 'hard')", "question_type_domain": "question_type IN ('multiple_choice', 'true_false', 'short_answer')",
    "option_keys": "len(distractors) >= 3", "correct_position_domain": "correct_position IN ('A', 'B', 'C', 'D')",
}
_rc = {
    "num_questions_1_20": "i % 55 BETWEEN 1 AND 20", "num_questions_1_50": "i % 55 BETWEEN 1 AND 50", "mix_sums_to_total": "i % 20 + 3 + i % 9 = i % 55",
    "page_num_positive": "i % 4 >= 1", "end_after_start": "i % 70 + 20 > i % 100", "progress_0_1": "(i % 12) / 10 BETWEEN 0 AND 1",
    "chunk_size_1_2000": "i % 2100 BETWEEN 1 AND 2000", "overlap_below_size": "i % 300 < i % 2100", "max_file_size_1_100": "i % 120 BETWEEN 1 AND 100",
}


def errs(checks: dict) -> str:
    return S.issues(*[(f"NOT ({c})", S.lit(n)) for n, c in checks.items()])


add(
    "record_constraints",
    constraint_rows,
    B,
    f"SELECT record, record_id, part, {S.join('e')} AS errors, len(e) = 0 AS valid FROM (SELECT 'question' AS record, assessment_id AS record_id, question_index AS part, {errs(_qc)} e FROM bank "
    f"UNION ALL SELECT 'request', i, 0, {errs(_rc)} FROM (SELECT doc_id i FROM documents))",
)

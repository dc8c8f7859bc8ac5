"""Registered queries on per-question scores and assessment statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import rules
from quizmill.operators import frequent, scoring, stats
from quizmill.plans import sql as S
from quizmill.plans.common import bank, flat, scored
from quizmill.sources import bridge

K = ["assessment_id", "question_index"]
KS = "assessment_id, question_index"
QUERIES: dict = {}
ORACLES: dict = {}


def scored_query(name: str, *columns: str, sql_columns: str | None = None):
    QUERIES[name] = lambda spark, d: flat(scored(spark, d), *K, *columns)
    body = sql_columns or ", ".join(columns)
    ORACLES[name] = S.query([S.BANK, S.SCORED], f"SELECT {KS}, {body} FROM scored")


def add(name: str, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body)


BS = [S.BANK, S.SCORED]
B = [S.BANK]

scored_query("readability", "flesch_score", "grade_level", "readability_score", "appropriate")
scored_query("readability_level", "readability_level")
scored_query("distractor_quality", "strong_count", "weak_count", "average_closeness", "distractor_diversity", "distractor_score")
scored_query("distractor_issues", "distractor_issues", sql_columns=f"{S.join('distractor_issues')} AS distractor_issues")
scored_query("bloom_level", "bloom_level", "cognitive_score")
scored_query("clarity", "clarity_issues", "clarity_score", sql_columns=f"{S.join('clarity_issues')} AS clarity_issues, clarity_score")
scored_query("difficulty_predict", "predicted_score", "predicted_level")
scored_query("language_quality", "language_issues", "language_score", sql_columns=f"{S.join('language_issues')} AS language_issues, language_score")
scored_query("quality_score", "overall_score")
scored_query("quality_grade", "overall_score", "quality_grade")
scored_query("recommendations", "recommendations", sql_columns=f"{S.join('recommendations')} AS recommendations")

found = S.present("lower(question_text)", lx.DOMAIN_CONCEPTS)
add(
    "concept_focus",
    lambda s, d: flat(
        bank(s, d).withColumn("concepts", rules.concepts()).select(
            *K, "concepts", F.size("concepts").alias("concept_count"),
            (F.size("concepts") >= 1).alias("focused"),
            F.coalesce(F.get("concepts", F.lit(0)), F.lit("general")).alias("primary_concept"),
        )
    ),
    B,
    f"SELECT {KS}, {S.join('c')} AS concepts, len(c) AS concept_count, len(c) >= 1 AS focused, coalesce(c[1], 'general') AS primary_concept "
    f"FROM (SELECT *, {found} c FROM bank)",
)
add(
    "basic_analysis",
    lambda s, d: flat(scoring.basic_scores(bank(s, d))),
    BS,
    f"SELECT {KS}, 0.7e0 AS readability_score, strong_count, average_closeness, 0.7e0 AS distractor_score, 'understand' AS bloom_level, "
    f"0.7e0 AS cognitive_score, 0.8e0 AS clarity_score, 0.7e0 AS overall_score, 'B' AS quality_grade, {S.lit(lx.BASIC_ADVICE)} AS recommendations FROM scored",
)

# --- assessment statistics --------------------------------------------------------

grades = [g for _, g in lx.GRADE_BANDS] + [lx.GRADE_LAST]
grade_cols = ", ".join(
    f"count(*) FILTER (quality_grade = {S.lit(g)}) AS grade_{g.replace('+', '_plus').replace('-', '_minus').lower()}" for g in grades
)
OVERVIEW = f"""
ov AS (SELECT assessment_id, count(*) AS total_questions, avg(overall_score) m,
  count(*) FILTER (quality_grade IN ({', '.join(S.lit(g) for g in lx.HIGH_GRADES)})) AS high_quality_questions, {grade_cols} FROM scored GROUP BY 1),
overview AS (SELECT * EXCLUDE (m), {S.r3('m')} AS average_quality_score, {S.bands('round(m, 9)', lx.GRADE_BANDS, lx.GRADE_LAST)} AS overall_grade,
  CAST(round(CAST(high_quality_questions * 100 / total_questions AS DECIMAL(18, 9)), 1) AS DOUBLE) AS high_quality_percentage FROM ov)
"""
BALANCE = f"""
db AS (SELECT assessment_id, count(*) n, count(*) FILTER (difficulty = 'easy') AS easy_count, count(*) FILTER (difficulty = 'medium') AS medium_count,
  count(*) FILTER (difficulty = 'hard') AS hard_count FROM bank GROUP BY 1),
balance AS (SELECT assessment_id, easy_count, medium_count, hard_count, CAST(round(CAST(easy_count * 100 / n AS DECIMAL(18, 9)), 1) AS DOUBLE) AS easy_percent,
  CAST(round(CAST(medium_count * 100 / n AS DECIMAL(18, 9)), 1) AS DOUBLE) AS medium_percent, CAST(round(CAST(hard_count * 100 / n AS DECIMAL(18, 9)), 1) AS DOUBLE) AS hard_percent,
  {S.r3('1 - (abs(easy_count / n - 0.3e0) + abs(medium_count / n - 0.5e0) + abs(hard_count / n - 0.2e0)) / 2')} AS balance_score,
  round(1 - (abs(easy_count / n - 0.3e0) + abs(medium_count / n - 0.5e0) + abs(hard_count / n - 0.2e0)) / 2, 9) > 0.8e0 AS well_balanced FROM db)
"""
DISTRIBUTION = f"""
distribution AS (SELECT assessment_id, {S.r3('avg(overall_score)')} AS mean, {S.r3('quantile_cont(overall_score, 0.5e0)')} AS median,
  {S.r3('coalesce(stddev_samp(overall_score), 0)')} AS std_dev, {S.r3('min(overall_score)')} AS min_score, {S.r3('max(overall_score)')} AS max_score,
  {S.r3('quantile_cont(overall_score, 0.25e0)')} AS q1, {S.r3('quantile_cont(overall_score, 0.75e0)')} AS q3 FROM scored GROUP BY 1)
"""


def terms_sql(prefix: str, bigrams: bool, keep: int | None) -> str:
    stop = "(" + ", ".join(S.lit(w) for w in lx.STOP_WORDS) + ")"
    pairs = "[w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]"
    terms = f"list_concat(w, {pairs})" if bigrams else "w"
    limit = f"QUALIFY row_number() OVER (PARTITION BY assessment_id ORDER BY cf DESC, term) <= {keep}" if keep else ""
    p = prefix
    return f"""
{p}w AS (SELECT assessment_id, question_index, [t FOR t IN regexp_extract_all(lower(question_text), '[\\p{{L}}\\p{{N}}_]{{2,}}') IF t NOT IN {stop}] w FROM bank),
{p}tf AS (SELECT assessment_id, question_index, term, count(*) tf FROM (SELECT assessment_id, question_index, unnest({terms}) term FROM {p}w) GROUP BY 1, 2, 3),
{p}n AS (SELECT assessment_id, count(*) n FROM bank GROUP BY 1),
{p}df AS (SELECT assessment_id, term, sum(tf) cf, count(*) df FROM {p}tf GROUP BY 1, 2 {limit}),
{p}raw AS (SELECT t.assessment_id, question_index, t.term, tf * (ln((1 + n) / (1 + df)) + 1) wt FROM {p}tf t
  JOIN {p}df d ON d.assessment_id = t.assessment_id AND d.term = t.term JOIN {p}n s ON s.assessment_id = t.assessment_id),
{p}weight AS (SELECT assessment_id, question_index, term, wt / sqrt(sum(wt * wt) OVER (PARTITION BY assessment_id, question_index)) wt FROM {p}raw)
"""


COVERAGE = terms_sql("c", True, 50) + """,
cov_s AS (SELECT assessment_id, term, round(sum(wt), 9) s FROM cweight GROUP BY 1, 2),
coverage AS (SELECT assessment_id, row_number() OVER (PARTITION BY assessment_id ORDER BY s DESC, term) AS term_rank, term AS concept,
  round(s, 3) AS score, count(*) OVER (PARTITION BY assessment_id) AS concept_diversity,
  CASE WHEN count(*) OVER (PARTITION BY assessment_id) >= 5 THEN 'good' ELSE 'limited' END AS coverage FROM cov_s QUALIFY term_rank <= 10)
"""
DIVERSITY = terms_sql("d", False, None) + f""",
div_v AS (SELECT a.assessment_id, sum(a.wt * b.wt) sq FROM dweight a JOIN dweight b ON a.assessment_id = b.assessment_id AND a.term = b.term GROUP BY 1),
div_c AS (SELECT b.assessment_id, count(DISTINCT question_type) types, count(*) n, any_value(sq) sq FROM bank b LEFT JOIN div_v v ON v.assessment_id = b.assessment_id GROUP BY 1),
div_r AS (SELECT assessment_id, round(types / n, 9) t, round(CASE WHEN sq IS NULL OR n < 2 THEN 0.5e0 ELSE 1 - (sq - n) / greatest(n * (n - 1), 1) END, 9) c FROM div_c),
diversity AS (SELECT assessment_id, round(t, 3) AS type_diversity, round(c, 3) AS content_diversity, {S.r3('(t + c) / 2')} AS overall_diversity,
  CASE WHEN c > 0.7e0 THEN 'high' WHEN c > 0.4e0 THEN 'medium' ELSE 'low' END AS diversity_level FROM div_r)
"""
MISCONCEPTIONS = """
mis_c AS (SELECT assessment_id, misconception_type, count(*) uses FROM (SELECT assessment_id, unnest([d.misconception_type FOR d IN distractors]) AS misconception_type FROM bank) GROUP BY 1, 2)
"""
_aa = lx.ASSESSMENT_ADVICE
ADVICE = f"""
iss AS (SELECT assessment_id, issue, count(*) hits FROM (SELECT assessment_id, unnest(list_concat(list_concat(clarity_issues, distractor_issues), language_issues)) issue FROM scored) GROUP BY 1, 2),
iss_r AS (SELECT *, row_number() OVER (PARTITION BY assessment_id ORDER BY hits DESC, issue) rk FROM iss QUALIFY rk <= 3),
adv_a AS (SELECT assessment_id, count(*) n, count(*) FILTER (overall_score < 0.6e0) low, count(*) FILTER (predicted_level = 'EASY') easy,
  count(*) FILTER (predicted_level = 'HARD') hard, count(DISTINCT bloom_level) levels FROM scored GROUP BY 1),
adv_c AS (SELECT i.assessment_id, list({S.lit(_aa['issue'])} || issue ORDER BY rk) common FROM iss_r i JOIN adv_a a ON a.assessment_id = i.assessment_id WHERE hits > n * 0.3e0 GROUP BY 1),
advice AS (SELECT a.assessment_id, array_to_string(list_concat({S.issues(
    ("low > 0", S.lit(_aa['low'][0]) + " || low || " + S.lit(_aa['low'][1])), ("easy / n > 0.5e0", S.lit(_aa['easy'])),
    ("easy / n <= 0.5e0 AND hard / n > 0.4e0", S.lit(_aa['hard'])), ("levels < 3", S.lit(_aa['levels'])))},
  coalesce(common, [])), ' | ') AS recommendations FROM adv_a a LEFT JOIN adv_c c ON c.assessment_id = a.assessment_id)
"""
SCORE = f"""
asc_a AS (SELECT assessment_id, avg(overall_score) m, stddev_samp(overall_score) s, count(*) n, count(DISTINCT bloom_level) l FROM scored GROUP BY 1),
ascore AS (SELECT assessment_id, {S.r3("least(1e0, m + CASE WHEN n > 1 THEN greatest(0e0, (0.2e0 - s) * 0.5e0) ELSE 0e0 END + CASE WHEN l >= 3 THEN 0.05e0 ELSE 0e0 END)")} AS quality_score FROM asc_a)
"""

add("assessment_overview", lambda s, d: flat(stats.overview(scored(s, d))), BS + [OVERVIEW], "SELECT * FROM overview")
add("quality_distribution", lambda s, d: flat(stats.score_distribution(scored(s, d))), BS + [DISTRIBUTION], "SELECT * FROM distribution")
add("difficulty_balance", lambda s, d: flat(stats.difficulty_balance(bank(s, d))), B + [BALANCE], "SELECT * FROM balance")
add("concept_coverage", lambda s, d: flat(stats.concept_coverage(bank(s, d, placed=True))), B + [COVERAGE], "SELECT * FROM coverage")
add("content_diversity", lambda s, d: flat(stats.content_diversity(bank(s, d, placed=True))), B + [DIVERSITY], "SELECT * FROM diversity")
add(
    "misconception_usage",
    lambda s, d: flat(stats.misconception_usage(bank(s, d))),
    B + [MISCONCEPTIONS],
    "SELECT assessment_id, row_number() OVER (PARTITION BY assessment_id ORDER BY uses DESC, misconception_type) AS use_rank, misconception_type, uses, "
    "CAST(sum(uses) OVER (PARTITION BY assessment_id) AS BIGINT) AS total_distractors, count(*) OVER (PARTITION BY assessment_id) AS unique_misconceptions, "
    "round(count(*) OVER (PARTITION BY assessment_id) / sum(uses) OVER (PARTITION BY assessment_id), 6) AS diversity_score FROM mis_c QUALIFY use_rank <= 5",
)
add(
    "frequent_concepts",
    lambda s, d: flat(frequent.top_values(bank(s, d).select("source_file", "concept"), "concept", ["source_file"], 10)),
    B,
    "SELECT source_file, concept, count(*) AS uses, row_number() OVER (PARTITION BY source_file ORDER BY count(*) DESC, concept) AS rank FROM bank WHERE concept IS NOT NULL GROUP BY source_file, concept QUALIFY rank <= 10",
)
add(
    "frequent_misconceptions",
    lambda s, d: flat(frequent.top_values(bank(s, d).select(F.explode("distractors.misconception_type").alias("misconception_type")), "misconception_type", [], 3)),
    B,
    "SELECT m AS misconception_type, count(*) AS uses, row_number() OVER (ORDER BY count(*) DESC, m) AS rank FROM (SELECT unnest(distractors).misconception_type AS m FROM bank) GROUP BY m QUALIFY rank <= 3",
)
add(
    "assessment_recommendations",
    lambda s, d: flat(stats.assessment_advice(scored(s, d))),
    BS + [ADVICE],
    "SELECT * FROM advice",
)
add("assessment_score", lambda s, d: flat(stats.assessment_score(scored(s, d))), BS + [SCORE], "SELECT * FROM ascore")
BIAS = """
bias_a AS (SELECT assessment_id, count(*) n, count(*) FILTER (correct_position = 'A') a, count(*) FILTER (correct_position = 'B') b,
  count(*) FILTER (correct_position = 'C') c, count(*) FILTER (correct_position = 'D') d, count(DISTINCT difficulty) variety FROM bank GROUP BY 1),
bias AS (SELECT assessment_id, round(a / n, 6) AS share_a, round(b / n, 6) AS share_b, round(c / n, 6) AS share_c, round(d / n, 6) AS share_d,
  round(greatest(a, b, c, d) / n, 6) AS max_share, greatest(a, b, c, d) / n > 0.4e0 AS bias_detected FROM bias_a)
"""
add("position_bias", lambda s, d: flat(stats.share_bias(bank(s, d))), B + [BIAS], "SELECT * FROM bias")
add(
    "difficulty_variety",
    lambda s, d: flat(stats.difficulty_variety(bank(s, d))),
    B,
    "SELECT assessment_id, count(*) AS total_questions, count(DISTINCT difficulty) AS variety_score, "
    + ", ".join(f"round(count(*) FILTER (difficulty = '{k}') / count(*), 6) AS share_{k}" for k in ("easy", "medium", "hard"))
    + " FROM bank GROUP BY 1",
)
add(
    "full_assessment_analysis",
    lambda s, d: flat(stats.full_analysis(scored(s, d, placed=True))),
    BS + [OVERVIEW, DISTRIBUTION, BALANCE, COVERAGE, DIVERSITY, ADVICE, SCORE, MISCONCEPTIONS],
    """SELECT assessment_id, o.total_questions, o.average_quality_score, o.overall_grade, o.high_quality_percentage, median, std_dev, balance_score, well_balanced,
  content_diversity, quality_score, recommendations, coalesce(top_concepts, '') AS top_concepts, coalesce(unique_misconceptions, 0) AS unique_misconceptions
  FROM overview o JOIN distribution USING (assessment_id) JOIN balance USING (assessment_id) JOIN diversity USING (assessment_id) JOIN ascore USING (assessment_id)
  JOIN advice USING (assessment_id) LEFT JOIN (SELECT assessment_id, string_agg(concept, ', ' ORDER BY term_rank) AS top_concepts FROM coverage GROUP BY 1) USING (assessment_id)
  LEFT JOIN (SELECT assessment_id, count(*) AS unique_misconceptions FROM mis_c GROUP BY 1) USING (assessment_id)""",
)
_sa = lx.SYSTEM_ADVICE
SYSTEM = S.issues(("success_rate < 0.8e0", S.lit(_sa["success"])), ("generation_time > 60", S.lit(_sa["time"])), ("average_quality_score < 0.6e0", S.lit(_sa["quality"])))
add(
    "system_recommendations",
    lambda s, d: flat(bridge.session_rows(s, d).select("event_id", "task_id", stats.system_advice().alias("recommendations"))),
    [S.SESSIONS],
    f"SELECT event_id, task_id, {S.join(SYSTEM)} AS recommendations FROM session_rows",
)
add(
    "quality_alerts",
    lambda s, d: flat(stats.quality_alerts(stats.overview(scored(s, d)), stats.difficulty_balance(bank(s, d)))),
    BS + [OVERVIEW, BALANCE],
    "SELECT assessment_id, 'warning' AS level, 'Only ' || format('{:.1f}', high_quality_percentage) || '% of questions are high quality' AS message FROM overview WHERE high_quality_percentage < 50 "
    "UNION ALL SELECT assessment_id, 'info', 'Difficulty distribution is not well balanced' FROM balance WHERE NOT well_balanced",
)
add(
    "chart_series",
    lambda s, d: flat(stats.chart_series(scored(s, d))),
    BS + [MISCONCEPTIONS],
    "SELECT assessment_id, 'quality' AS chart, left(quality_grade, 1) AS label, count(*) AS value FROM scored GROUP BY 1, 3 "
    "UNION ALL SELECT assessment_id, 'difficulty', difficulty, count(*) FROM scored GROUP BY 1, 3 "
    "UNION ALL SELECT assessment_id, 'misconception', misconception_type, uses FROM mis_c",
)
UI = """
ui AS (SELECT *, round(least(1e0, 0.3e0 + CASE WHEN length(trim(question_text)) > 20 THEN 0.15e0 ELSE 0e0 END
  + CASE WHEN length(trim(explanation)) > 10 THEN 0.15e0 ELSE 0e0 END + CASE WHEN len(distractors) = 3 THEN 0.1e0 ELSE 0e0 END + 0.2e0
  + CASE WHEN len(distractors) >= 2 THEN 0.1e0 ELSE 0e0 END), 6) AS ui_score FROM bank)
"""


def ui(s, d):
    return bank(s, d).withColumn("ui_score", rules.ui_quality())


add("ui_quality_score", lambda s, d: flat(ui(s, d), *K, "ui_score"), B + [UI], f"SELECT {KS}, ui_score FROM ui")
add(
    "ui_strong_distractors",
    lambda s, d: flat(
        bank(s, d).groupBy("assessment_id").agg(
            F.sum(F.least(F.size("distractors"), F.lit(3))).alias("strong"),
            F.sum(F.least(F.size("distractors"), F.lit(3)) + 1).alias("structured"),
        ).select("assessment_id", "strong", "structured", F.round(F.col("strong") * 100 / F.col("structured")).cast("bigint").alias("strong_percent"))
    ),
    B,
    "SELECT assessment_id, CAST(sum(least(len(distractors), 3)) AS BIGINT) AS strong, CAST(sum(least(len(distractors), 3) + 1) AS BIGINT) AS structured, "
    "CAST(round(sum(least(len(distractors), 3)) * 100 / sum(least(len(distractors), 3) + 1)) AS BIGINT) AS strong_percent FROM bank GROUP BY 1",
)
add(
    "quality_bins",
    lambda s, d: flat(stats.quality_bins(ui(s, d), "ui_score")),
    B + [UI],
    "SELECT assessment_id, CASE WHEN ui_score <= 0.5e0 THEN 'low' WHEN ui_score <= 0.8e0 THEN 'medium' ELSE 'high' END AS bin, count(*) AS questions FROM ui GROUP BY 1, 2",
)
add(
    "low_quality_list",
    lambda s, d: flat(stats.low_quality(scored(s, d), "overall_score")),
    BS,
    "SELECT assessment_id, question_index + 1 AS question_number, overall_score AS score, left(question_text, 100) AS preview FROM scored WHERE overall_score < 0.7e0 ORDER BY score, assessment_id, question_number",
)
add(
    "concept_set",
    lambda s, d: flat(stats.concept_sets(bank(s, d))),
    B,
    "SELECT assessment_id, concept_name, count(*) AS mentions FROM (SELECT assessment_id, unnest(list_concat([concept], "
    f"[upper(left(w, 1)) || substr(w, 2) FOR w IN {S.present('lower(question_text)', lx.UI_CONCEPTS)}])) AS concept_name FROM bank) WHERE concept_name <> '' GROUP BY 1, 2",
)
add(
    "series_decimate",
    lambda s, d: flat(stats.decimate(scored(s, d).select(*K, "overall_score"), 10)),
    BS,
    f"SELECT {KS}, overall_score FROM (SELECT *, count(*) OVER (PARTITION BY assessment_id) n FROM scored) WHERE question_index % CAST(ceil(n / 10) AS BIGINT) = 0",
)
PIPE_TEXT = "lower(concat_ws(chr(10), question_text, array_to_string(" + S.OPTION_TEXTS + ", chr(10)), explanation, array_to_string([d.explanation FOR d IN distractors], chr(10))))"
add(
    "pipeline_quality_metrics",
    lambda s, d: flat(stats.pipeline_metrics(bank(s, d))),
    B,
    f"""SELECT *, CASE WHEN placeholder_count + short_options_count + duplicate_questions = 0 THEN 'excellent'
  WHEN placeholder_count + short_options_count + duplicate_questions <= 2 THEN 'good'
  WHEN placeholder_count + short_options_count + duplicate_questions <= 5 THEN 'fair' ELSE 'poor' END AS verdict FROM (
  SELECT assessment_id, count(*) AS total_questions, count(*) - count(DISTINCT question_text) AS duplicate_questions,
  count(*) FILTER ({S.any_word('t', lx.REPORT_PLACEHOLDERS)}) AS placeholder_count, CAST(sum(len([k FOR k IN ow IF k < 3])) AS BIGINT) AS short_options_count,
  round(sum(list_sum(ow)) / sum(len(ow)), 6) AS avg_option_length, count(*) FILTER (difficulty = 'easy') AS easy_questions,
  count(*) FILTER (difficulty = 'medium') AS medium_questions, count(*) FILTER (difficulty = 'hard') AS hard_questions,
  count(*) FILTER (correct_position = 'A') AS position_a, count(*) FILTER (correct_position = 'B') AS position_b,
  count(*) FILTER (correct_position = 'C') AS position_c, count(*) FILTER (correct_position = 'D') AS position_d
  FROM (SELECT *, {PIPE_TEXT} t, {S.words_of(S.OPTION_TEXTS3)} ow FROM bank) GROUP BY 1)""",
)

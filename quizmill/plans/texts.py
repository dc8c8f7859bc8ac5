"""Registered queries on page texts, elements and chunks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import text as tx
from quizmill.operators import chunking as ch
from quizmill.operators import finders
from quizmill.plans import sql as S
from quizmill.plans.common import flat
from quizmill.session import load
from quizmill.sources import bridge

QUERIES: dict = {}
ORACLES: dict = {}
P = [S.PAGES]
DP = "doc_id, page_num"


def add(name, fn, ctes=None, body=None):
    QUERIES[name] = fn
    if body:
        ORACLES[name] = S.query(ctes, body)


def pages(s, d):
    return bridge.doc_pages(s, d)


def docs(s, d):
    return load(s, d, "documents").select("doc_id", "text")


STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def tidy(x: str) -> str:
    for pattern, repl in [
        (r"\s+", " "), (r"([a-z])([A-Z])", r"\1 \2"), (r"(\d)([A-Za-z])", r"\1 \2"), (r"([.!?])([A-Z])", r"\1 \2"), (r"•\s*", "• "), (r"(\d+)\.\s*", r"\1. "),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{repl}', 'g')"
    return x


def marked(x: str, pattern: str) -> str:
    return f"string_split(regexp_replace({x}, {S.lit('(' + pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1))"


CLEAN = f"""
cl_m AS (SELECT doc_id, page_num, {marked('text', S.EQ_RE + '|' + S.CODE_RE)} m FROM doc_pages),
cleaned AS (SELECT doc_id, page_num, {STRIP.format(f"array_to_string(list_transform(m, lambda p, i: CASE WHEN i = 1 THEN {tidy('p')} ELSE split_part(p, chr(2), 1) || {tidy('split_part(p, chr(2), 2)')} END), '')")} AS text FROM cl_m)
"""
add("scan_pages", pages, P, f"SELECT {DP}, text FROM doc_pages")
ENT = "t"
for e, c in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
    ENT = f"replace({ENT}, {S.lit(e)}, {S.lit(c)})"


def html_strip(x: str) -> str:
    t = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    return f"trim(regexp_replace({ENT.replace('(t,', '(' + t + ',', 1)}, '\\s+', ' ', 'g'))"


add(
    "scan_html_pages",
    lambda s, d: load(s, d, "pages").select("page_id", "url", tx.html_text(F.col("html")).alias("text")),
    [
        "ht AS (SELECT page_id, url, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>', ' ', 'g') p FROM pages)",
        f"hx AS (SELECT page_id, url, {html_strip(chr(114) + 'egexp_extract(p, ' + S.lit('(?is)<article[^>]*>(.*)</article>') + ', 1)')} a, {html_strip('p')} b FROM ht)",
    ],
    "SELECT page_id, url, CASE WHEN a <> '' THEN a ELSE b END AS text FROM hx",
)
add("clean_text", lambda s, d: ch.clean_pages(pages(s, d)), P + [CLEAN], f"SELECT {DP}, text FROM cleaned")
TITLES = f"[l FOR l IN [{STRIP.format('x')} FOR x IN string_split(text, chr(10))] IF l <> '' AND {S.matches('l', S.SECTION_RE)}]"
add(
    "page_features",
    lambda s, d: flat(ch.page_features(ch.clean_pages(pages(s, d)))),
    P + [CLEAN],
    f"SELECT {DP}, {S.wc('text')} AS word_count, length(text) AS char_count, {S.matches('text', S.EQ_RE)} AS has_equations, {S.matches('text', S.CODE_RE)} AS has_code, "
    f"{S.join(TITLES)} AS section_titles, round({S.wc('text')} / (length(text) - length(replace(text, chr(10), '')) + 1), 6) AS content_density FROM cleaned",
)


def all_matches(x: str, patterns, flags: str) -> str:
    parts = [f"regexp_extract_all({x}, {S.lit(f'(?{flags})' + S.unicode_words(p))})" for p in patterns]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


for name, patterns, flags in [("find_equations", lx.EQUATION_PATTERNS, "si"), ("find_code_blocks", lx.CODE_PATTERNS, "s")]:
    add(
        name,
        lambda s, d, patterns=patterns, flags=flags: flat(
            pages(s, d).select("doc_id", "page_num", tx.matches(F.col("text"), patterns, flags).alias("found")).select(
                "doc_id", "page_num", F.size("found").alias("matches"), "found"
            )
        ),
        P,
        f"SELECT {DP}, len(f) AS matches, {S.join('f')} AS found FROM (SELECT {DP}, {all_matches('text', patterns, flags)} f FROM doc_pages)",
    )

# --- elements with positions ----------------------------------------------------------


def spans_sql(x: str, named, flags: str) -> str:
    """List of {start_pos, end_pos, kind, ord, full_match}, pattern after pattern."""
    parts = []
    for i, (name, p) in enumerate(named):
        m = marked(x, f"(?{flags}:{S.unicode_words(p)})")
        parts.append(
            f"list_transform(range(2, len({m}) + 1), lambda i: {{'start_pos': CAST(list_sum([length(y) FOR y IN ({m})[1:i - 1]]) AS BIGINT) - (i - 2), 'kind': {S.lit(name)}, 'ord': {i}, "
            f"'full_match': split_part(({m})[i], chr(2), 1)}})"
        )
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def spans_cte(prefix: str, named, flags: str, source: str = "doc_pages") -> str:
    return (
        f"{prefix}_u AS (SELECT {DP}, unnest({spans_sql('text', named, flags)}) e FROM {source}),\n"
        f"{prefix} AS (SELECT {DP}, e.start_pos AS start_pos, e.start_pos + length(e.full_match) AS end_pos, e.kind AS kind, e.ord AS ord, e.full_match AS full_match FROM {prefix}_u)"
    )


FIG = [("figure_reference", p) for p in lx.FIGURE_PATTERNS]
TAB = [("text_pattern_table", p) for p in lx.TABLE_PATTERNS]
EQS = spans_cte("eqs", lx.NAMED_EQUATIONS, "si")
FIGS = spans_cte("figs", FIG, "i")
CODES = spans_cte("codes", lx.NAMED_CODE, "sm")
TABS = spans_cte("tabs", TAB, "m")
content = "CASE kind " + " ".join(
    f"WHEN {S.lit(n)} THEN regexp_extract(full_match, {S.lit(f'(?si:{S.unicode_words(p)})')}, 1)" for n, p in lx.NAMED_EQUATIONS
) + " END"
add(
    "detect_equations",
    lambda s, d: ch.detect_equations(pages(s, d)).drop("ord"),
    P + [EQS],
    f"SELECT {DP}, start_pos, end_pos, kind, full_match, {content} AS content FROM eqs",
)
NAMED = [(name, re.compile(p, re.DOTALL | re.IGNORECASE)) for name, p in lx.NAMED_EQUATIONS]


def python_equations(text):
    """A finder as a user would write it: every named pattern's matches."""
    for name, pattern in NAMED:
        for m in pattern.finditer(text):
            yield name, m.group(1), m.group(0), m.start()


add(
    "element_finder",
    lambda s, d: finders.elements(pages(s, d), python_equations).select("doc_id", "page_num", "start_pos", "end_pos", "kind", "full_match", "content"),
    P + [EQS],
    f"SELECT {DP}, start_pos, end_pos, kind, full_match, {content} AS content FROM eqs",
)
add(
    "equations_by_page",
    lambda s, d: ch.equations_by_page(pages(s, d)).select("doc_id", "page_num", "id", "kind", "start_pos", "end_pos"),
    P + [EQS],
    f"SELECT {DP}, 'eq_' || page_num || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, start_pos, ord) - 1) AS id, kind, start_pos, end_pos FROM eqs",
)
add(
    "figure_refs",
    lambda s, d: ch.figure_refs(pages(s, d)).select("doc_id", "page_num", "id", "description", "start_pos", "end_pos"),
    P + [FIGS],
    f"SELECT {DP}, 'figure_' || page_num || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, ord, start_pos) - 1) AS id, {STRIP.format('full_match')} AS description, start_pos, end_pos FROM figs",
)
LANG = "CASE " + " ".join(f"WHEN regexp_matches(lower({{}}), {S.lit(S.either(p, 's'))}) THEN {S.lit(k)}" for k, p in ((k, [x.replace('{', '{{').replace('}', '}}') for x in v]) for k, v in lx.LANGUAGE_PATTERNS.items())) + " ELSE 'unknown' END"


def lang(x: str) -> str:
    return LANG.replace("lower({})", f"lower({x})").replace("{{", "{").replace("}}", "}")


add(
    "code_blocks_by_page",
    lambda s, d: ch.code_blocks_by_page(pages(s, d)).select("doc_id", "page_num", "id", "kind", "content", "language", "start_pos", "end_pos"),
    P + [CODES],
    f"SELECT {DP}, 'code_' || page_num || '_' || (row_number() OVER (PARTITION BY doc_id ORDER BY page_num, ord, start_pos) - 1) AS id, kind, {STRIP.format('full_match')} AS content, {lang('full_match')} AS language, start_pos, end_pos FROM codes",
)
add(
    "code_language",
    lambda s, d: pages(s, d).select("doc_id", "page_num", tx.code_language(F.col("text")).alias("language")),
    P,
    f"SELECT {DP}, {lang('text')} AS language FROM doc_pages",
)
tab_parts = ", ".join(f"regexp_extract_all(text, {S.lit(f'(?m:{p})')})" for p in lx.TABLE_PATTERNS)
add(
    "text_tables",
    lambda s, d: flat(ch.text_tables(pages(s, d)).select("doc_id", "page_num", "pattern", "n", "content", "id")),
    P,
    f"SELECT {DP}, CAST(p AS BIGINT) AS pattern, CAST(n AS BIGINT) AS n, f[n + 1] AS content, 'text_table_' || page_num || '_' || n AS id FROM "
    f"(SELECT {DP}, p, f, unnest(range(0, len(f))) n FROM (SELECT {DP}, p, l[p + 1] f FROM (SELECT {DP}, [{tab_parts}] l, unnest(range(0, {len(lx.TABLE_PATTERNS)})) p FROM doc_pages)))",
)
add(
    "table_to_markdown",
    lambda s, d: pages(s, d).withColumn(
        "rows",
        F.transform(F.split("text", "\n"), lambda l: F.transform(F.split(l, ", "), lambda c: F.when(F.length(c) > 3, c))),
    ).filter(F.size("rows") > 1).select("doc_id", "page_num", tx.table_markdown(F.col("rows")).alias("markdown")),
    P,
    f"""SELECT {DP}, array_to_string(list_concat([h, '| ' || array_to_string(['---' FOR c IN r[1]], ' | ') || ' |'], l[2:]), chr(10)) AS markdown FROM
  (SELECT *, l[1] h FROM (SELECT {DP}, r, ['| ' || array_to_string([coalesce(c, '') FOR c IN x], ' | ') || ' |' FOR x IN r] l FROM
  (SELECT {DP}, [[CASE WHEN length(c) > 3 THEN c END FOR c IN string_split(l, ', ')] FOR l IN string_split(text, chr(10))] r FROM doc_pages) WHERE len(r) > 1))""",
)

# --- chunks ------------------------------------------------------------------------------

UNITS = f"""
un_p AS (SELECT {DP}, unnest(range(1, len(l) + 1)) para, l FROM (SELECT {DP}, [x FOR x IN [{STRIP.format('y')} FOR y IN regexp_split_to_array(text, '\\n\\s*\\n')] IF x <> ''] l FROM cleaned)),
un_s AS (SELECT {DP}, para, CASE WHEN {S.wc('l[para]')} > 200 THEN string_split(regexp_replace(l[para], '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) ELSE [l[para]] END s FROM un_p),
un_i AS MATERIALIZED (SELECT {DP}, para, i, s[i] s, {S.wc('s[i]')} n FROM (SELECT *, unnest(range(1, len(s) + 1)) i FROM un_s)),
un_f AS (SELECT {DP}, para, i, 0 u, n w FROM un_i WHERE i = 1 UNION ALL
  SELECT x.doc_id, x.page_num, x.para, x.i, CASE WHEN f.w + x.n <= 200 THEN f.u ELSE f.u + 1 END, CASE WHEN f.w + x.n <= 200 THEN f.w + x.n ELSE x.n END
  FROM un_f f JOIN un_i x ON x.doc_id = f.doc_id AND x.page_num = f.page_num AND x.para = f.para AND x.i = f.i + 1),
un_t AS (SELECT {DP}, para, u, string_agg(s, ' ' ORDER BY i) AS text, sum(n) n FROM un_f JOIN un_i USING (doc_id, page_num, para, i) GROUP BY ALL),
units AS MATERIALIZED (SELECT {DP}, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY para, u) k, text, CAST(n AS BIGINT) n FROM un_t)
"""
UNITS = UNITS.replace("un_f JOIN un_i USING (doc_id, page_num, para, i) GROUP BY ALL", "(SELECT f.doc_id, f.page_num, f.para, f.u, f.i, x.s, x.n FROM un_f f JOIN un_i x ON x.doc_id = f.doc_id AND x.page_num = f.page_num AND x.para = f.para AND x.i = f.i) GROUP BY 1, 2, 3, 4")
CHUNKS = f"""
ck_f AS (SELECT {DP}, k, 0 c, n w FROM units WHERE k = 1 UNION ALL
  SELECT x.doc_id, x.page_num, x.k, CASE WHEN f.w + x.n <= 500 THEN f.c ELSE f.c + 1 END, CASE WHEN f.w + x.n <= 500 THEN f.w + x.n ELSE least(50, f.w) + x.n END
  FROM ck_f f JOIN units x ON x.doc_id = f.doc_id AND x.page_num = f.page_num AND x.k = f.k + 1),
ck_o AS MATERIALIZED (SELECT f.doc_id, f.page_num, f.c, string_agg(x.text, chr(10) ORDER BY f.k) own, count(*) AS semantic_units,
  list(x.text ORDER BY f.k) FILTER ({S.matches('x.text', S.SECTION_RE)}) titles
  FROM ck_f f JOIN units x ON x.doc_id = f.doc_id AND x.page_num = f.page_num AND x.k = f.k GROUP BY 1, 2, 3),
ck_t AS (SELECT {DP}, c, own AS text FROM ck_o WHERE c = 0 UNION ALL
  SELECT o.doc_id, o.page_num, o.c, CASE WHEN {S.wc('t.text')} <= 50 THEN t.text ELSE array_to_string((regexp_extract_all(t.text, '\\S+'))[-50:], ' ') END || chr(10) || o.own
  FROM ck_t t JOIN ck_o o ON o.doc_id = t.doc_id AND o.page_num = t.page_num AND o.c = t.c + 1),
chunks AS (SELECT t.doc_id, t.page_num, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.page_num, t.c) - 1 AS chunk_index, t.text, semantic_units, titles[1] AS section
  FROM ck_t t JOIN ck_o o ON o.doc_id = t.doc_id AND o.page_num = t.page_num AND o.c = t.c),
chunk_ids AS (SELECT *, 'page_' || page_num || '_chunk_' || chunk_index AS chunk_id FROM chunks)
"""


def rec(ctes, body):
    return S.query(ctes, body)


def add_rec(name, fn, ctes, body):
    QUERIES[name] = fn
    ORACLES[name] = rec(ctes, body)


def cleaned(s, d):
    return ch.clean_pages(pages(s, d))


def chunks(s, d):
    return ch.create_chunks(cleaned(s, d))


U = P + [CLEAN, UNITS]
C = U + [CHUNKS]
add_rec(
    "semantic_units",
    lambda s, d: ch.semantic_units(cleaned(s, d)).select("doc_id", "page_num", F.posexplode(F.arrays_zip("units", "counts")).alias("p", "u")).select(
        "doc_id", "page_num", (F.col("p") + 1).cast("bigint").alias("unit"), F.col("u.counts").alias("words"), F.col("u.units").alias("text")
    ),
    U,
    f"SELECT {DP}, k AS unit, n AS words, text FROM units",
)
add_rec(
    "chunk_pack",
    lambda s, d: chunks(s, d).select("doc_id", "page_num", "chunk_index", "text", "semantic_units"),
    C,
    f"SELECT {DP}, chunk_index, text, semantic_units FROM chunks",
)


def type_sql(x: str) -> str:
    low = f"lower({x})"
    return (
        f"CASE WHEN {S.matches(x, S.EQ_RE)} THEN 'equation' WHEN {S.matches(x, S.CODE_RE)} THEN 'code' "
        + " ".join(f"WHEN {S.any_word(low, w)} THEN {S.lit(k)}" for k, w in lx.CHUNK_TYPE_WORDS)
        + " ELSE 'normal' END"
    )


def importance_sql(x: str) -> str:
    low = f"lower({x})"
    i = lx.IMPORTANCE
    return (
        f"round(least(1e0, greatest(0e0, 0.5e0 + {S.count_present(low, i['high'])} * 0.2e0 + {S.count_present(low, i['medium'])} * 0.1e0 - {S.count_present(low, i['low'])} * 0.05e0 "
        f"+ CASE WHEN {S.matches(x, S.EQ_RE)} THEN 0.2e0 ELSE 0e0 END + CASE WHEN {S.matches(x, S.CODE_RE)} THEN 0.15e0 ELSE 0e0 END + CASE WHEN {S.matches(x, S.SECTION_RE)} THEN 0.1e0 ELSE 0e0 END)), 6)"
    )


add_rec(
    "chunk_record",
    lambda s, d: ch.chunk_records(chunks(s, d)),
    C,
    f"SELECT {DP}, chunk_index, chunk_id, text, semantic_units, section, {type_sql('text')} AS chunk_type, {importance_sql('text')} AS importance_score, {S.wc('text')} AS word_count, "
    f"length(text) AS char_count, {S.matches('text', S.EQ_RE)} AS has_equations, {S.matches('text', S.CODE_RE)} AS has_code FROM chunk_ids",
)
add_rec(
    "link_chunks",
    lambda s, d: ch.link_chunks(chunks(s, d).select("doc_id", "chunk_index", "chunk_id")),
    C,
    "SELECT doc_id, chunk_index, chunk_id, lag(chunk_id) OVER w AS prev_chunk, lead(chunk_id) OVER w AS next_chunk FROM chunk_ids WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)",
)
add_rec(
    "importance_order",
    lambda s, d: ch.importance_order(
        ch.chunk_records(chunks(s, d)).select("doc_id", "chunk_index", F.when(F.col("chunk_index") % 5 != 0, F.col("importance_score")).alias("importance_score"))
    ),
    C,
    f"SELECT doc_id, chunk_index, CASE WHEN chunk_index % 5 <> 0 THEN {importance_sql('text')} END AS importance_score, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN chunk_index % 5 <> 0 THEN {importance_sql('text')} END DESC NULLS LAST, chunk_index) AS place FROM chunks",
)
add_rec(
    "chunk_size_profile",
    lambda s, d: ch.size_profile(ch.chunk_records(chunks(s, d))),
    C,
    f"SELECT count(*) AS chunks, round(avg(length(text)), 6) AS avg_size, min(length(text)) AS min_size, max(length(text)) AS max_size, count(*) FILTER ({S.matches('text', S.EQ_RE)}) AS with_equations, "
    f"count(*) FILTER ({S.matches('text', S.CODE_RE)}) AS with_code, count(*) FILTER ({importance_sql('text')} > 0.7e0) AS important FROM chunks",
)
SIMPLE = """
sw AS (SELECT doc_id, regexp_extract_all(text, '\\S+') w FROM documents),
simple AS (SELECT doc_id, i AS chunk_no, array_to_string(w[i * 360 + 1 : i * 360 + 400], ' ') AS text FROM
  (SELECT doc_id, w, unnest(range(0, 1 + CAST(ceil(greatest(0, len(w) - 400) / 360) AS BIGINT))) i FROM sw WHERE len(w) > 0))
"""
add("simple_chunks", lambda s, d: flat(ch.simple_chunks(docs(s, d))), [SIMPLE], "SELECT doc_id, chunk_no, text FROM simple")
add(
    "chunk_windows_prompt",
    lambda s, d: ch.numbered_blocks(docs(s, d)),
    [SIMPLE],
    "SELECT doc_id, string_agg('CHUNK ' || (chunk_no + 1) || ': ' || left(text, 500) || '...', chr(10) || chr(10) ORDER BY chunk_no) AS prompt FROM simple WHERE chunk_no < 3 GROUP BY 1",
)
add(
    "chunk_type",
    lambda s, d: pages(s, d).select("doc_id", "page_num", tx.chunk_type(F.col("text")).alias("chunk_type")),
    P,
    f"SELECT {DP}, {type_sql('text')} AS chunk_type FROM doc_pages",
)
add(
    "importance_score",
    lambda s, d: pages(s, d).select("doc_id", "page_num", tx.importance_score(F.col("text")).alias("importance_score")),
    P,
    f"SELECT {DP}, {importance_sql('text')} AS importance_score FROM doc_pages",
)
add(
    "section_titles",
    lambda s, d: flat(pages(s, d).select("doc_id", "page_num", tx.section_titles(F.col("text")).alias("titles"))),
    P,
    f"SELECT {DP}, {S.join(TITLES)} AS titles FROM doc_pages",
)

# --- chunks cut at elements ----------------------------------------------------------------

STEM = f"""
el AS (SELECT {DP}, start_pos s, end_pos e, 'equation' t, 0 g, ord FROM eqs UNION ALL SELECT x.doc_id, x.page_num, 0, length(p.text), 'table', 1, ord FROM tabs x JOIN doc_pages p ON p.doc_id = x.doc_id AND p.page_num = x.page_num
  UNION ALL SELECT {DP}, start_pos, end_pos, 'figure', 2, ord FROM figs UNION ALL SELECT {DP}, start_pos, end_pos, 'code', 3, ord FROM codes),
el_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY s, g, ord, e) k FROM el),
sw_f AS (SELECT {DP}, 0::BIGINT k, 0::BIGINT before, 0::BIGINT cur, FALSE taken, 0::BIGINT s, 0::BIGINT e, '' t FROM doc_pages UNION ALL
  SELECT r.doc_id, r.page_num, r.k, f.cur, CASE WHEN r.s >= f.cur THEN r.e ELSE f.cur END, r.s >= f.cur, r.s, r.e, r.t FROM sw_f f JOIN el_r r ON r.doc_id = f.doc_id AND r.page_num = f.page_num AND r.k = f.k + 1),
cut AS (SELECT {DP}, before a, s b, 'text' t FROM sw_f WHERE taken AND s > before UNION ALL SELECT {DP}, s, e, t FROM sw_f WHERE taken UNION ALL
  SELECT p.doc_id, p.page_num, m, length(p.text), 'text' FROM (SELECT doc_id, page_num, max(cur) m FROM sw_f GROUP BY 1, 2) x JOIN doc_pages p ON p.doc_id = x.doc_id AND p.page_num = x.page_num WHERE m < length(p.text)),
piece AS (SELECT c.doc_id, c.page_num, a, t AS content_type, {STRIP.format("substr(p.text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT))")} AS text FROM cut c JOIN doc_pages p ON p.doc_id = c.doc_id AND p.page_num = c.page_num),
stem AS (SELECT {DP}, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY a) - 1 AS chunk_index, text, content_type FROM piece WHERE text <> '')
"""
ST = P + [EQS, FIGS, CODES, TABS, STEM]
add_rec("stem_chunks", lambda s, d: flat(ch.stem_chunks(pages(s, d))), ST, f"SELECT {DP}, 'chunk_' || page_num || '_' || chunk_index AS id, chunk_index, text, content_type FROM stem")


def rc(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {S.lit(pattern)}))"


HINT = S.unicode_words(lx.CODE_HINT)
add(
    "chunk_complexity",
    lambda s, d: ch.chunk_complexity(pages(s, d)).drop("text"),
    P,
    f"SELECT {DP}, length(text) AS char_count, {S.wc('text')} AS word_count, {rc('text', lx.DOLLAR_MATH)} AS equation_count, {rc('text', lx.SYMBOL_CLASS)} AS symbol_count, {rc('text', HINT)} AS code_pattern_count, "
    f"{S.matches('text', lx.SYMBOL_CLASS + '|' + lx.DOLLAR_MATH)} AS has_equations, {S.matches('text', '```|' + HINT)} AS has_code FROM doc_pages",
)


def count_all(named, flags) -> str:
    return "(" + " + ".join(rc("text", f"(?{flags}:{S.unicode_words(p)})") for _, p in named) + ")"


COUNTS = f"""
dc AS (SELECT doc_id, count(*) AS num_pages, CAST(sum({count_all(lx.NAMED_EQUATIONS, 'si')}) AS BIGINT) AS equations, CAST(sum({count_all(TAB, 'm')}) AS BIGINT) AS tables,
  CAST(sum({count_all(FIG, 'i')}) AS BIGINT) AS figures, CAST(sum({count_all(lx.NAMED_CODE, 'sm')}) AS BIGINT) AS code_blocks, CAST(sum({rc('text', lx.SYMBOL_CLASS)}) AS BIGINT) AS symbols,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM doc_pages GROUP BY 1),
dcs AS (SELECT *, CASE WHEN chars > 0 THEN round(least(1e0, (equations * 0.3e0 + tables * 0.2e0 + code_blocks * 0.25e0 + symbols / chars * 1000) / 10), 6) ELSE 0e0 END AS complexity_score FROM dc)
"""
add("doc_complexity", lambda s, d: ch.doc_complexity(pages(s, d)), P + [COUNTS], "SELECT * FROM dcs")
ALL_PAGES = S.PAGES[: S.PAGES.rindex("WHERE trim(")].replace("doc_pages AS", "all_pages AS") + ")"
add(
    "doc_warnings",
    lambda s, d: ch.doc_warnings(bridge.doc_pages(s, d, keep_blank=True)),
    [ALL_PAGES],
    f"SELECT {DP}, 'no extractable text' AS warning FROM all_pages WHERE trim(text) = '' UNION ALL SELECT {DP}, 'very little text' FROM all_pages WHERE {S.wc('text')} < 10",
)
add_rec(
    "doc_summary",
    lambda s, d: ch.doc_summary(pages(s, d), tx.clean_text(F.col("page_text"))),
    C + [COUNTS],
    """SELECT dcs.doc_id, num_pages, equations, tables, figures, code_blocks, complexity_score, coalesce(num_chunks, 0) AS num_chunks, coalesce(avg_chunk_size, 0) AS avg_chunk_size,
  equations > 0 AS has_math, tables > 0 AS has_tables, figures > 0 AS has_figures, code_blocks > 0 AS has_code FROM dcs LEFT JOIN
  (SELECT doc_id, count(*) AS num_chunks, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS avg_chunk_size FROM chunks GROUP BY 1) c ON c.doc_id = dcs.doc_id""",
)
spelled = "text"
for k, v in lx.SYMBOL_NAMES.items():
    spelled = f"replace({spelled}, {S.lit(k)}, {S.lit(v)})"
add(
    "symbol_names",
    lambda s, d: pages(s, d).select("doc_id", "page_num", tx.spell_symbols(F.col("text")).alias("spelled")),
    P,
    f"SELECT {DP}, {spelled} AS spelled FROM doc_pages",
)

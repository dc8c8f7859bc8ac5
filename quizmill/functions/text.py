"""Text expressions: word counts, keyword tests, pattern spans, cleaning, chunk scoring.

Everything here is Column -> Column; the long patterns run in Arrow batches (linear.py), all else stays in the JVM. Pattern
positions come from marking matches with two control characters and splitting on them, so one regexp pass
yields the matched and the unmatched parts in order.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import linear

OPEN, CLOSE = "\u0001", "\u0002"
WORD = r"[\p{L}\p{N}_]"


def unicode_words(pattern: str) -> str:
    """The same pattern with word characters meaning letters and digits of any script.

    A leading word boundary becomes a look-behind, and word runs are possessive: what follows them
    in these patterns is never a word character, so giving characters back cannot help.
    """
    pattern = pattern.replace(r"\b(", rf"(?<!{WORD})(")
    return pattern.replace(r"\w+\s*[", WORD + r"++\s*+[").replace(r"\w", WORD)


def either(patterns: list[str], flags: str = "s") -> str:
    """One alternation of all patterns, under its own flags."""
    return f"(?{flags}:" + "|".join(f"(?:{unicode_words(p)})" for p in patterns) + ")"


def guarded(patterns: list[str], guards: list[tuple[str, str]], flags: str = "s") -> str:
    """either(), where neighbours that begin with the same characters stand behind one look at the next character. A guard is a
    test and the start of the patterns it is for; it must hold wherever one of them matches."""
    groups: list[tuple[str, list[str]]] = []
    for p in patterns:
        guard = next((look for look, start in guards if re.match(start, p)), "")
        if groups and groups[-1][0] == guard:
            groups[-1][1].append(p)
        else:
            groups.append((guard, [p]))
    return "|".join(f"(?:{look}{either(ps, flags)})" for look, ps in groups)


#: $ and backslashes begin the equations of markup, word characters at a word's start those of operators, whose two kinds differ
#: behind the first word only, others than ASCII those of symbols; code begins with one of a few characters. Long classes of
#: symbols are slow to test, so each stands behind a short one.
OPERATORS = r"\b(?:\w+\s*[=≠<>≤≥±∞]+\s*\w+|\w+\s*[+\-*/∇∂]+\s*\w+)"
ONE_LOOK = rf"(?<!{WORD})\w++\s*+(?=[=<>+\-*/\x{{80}}-\x{{10FFFF}}])(?:[=≠<>≤≥±∞]+|[+\-*/∇∂]+)\s*\w+"
EQUATION_RE = guarded(
    [ONE_LOOK if p == OPERATORS else p for p in lx.EQUATION_PATTERNS],
    [(r"(?=[$\\])", r"\\[$\\]"), (rf"(?={WORD})", r"\(\?<!"), (r"(?=[^\x00-\x7F])", r"\[")], "si",
)
CODE_RE = guarded(lx.CODE_PATTERNS, [(r"(?=[`dfciw#\s])", r"[`dfciw#^]")])
PROTECTED_RE = EQUATION_RE + "|" + CODE_RE
#: The same patterns for linear matching, which needs no guards.
EQUATION, CODE = linear.either(lx.EQUATION_PATTERNS, "si"), linear.either(lx.CODE_PATTERNS)
#: All begin at the text's start, so no other place is tried.
SECTION_RE = "^" + either([p.removeprefix("^") for p in lx.SECTION_PATTERNS], "i")


def heads(c: Column, pattern: str) -> Column:
    """How many matches of the pattern have something in its group, which holds one character at most: only those are kept, so
    no list of matches is made."""
    return F.length(F.regexp_replace(c, pattern, "$1")).cast("bigint")


def word_count(c: Column) -> Column:
    return heads(c, r"\s*+(\S?)\S*+")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(\S+)"), F.lit(1))


def any_word(c: Column, words: list[str]) -> Column:
    """True when any of the words is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def count_present(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(c, F.lit(w)).cast("bigint") for w in words])


def present(c: Column, words: list[str]) -> Column:
    """The words contained in the text, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def bands(value: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """Label of the first threshold reached, thresholds descending."""
    first, *rest = steps
    out = F.when(value >= first[0], first[1])
    for limit, label in rest:
        out = out.when(value >= limit, label)
    return out.otherwise(last)


def issues(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the messages whose condition holds."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(msg) if isinstance(msg, str) else msg) for cond, msg in pairs])
    )


def lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    entries = [F.lit(x) for kv in table.items() for x in kv]
    found = F.try_element_at(F.create_map(*entries), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def sentences(c: Column) -> Column:
    """Split after . ! ? followed by white space."""
    return F.split(F.regexp_replace(c, r"([.!?])\s+", "$1" + OPEN), OPEN)


def marked(c: Column, pattern: str) -> Column:
    """[text before the first match, match CLOSE gap, match CLOSE gap, ...]"""
    return F.split(F.regexp_replace(c, f"({pattern})", OPEN + "$1" + CLOSE), OPEN, -1)


def spans(c: Column, pattern: str, kind: str, order: int = 0) -> Column:
    """Array of (start_pos, end_pos, kind, ord, full_match) for every match, in text order."""
    empty = F.array().cast("array<struct<start_pos:bigint,end_pos:bigint,kind:string,ord:int,full_match:string>>")

    def step(acc: Column, piece: Column) -> Column:
        m = F.substring_index(piece, CLOSE, 1)
        start = acc["pos"]
        found = F.struct(
            start.alias("start_pos"),
            (start + F.length(m)).alias("end_pos"),
            F.lit(kind).alias("kind"),
            F.lit(order).alias("ord"),
            m.alias("full_match"),
        )
        first = F.struct(F.length(piece).cast("bigint").alias("pos"), acc["out"].alias("out"))
        later = F.struct(
            (start + F.length(piece) - 1).cast("bigint").alias("pos"),
            F.concat(acc["out"], F.array(found)).alias("out"),
        )
        return F.when(start < 0, first).otherwise(later)

    # the pieces are named once, so the text is searched once
    start = F.struct(F.lit(-1).cast("bigint").alias("pos"), empty.alias("out"))
    pieces = F.split(linear.marks(c, pattern), OPEN, -1)
    return F.coalesce(F.aggregate(pieces, start, step, lambda acc: acc["out"]), empty)


def clean_text(c: Column) -> Column:
    """Repair the text between equations and code; keep those spans verbatim."""
    return linear.repairs(c, EQUATION + "|" + CODE)


def matches(c: Column, patterns: list[str], flags: str) -> Column:
    """Every match of every pattern, pattern by pattern."""
    return F.flatten(
        F.array(
            *[
                F.regexp_extract_all(c, F.lit(f"(?{flags}){unicode_words(p)}"), F.lit(0))
                for p in patterns
            ]
        )
    )


def has_equation(c: Column) -> Column:
    return linear.tests(c, EQUATION)


def has_code(c: Column) -> Column:
    return linear.tests(c, CODE)


def starts_like_section(c: Column) -> Column:
    return F.rlike(c, F.lit(SECTION_RE))


def section_titles(c: Column) -> Column:
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & starts_like_section(x))


def chunk_type(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(has_equation(c), "equation").when(has_code(c), "code")
    for label, words in lx.CHUNK_TYPE_WORDS:
        out = out.when(any_word(low, words), label)
    return out.otherwise("normal")


def importance_score(c: Column) -> Column:
    low = F.lower(c)
    score = (
        F.lit(0.5)
        + count_present(low, lx.IMPORTANCE["high"]) * 0.2
        + count_present(low, lx.IMPORTANCE["medium"]) * 0.1
        - count_present(low, lx.IMPORTANCE["low"]) * 0.05
        + F.when(has_equation(c), 0.2).otherwise(0.0)
        + F.when(has_code(c), 0.15).otherwise(0.0)
        + F.when(starts_like_section(c), 0.1).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6)


def code_language(c: Column) -> Column:
    low = F.lower(c)
    out = None
    for language, patterns in lx.LANGUAGE_PATTERNS.items():
        # one character before the brace decides as well as a run of them, in linear time
        linear = [p.replace(r"[^{]+\s*\{", r"[^{]\{") for p in patterns]
        hit = F.rlike(low, F.lit(either(linear, "s")))
        out = F.when(hit, language) if out is None else out.when(hit, language)
    return out.otherwise("unknown")


def normalize_text(c: Column) -> Column:
    """Lower case, runs of non-word characters to one space, no outer spaces."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def syllables(text: Column, words: Column | None = None) -> Column:
    """Vowel groups per word, at least one each: all groups, and one more for each word without a vowel. The number of words
    may be given where it is known."""
    low, words = F.lower(text), word_count(text) if words is None else words
    voiced = heads(low, r"\s*+[^aeiouy\s]*+([aeiouy]?)\S*+")
    return heads(low, r"[^aeiouy]*+([aeiouy]?)[aeiouy]*+") + words - voiced


def table_markdown(rows: Column) -> Column:
    """Array of rows of cells to a markdown table; null cells are empty."""
    lines = F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |")))
    rule = F.transform(F.get(rows, 0), lambda _: F.lit("---"))
    head = F.array(F.get(lines, 0), F.concat(F.lit("| "), F.array_join(rule, " | "), F.lit(" |")))
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.array_join(F.concat(head, body), "\n")


def spell_symbols(c: Column) -> Column:
    """Replace every known math symbol by its name."""
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), lx.SYMBOL_NAMES.items(), c)


def html_text(c: Column) -> Column:
    """Visible text of an HTML page: the article if there is one, else the whole body."""
    plain = F.regexp_replace(c, r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<title.*?</title>", " ")
    article = F.regexp_extract(plain, r"(?is)<article[^>]*>(.*)</article>", 1)

    def strip(x: Column) -> Column:
        x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
        for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]:
            x = F.replace(x, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(x, r"\s+", " "))

    primary = strip(article)
    return F.when(primary != "", primary).otherwise(strip(plain))

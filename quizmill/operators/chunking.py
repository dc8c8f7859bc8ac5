"""Pages to elements and chunks.

A page is worked on inside its own row. Only the running numbers of a document cross rows, and
they are computed on (doc, page, count) rows, never on the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quizmill import lexicon as lx
from quizmill.functions import linear as ln
from quizmill.functions import text as tx
from quizmill.functions.frames import hold

DOC, PAGE = "doc_id", "page_num"
LINK_BLOCK = 1000
#: Pieces of pages that a worker hands over, or looks at, at once.
ROWS = 1 << 16


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_pages(pages: DataFrame) -> DataFrame:
    return pages.select(DOC, PAGE, tx.clean_text(F.col("text")).alias("text"))


def page_features(pages: DataFrame) -> DataFrame:
    n = ln.counts(F.col("text"), r"\S+")
    return pages.select(
        DOC,
        PAGE,
        n.alias("word_count"),
        F.length("text").cast("bigint").alias("char_count"),
        tx.has_equation(F.col("text")).alias("has_equations"),
        tx.has_code(F.col("text")).alias("has_code"),
        tx.section_titles(F.col("text")).alias("section_titles"),
        F.round(n / (F.regexp_count("text", F.lit("\n")) + 1), 6).alias("content_density"),
    )


# --- elements ----------------------------------------------------------------------


def _regex(pattern: str, flags: str) -> str:
    return f"(?{flags}:{tx.unicode_words(pattern)})"


def _linear(pattern: str, flags: str) -> str:
    return f"(?{flags}:{ln.words(pattern)})"


def all_spans(text: Column, named: list[tuple[str, str]], flags: str) -> Column:
    """Spans of every pattern, pattern after pattern."""
    return F.flatten(
        F.array(*[tx.spans(text, _linear(p, flags), name, i) for i, (name, p) in enumerate(named)])
    )


def by_position(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start_pos"] != b["start_pos"], F.signum(a["start_pos"] - b["start_pos"]).cast("int")).otherwise(a["ord"] - b["ord"]))


def equation_spans(text: Column) -> Column:
    return by_position(all_spans(text, lx.NAMED_EQUATIONS, "si"))


def figure_spans(text: Column) -> Column:
    return all_spans(text, [("figure_reference", p) for p in lx.FIGURE_PATTERNS], "i")


def code_spans(text: Column) -> Column:
    return all_spans(text, lx.NAMED_CODE, "sm")


def span_content(kind: Column, full: Column, named: list[tuple[str, str]], flags: str) -> Column:
    """First group of the pattern that made the match."""
    out = None
    for name, pattern in named:
        inner = F.regexp_extract(full, _regex(pattern, flags), 1)
        out = F.when(kind == name, inner) if out is None else out.when(kind == name, inner)
    return out


def number_in_document(rows: DataFrame, counted: Column, name: str = "before") -> DataFrame:
    """Adds the number of items on earlier pages of the same document.

    The pages travel to their document with their items still packed, one row a page, so the items are computed once and
    a window holds the pages of one document (it spills).
    """
    earlier = W.partitionBy(DOC).orderBy(PAGE).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(counted).over(earlier), F.lit(0)))


def page_elements(pages: DataFrame, spans: Column, prefix: str) -> DataFrame:
    """One row per element with an id that counts through the whole document."""
    found = hold(pages.select(DOC, PAGE, "text"), spans=spans).drop("text")
    rows = number_in_document(found, F.size("spans").cast("bigint")).filter(F.size("spans") > 0)
    return (
        rows.select(DOC, PAGE, "before", F.posexplode("spans").alias("pos", "s"))
        .select(DOC, PAGE, (F.col("before") + F.col("pos")).alias("n"), "s.*")
        .withColumn("id", F.concat_ws("_", F.lit(prefix), PAGE, "n"))
    )


def detect_equations(pages: DataFrame) -> DataFrame:
    rows = pages.select(DOC, PAGE, F.inline(equation_spans(F.col("text"))))
    return rows.withColumn("content", span_content(F.col("kind"), F.col("full_match"), lx.NAMED_EQUATIONS, "si"))


def equations_by_page(pages: DataFrame) -> DataFrame:
    return page_elements(pages, equation_spans(F.col("text")), "eq")


def figure_refs(pages: DataFrame) -> DataFrame:
    return page_elements(pages, figure_spans(F.col("text")), "figure").withColumn("description", strip(F.col("full_match")))


def code_blocks_by_page(pages: DataFrame) -> DataFrame:
    rows = page_elements(pages, code_spans(F.col("text")), "code")
    return rows.withColumns({"content": strip(F.col("full_match")), "language": tx.code_language(F.col("full_match"))})


def text_tables(pages: DataFrame) -> DataFrame:
    """Matches of the text table patterns, numbered per page and pattern."""
    per_pattern = F.array(
        *[
            F.regexp_extract_all("text", F.lit(_regex(p, "m")), F.lit(0))
            for p in lx.TABLE_PATTERNS
        ]
    )
    return (
        pages.select(DOC, PAGE, F.posexplode(per_pattern).alias("pattern", "found"))
        .select(DOC, PAGE, "pattern", F.posexplode("found").alias("n", "content"))
        .withColumn("id", F.concat_ws("_", F.lit("text_table"), PAGE, "n"))
    )


# --- semantic chunks -----------------------------------------------------------------


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def _runs(ids: Column) -> Column:
    """Zero-based positions at which the id changes."""
    return F.when(F.size(ids) == 0, F.array().cast("array<int>")).otherwise(
        F.filter(
            F.sequence(F.lit(0), F.size(ids) - 1),
            lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1)),
        )
    )


def semantic_units(pages: DataFrame, limit: int = lx.UNIT_WORDS) -> DataFrame:
    """Adds units: paragraphs, long ones cut at sentence ends and packed up to the limit; and counts, their words.

    The fold carries word counts only; texts are sliced afterwards.
    """
    start = F.struct(
        F.array().cast("array<int>").alias("ids"), F.lit(-1).alias("u"),
        F.lit(0).cast("bigint").alias("w"), F.lit(-1).alias("para"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = (acc["para"] == x["para"]) & (acc["w"] + x["n"] <= limit)
        u = F.when(same, acc["u"]).otherwise(acc["u"] + 1)
        return F.struct(
            F.concat(acc["ids"], F.array(u)).alias("ids"), u.alias("u"),
            F.when(same, acc["w"] + x["n"]).otherwise(x["n"]).alias("w"), x["para"].alias("para"),
        )

    staged = hold(pages, parts=ln.parts(F.col("text"), limit))
    staged = hold(
        staged,
        ids=F.aggregate("parts", start, step, lambda acc: acc["ids"]),
        texts=F.transform("parts", lambda p: p["s"]),
        sizes=F.transform("parts", lambda p: p["n"]),
    )
    staged = hold(staged, runs=_runs(F.col("ids")))

    def unit(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get("runs", k + 1), F.size("texts"))
        return F.array_join(F.slice("texts", at + 1, until - at), " ")

    def size(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get("runs", k + 1), F.size("texts"))
        return total(F.slice("sizes", at + 1, until - at))

    return hold(staged, units=F.transform("runs", unit), counts=F.transform("runs", size)).drop("parts", "ids", "texts", "sizes", "runs")


def pack_units(units: DataFrame, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP) -> DataFrame:
    """Adds chunks: units packed up to size words, each chunk led by the last words of the one before.

    Every chunk is one span of the page's words, so the fold needs unit word counts only.
    """
    start = F.struct(
        F.array().cast("array<struct<c:int,w:bigint>>").alias("out"),
        F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("w"),
    )

    def step(acc: Column, n: Column) -> Column:
        fits = (acc["w"] + n <= size) | (F.size(acc["out"]) == 0)
        c = F.when(fits, acc["c"]).otherwise(acc["c"] + 1)
        w = F.when(fits, acc["w"] + n).otherwise(F.least(F.lit(overlap).cast("bigint"), acc["w"]) + n)
        return F.struct(
            F.concat(acc["out"], F.array(F.struct(c.alias("c"), w.alias("w")))).alias("out"),
            c.alias("c"), w.alias("w"),
        )

    if "counts" not in units.columns:
        units = hold(units, counts=F.transform("units", tx.word_count))
    # only a page of several chunks repeats words of one chunk at the next one's head
    several = total(F.col("counts")) > size
    staged = hold(units, words=F.when(several, tx.word_list(F.array_join("units", " "))))
    staged = hold(staged, fold=F.aggregate("counts", start, step, lambda acc: acc["out"]))
    staged = hold(staged, owner=F.transform("fold", lambda f: f["c"]))
    staged = hold(staged, runs=_runs(F.col("owner")))

    def own(k: Column) -> Column:
        at = F.get("runs", k)
        until = F.coalesce(F.get("runs", k + 1), F.size("units"))
        return F.array_join(F.slice("units", at + 1, until - at), "\n")

    def chunk(at: Column, k: Column) -> Column:
        words_before = F.get("fold", at - 1)["w"]
        offset = total(F.slice("counts", F.lit(1), at))
        tail = F.array_join(F.slice("words", (offset - overlap + 1).cast("int"), F.lit(overlap)), " ")
        lead = F.when(words_before <= overlap, own(k - 1)).otherwise(tail)
        until = F.coalesce(F.get("runs", k + 1), F.size("units"))
        text = F.when(k == 0, own(k)).otherwise(
            F.concat(lead, F.lit("\n"), own(k)) if overlap > 0 else own(k)
        )
        return F.struct(
            text.alias("text"),
            (until - at).cast("bigint").alias("semantic_units"),
            F.filter(F.slice("units", at + 1, until - at), lambda u: tx.starts_like_section(u)).alias("titles"),
        )

    return hold(staged, chunks=F.transform("runs", chunk)).drop(
        "units", "counts", "fold", "owner", "runs", "words"
    )


def create_chunks(pages: DataFrame, size: int = lx.CHUNK_SIZE, overlap: int = lx.CHUNK_OVERLAP) -> DataFrame:
    """One row per chunk; chunk_index counts through the document."""
    packed = pack_units(semantic_units(pages), size, overlap).select(DOC, PAGE, "chunks")
    rows = number_in_document(packed, F.size("chunks").cast("bigint"))
    return rows.select(DOC, PAGE, "before", F.posexplode("chunks").alias("pos", "c")).select(
        DOC,
        PAGE,
        (F.col("before") + F.col("pos")).alias("chunk_index"),
        F.concat(F.lit("page_"), PAGE, F.lit("_chunk_"), F.col("before") + F.col("pos")).alias("chunk_id"),
        "c.text",
        "c.semantic_units",
        F.get("c.titles", F.lit(0)).alias("section"),
    )


def chunk_records(chunks: DataFrame) -> DataFrame:
    """Adds type, score, counts and flags to every chunk."""
    t = F.col("text")
    return chunks.withColumns(
        {
            "chunk_type": tx.chunk_type(t),
            "importance_score": tx.importance_score(t),
            "word_count": ln.counts(t, r"\S+"),
            "char_count": F.length(t).cast("bigint"),
            "has_equations": tx.has_equation(t),
            "has_code": tx.has_code(t),
        }
    )


def link_chunks(chunks: DataFrame) -> DataFrame:
    """Adds the ids of the previous and next chunk of the document.

    Windows cover blocks of a thousand chunks; the first and last chunk of a block also visit the
    neighbouring block, so no window holds a whole document.
    """
    i = F.col("chunk_index")
    own = F.floor(i / LINK_BLOCK)
    visits = F.array_compact(
        F.array(
            own,
            F.when((i % LINK_BLOCK == 0) & (i > 0), own - 1),
            F.when(i % LINK_BLOCK == LINK_BLOCK - 1, own + 1),
        )
    )
    w = W.partitionBy(DOC, "block").orderBy("chunk_index")
    return (
        chunks.select("*", own.alias("own"), F.explode(visits).alias("block"))
        .withColumns({"prev_chunk": F.lag("chunk_id").over(w), "next_chunk": F.lead("chunk_id").over(w)})
        .filter(F.col("own") == F.col("block"))
        .drop("own", "block")
    )


def simple_chunks(docs: DataFrame, size: int = lx.SIMPLE_CHUNK, overlap: int = lx.SIMPLE_OVERLAP) -> DataFrame:
    """Fixed word windows over a whole text; the last window is the first to reach the end."""
    stride = size - overlap
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(stride))
    windows = F.transform(starts, lambda i: F.array_join(F.slice("words", i + 1, F.lit(size)), " "))
    return (
        docs.withColumn("words", tx.word_list(F.col("text")))
        .filter(n > 0)
        .select(DOC, F.posexplode(windows).alias("chunk_no", "text"))
    )


# --- chunks cut at elements ------------------------------------------------------------


#: What cuts a page, in the order in which elements that start together are taken. A table spans its whole page.
ELEMENTS = [
    ("equation", [p for _, p in lx.NAMED_EQUATIONS], "si"),
    ("table", lx.TABLE_PATTERNS, "m"),
    ("figure", lx.FIGURE_PATTERNS, "i"),
    ("code", [p for _, p in lx.NAMED_CODE], "sm"),
]
TYPES = ["text", *[name for name, _, _ in ELEMENTS]]


def _elements(x: pa.Array, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and type of every element in text order; at holds the starts of the texts."""
    spans = []
    for kind, (name, patterns, flags) in enumerate(ELEMENTS, 1):
        for pattern in (_linear(p, flags) for p in patterns):
            if name == "table":
                row = np.flatnonzero(pc.match_substring_regex(x, pattern))
                start, end = at[row], at[row + 1]
            else:
                start, end = ln.found(x, pattern)
            spans.append((start, end, np.full(len(start), kind)))
    start, end, kind = map(np.concatenate, zip(*spans, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], end[order], kind[order]


def _pieces(pages: pa.RecordBatch) -> pa.RecordBatch:
    """The stripped pieces of the pages, numbered page by page. They are runs of the pages' own bytes: elements that count, and what lies
    between them."""
    x = pc.fill_null(pages.column("text").cast(pa.string()), "")
    data, at = ln.laid(x)
    start, end, kind = _elements(ln.without_signs(x), at)
    taken, reached = np.zeros(len(start), bool), 0
    for at_once in range(0, len(start), ROWS):
        some = slice(at_once, at_once + ROWS)
        for i, (s, e) in enumerate(zip(start[some].tolist(), end[some].tolist(), strict=True), at_once):
            if reached <= s < e:
                taken[i], reached = True, e
    cuts = np.unique(np.concatenate([at, start[taken], end[taken]]))
    kinds = np.zeros(len(cuts) - 1, np.int64)
    kinds[np.searchsorted(cuts, start[taken])] = kind[taken]
    text = pc.ascii_trim(ln.texts(data, cuts), ln.SPACE)
    full = np.flatnonzero(pc.not_equal(text, ""))
    row = np.searchsorted(at, cuts[full], side="right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    columns = {
        DOC: pages.column(DOC).take(pa.array(row)),
        PAGE: pages.column(PAGE).take(pa.array(row)),
        "chunk_index": pa.array(number.astype(np.int32)),
        "text": text.take(pa.array(full)),
        "content_type": pa.array(TYPES).take(pa.array(kinds[full])),
    }
    return pa.RecordBatch.from_pydict(columns)


def _cut_at_elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pages in ln.steps(batch, "text"):
            made = _pieces(pages)
            yield from (made.slice(i, ROWS) for i in range(0, made.num_rows, ROWS))


def stem_chunks(pages: DataFrame) -> DataFrame:
    """Cut each page at its elements: text, equation, table, figure and code pieces in order.

    An element that starts before the position already reached is skipped. A worker takes a few megabytes of text at a time, and
    only pieces come back, so its memory does not grow with the batch; a longer page stands alone.
    """
    kinds = dict(pages.select(DOC, PAGE).dtypes)
    schema = f"{DOC} {kinds[DOC]}, {PAGE} {kinds[PAGE]}, chunk_index int, text string, content_type string"
    return pages.select(DOC, PAGE, "text").mapInArrow(_cut_at_elements, schema).select(
        DOC, PAGE, F.concat_ws("_", F.lit("chunk"), PAGE, "chunk_index").alias("id"), "chunk_index", "text", "content_type"
    )


def chunk_complexity(chunks: DataFrame) -> DataFrame:
    t = F.col("text")
    return chunks.withColumns(
        {
            "char_count": F.length(t).cast("bigint"),
            "word_count": tx.word_count(t),
            "equation_count": F.regexp_count(t, F.lit(lx.DOLLAR_MATH)).cast("bigint"),
            "symbol_count": F.regexp_count(t, F.lit(lx.SYMBOL_CLASS)).cast("bigint"),
            "code_pattern_count": F.regexp_count(t, F.lit(tx.unicode_words(lx.CODE_HINT))).cast("bigint"),
            "has_equations": F.rlike(t, F.lit(lx.SYMBOL_CLASS + "|" + lx.DOLLAR_MATH)),
            "has_code": F.rlike(t, F.lit("```|" + tx.unicode_words(lx.CODE_HINT))),
        }
    )


def element_counts(pages: DataFrame, *more: Column) -> DataFrame:
    """Per document: element counts, symbols and characters, in one pass over the pages; more adds columns to sum."""
    t = F.col("text")

    def n(patterns: list[str], flags: str) -> Column:
        return ln.counts(t, *[_linear(p, flags) for p in patterns])

    per_page = pages.select(
        DOC,
        n([p for _, p in lx.NAMED_EQUATIONS], "si").alias("equations"),
        n(lx.TABLE_PATTERNS, "m").alias("tables"),
        n(lx.FIGURE_PATTERNS, "i").alias("figures"),
        n([p for _, p in lx.NAMED_CODE], "sm").alias("code_blocks"),
        ln.counts(t, lx.SYMBOL_CLASS).alias("symbols"),
        F.length(t).cast("bigint").alias("chars"),
        *more,
    )
    return per_page.groupBy(DOC).agg(F.count("*").alias("num_pages"), *[F.sum(c).alias(c) for c in per_page.columns[1:]])


def doc_complexity(pages: DataFrame, *more: Column) -> DataFrame:
    c = element_counts(pages, *more)
    score = (
        F.col("equations") * 0.3
        + F.col("tables") * 0.2
        + F.col("code_blocks") * 0.25
        + F.col("symbols") / F.col("chars") * 1000
    ) / 10
    return c.withColumn(
        "complexity_score",
        F.when(F.col("chars") > 0, F.round(F.least(F.lit(1.0), score), 6)).otherwise(0.0),
    )


def doc_warnings(pages: DataFrame) -> DataFrame:
    """One row per page and warning; pages include blank ones."""
    n = tx.word_count(F.col("text"))
    found = F.array_compact(
        F.array(
            F.when(F.trim("text") == "", F.lit("no extractable text")), F.when(n < 10, F.lit("very little text"))
        )
    )
    return pages.select(DOC, PAGE, F.explode(found).alias("warning"))


def doc_summary(pages: DataFrame, clean: Column) -> DataFrame:
    """Counts of a document's elements and chunks, in one pass: chunks are counted while packed. clean makes the text that
    is chunked out of the page's text; elements are counted in the page's own."""
    raw = hold(pages.select(DOC, PAGE, F.col("text").alias("page_text")), text=clean)
    packed = pack_units(semantic_units(raw)).select(DOC, F.col("page_text").alias("text"), "chunks")
    lengths = F.aggregate("chunks", F.lit(0).cast("bigint"), lambda acc, c: acc + F.length(c["text"]))
    sums = doc_complexity(packed, F.size("chunks").cast("bigint").alias("num_chunks"), lengths.alias("chunk_chars"))
    flags = {"has_math": "equations", "has_tables": "tables", "has_figures": "figures", "has_code": "code_blocks"}
    average = F.coalesce(F.floor(F.try_divide(F.col("chunk_chars"), F.col("num_chunks"))), F.lit(0))
    return (
        sums.withColumn("avg_chunk_size", average)
        .withColumns({n: F.col(c) > 0 for n, c in flags.items()})
        .drop("symbols", "chars", "chunk_chars")
    )


def importance_order(chunks: DataFrame) -> DataFrame:
    """Adds place: the chunk's rank in its document, best first, unscored ones last."""
    order = W.partitionBy(DOC).orderBy(F.desc_nulls_last("importance_score"), "chunk_index")
    return chunks.withColumn("place", F.row_number().over(order).cast("bigint"))


def size_profile(chunks: DataFrame) -> DataFrame:
    n = F.col("char_count")
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(n), 6).alias("avg_size"),
        F.min(n).alias("min_size"),
        F.max(n).alias("max_size"),
        F.count_if("has_equations").alias("with_equations"),
        F.count_if("has_code").alias("with_code"),
        F.count_if(F.col("importance_score") > 0.7).alias("important"),
    )


def numbered_blocks(docs: DataFrame, first: int = 3, cut: int = 500) -> DataFrame:
    """The first chunks of a document, numbered and cut, as one prompt text."""
    chunks = simple_chunks(docs).filter(F.col("chunk_no") < first)
    block = F.concat(F.lit("CHUNK "), F.col("chunk_no") + 1, F.lit(": "), F.substring("text", 1, cut), F.lit("..."))
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", block.alias("b"))))
    return chunks.groupBy(DOC).agg(F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n").alias("prompt"))

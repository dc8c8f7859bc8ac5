"""Line deduplication: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import body, staged

#: A line on so many sites is boilerplate; lines of fewer words are left alone, so a blank line is.
SITES, WORDS = 10, 1
#: White space at the ends of a line and between its words: the blank and the controls 9 to 13.
SPACE = r"[\t-\r ]+"
#: log2 of a sketch's registers, and how many standard errors around SITES are counted exactly.
LG_K, NEAR = 10, 4


def split_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per line that may be boilerplate: doc_id and text_key of its document, site, place and line key. A line is
    what stands between two \\n, trimmed and in lower case for its key."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("source").alias("site"), F.posexplode(F.split(body(), "\n")).alias("place", "line"))
    key = F.lower(F.regexp_replace("line", f"^{SPACE}|{SPACE}$", ""))
    return lines.withColumn("line", key).filter((F.col("line") != "") & (F.size(F.split("line", SPACE)) >= words)).withColumn("line_key", F.xxhash64("line", F.md5(F.col("line").cast("binary")))).drop("line")


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Keys of the lines on at least `sites` sites (a null site counts as none), with their site count `n_sites` (exact
    near the threshold, else the sketch's) and the one occurrence that stays: the least id, text and place.

    Sketches merge map-side, so a line of any frequency reaches its reducer as one small row per task. A sketch of LG_K
    registers errs by about 1.04 / sqrt(2 ** LG_K); lines within NEAR such errors of the threshold are counted exactly, on
    rows that are one per line and site before they meet.
    """
    spread = lines.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("estimate"),
        F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "place")).alias("keeper"),
    )
    margin = NEAR * 1.04 / 2 ** (LG_K / 2) * sites + 1
    wide = spread.filter(F.col("estimate") >= sites - margin)
    close = wide.filter(F.col("estimate") <= sites + margin).select("line_key")
    exact = lines.select("line_key", "site").distinct().join(close, "line_key", "left_semi").groupBy("line_key").agg(F.count("site").alias("exact"))
    counted = wide.join(exact, "line_key", "left").withColumn("n_sites", F.coalesce("exact", "estimate"))
    return counted.filter(F.col("n_sites") >= sites).select("line_key", "n_sites", "keeper")


def dedup_lines(docs: DataFrame, sites: int = SITES, words: int = WORDS) -> DataFrame:
    """docs with boilerplate lines taken out of `text`, and `n_lines` and `n_removed`. Every row and every other column
    stays. A line on `sites` or more sites goes from every document but the one where it stands first (least doc_id,
    null last), so no sentence leaves the corpus altogether; a line repeated inside that document stays once.

    Null texts stay null with no lines; an empty text is one empty line. Lines under `words` words never count. Rows
    that repeat in full are decided alike: all of them keep the line, if one does. A document whose every line goes keeps
    an empty text. Columns of docs named like the result's own are replaced.
    """
    lines = staged(split_lines(docs, words))
    found = staged(boilerplate(lines, sites))
    hits = lines.join(found, "line_key")
    kept = F.expr("keeper.doc_id <=> doc_id AND keeper.text_key = text_key AND keeper.place = place")
    bits = hits.filter(~kept).groupBy("doc_id", "text_key", F.expr("place div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits"), F.count_distinct("place").alias("n"))
    gone = bits.groupBy("doc_id", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("__gone"), F.sum("n").alias("__n"))
    named = docs.drop("n_lines", "n_removed")
    keyed = named.withColumn("__key", F.xxhash64("text"))
    pieces = F.split("text", "\n")
    left = F.filter(pieces, lambda x, i: F.coalesce(F.getbit(F.element_at("__gone", F.shiftright(i.cast("bigint"), 6)), i % 64), F.lit(0)) == 0)
    joined = keyed.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.__key = g.text_key"), "left").select("d.*", "g.__gone", "g.__n")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(
        *[text.alias("text") if c == "text" else F.col(c) for c in named.columns],
        F.coalesce(F.when(F.col("text").isNotNull(), F.size(pieces)), F.lit(0)).alias("n_lines"),
        F.coalesce("__n", F.lit(0)).alias("n_removed"),
    )


#: DuckDB's form of dedup_lines() over documents, for the columns of op1.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS place
  FROM documents
), k AS (
  SELECT *, key <> '' AND len(regexp_split_to_array(key, '{SPACE}')) >= {WORDS} AS counts FROM (SELECT *, lower(regexp_replace(line, '^{SPACE}|{SPACE}$', '', 'g')) AS key FROM l)
), b AS (
  SELECT key, arg_min(place, (doc_id, place)) AS place, min(doc_id) AS doc_id FROM k WHERE counts GROUP BY key HAVING count(DISTINCT source) >= {SITES}
), f AS (
  SELECT k.*, b.key IS NOT NULL AND k.counts AND NOT (k.doc_id = b.doc_id AND k.place = b.place) AS gone FROM k LEFT JOIN b ON k.key = b.key
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), CASE WHEN bool_or(text IS NOT NULL) THEN '' END) AS text,
       count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_removed
FROM f GROUP BY doc_id"""

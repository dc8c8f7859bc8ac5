"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums, exact cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import WORD, body, staged

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: Characters of the hexadecimal order key that name a range; 16 ** DIGITS ranges of a source are cut in parallel.
DIGITS = 3


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """One row per source with its weight, size and target. Sources go by code point, null last, and take the weights in
    turn; the targets share the sum of all sizes by weight, none above `most` times its source's size, and what is cut off
    goes to the others by weight until none is above. Works on one narrow row per source."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")).cast("double"))
    cap = F.col("source_size") * F.lit(float(most))
    full = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level).withColumn("level", F.when(F.col("level") <= cap / F.col("weight"), F.col("level")))
    water = F.max("level").over(Window.partitionBy())
    return levels.select("source", "source_size", F.least(cap, water * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Each row of docs (doc_id, text, source) with `size` (its words), `source_size` and `target` of its source, `place`
    (words of its source before it in the random order) and `taken`, the words the mix takes of it, repeats counted.

    A source is taken whole as often as its target holds it; the rest is cut off the random order at exactly the whole
    words still owed, so the row on the cut gives its first words only. The order is by md5 of seed, id and text: reruns
    agree, rows that repeat stand side by side. Nulls: a text without words takes nothing; null sources are one source.
    An empty table gives no rows.

    The key is uniform, so its first digits deal every source, however large, over 16 ** DIGITS ranges; words before a
    row are the words of earlier ranges plus a running sum inside one range.
    """
    named = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body()).cast("binary")).alias("key"),
    ).withColumn("range", F.substring("key", 1, DIGITS))
    sized = staged(named)  # texts are read and counted once
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    plan = ranges.alias("r").join(source_targets(sized, weights, most).alias("t"), F.expr("r.source <=> t.source")).select("r.source", "r.range", "r.before", "t.source_size", "t.target")
    rows = sized.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.range = p.range")).select("d.doc_id", "d.source", "d.range", "d.key", "d.size", "p.before", "p.source_size", "p.target")
    inside = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    owed = F.floor("target").cast("long")
    epochs = F.coalesce(F.try_divide(owed, F.col("source_size")).cast("long"), F.lit(0).cast("long"))
    rest = owed - epochs * F.col("source_size")
    cut = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("place")))
    return rows.withColumn("place", place.cast("long")).select("doc_id", "source", "size", "source_size", "target", "place", (epochs * F.col("size") + cut).alias("taken"))


#: DuckDB's form of mix() over documents, for the columns of op7.
def oracle(documents: str = "documents", weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = 0) -> str:
    turns = ", ".join(f"{float(w)}::DOUBLE" for w in weights)
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5('{seed}' || chr(31) || coalesce(doc_id::VARCHAR, '') || chr(31) || coalesce(text, '')) AS k
  FROM {documents}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([{turns}])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1)::INT] AS w
  FROM d GROUP BY source
), lv AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(source_size * {float(most)}::DOUBLE) OVER (ORDER BY source_size * {float(most)}::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY source_size * {float(most)}::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(source_size * {float(most)}::DOUBLE, w * max(CASE WHEN level <= source_size * {float(most)}::DOUBLE / w THEN level END) OVER ()) AS target
  FROM lv
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS owed,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (coalesce(owed // nullif(source_size, 0), 0) * size + greatest(0, least(size, owed - coalesce(owed // nullif(source_size, 0), 0) * source_size - place)))::BIGINT AS taken
FROM p"""

"""N-gram Jaccard join: banded MinHash candidates, Bayesian pruning over growing signatures, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import Words, longs, mixed, shingles, slices, staged
from quizmill.llm.components import components

#: Similarity of a link, words of a shingle, and the chance below which a pair is given up unverified.
LIKE, SHINGLE, TOLERANCE = 0.8, 5, 1e-5
#: BANDS keys of ROWS MinHash values; two texts at LIKE share no key with a chance of (1 - LIKE ** ROWS) ** BANDS = 6e-5.
BANDS, ROWS = 32, 6
#: Values compared at a time, and how many of them travel with a candidate pair.
BATCH, CARRIED = 32, 64
#: Larger buckets make no pairs: their members are linked with one of them and compared in blocks.
CROWD = 32
#: Texts and bytes of a block.
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20

_RANDOM = np.random.default_rng(11)
_TIMES = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_PLUS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def signature(marks: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n MinHash values of a set of shingles; each takes the least of its own 32-bit permutation."""
    low = (marks >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        np.minimum(out, (_TIMES[:n, None] * low[None, i : i + 4096] + _PLUS[:n, None]).min(axis=1), out=out)
    return out


@lru_cache
def needed(n: int, like: float = LIKE, tolerance: float = TOLERANCE) -> int:
    """The fewest of n values that must agree: with fewer, and every similarity as likely beforehand, the chance of
    reaching `like` given the agreement is below tolerance. Chance = 1 - I(like; m + 1, n - m + 1), a binomial sum."""
    for m in range(n + 1):
        logs = [lgamma(n + 2) - lgamma(i + 1) - lgamma(n + 2 - i) + i * np.log(like) + (n + 1 - i) * np.log(1 - like) for i in range(m + 1)]
        if np.exp(logs).sum() >= tolerance:
            return m
    return n


def _marks(text: pd.Series) -> list[np.ndarray]:
    words = Words(pa.array(text, pa.large_string()))
    h = words.hash
    return [shingles(h[a:b], SHINGLE) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lane = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for whole in batches:
        for batch in slices(whole):
            words = Words(batch.column("text"))
            h, sets, bands, carried = words.hash, [], [], []
            for a, b in zip(words.first[:-1], words.first[1:], strict=True):
                marks = shingles(h[a:b], SHINGLE)
                if not len(marks):
                    sets.append(None), bands.append(None), carried.append(None)
                    continue
                sets.append(int(mixed(marks + np.uint64(len(marks))).sum().view(np.int64)))
                sig = signature(marks)
                keys = np.zeros(BANDS, np.uint64)
                for r in range(ROWS):
                    keys = mixed(keys * np.uint64(3) + sig.reshape(BANDS, ROWS)[:, r].astype(np.uint64) + lane)
                bands.append(keys.view(np.int64).tolist())
                carried.append(sig[:CARRIED].astype(np.uint16).tobytes())
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "bytes": batch.column("bytes"), "set": pa.array(sets, pa.int64()), "bands": pa.array(bands, pa.list_(pa.int64())), "carried": pa.array(carried, pa.binary())}
            )


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, bytes, set (64 bits of a text's set of shingles; null without words), band keys, and the low half
    of the first CARRIED MinHash values."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.octet_length("text").cast("long").alias("bytes"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.mapInArrow(_sketch, f"doc_id {kind}, text_key long, bytes long, set long, bands array<long>, carried binary")


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, CARRIED) for c in ("x", "y"))
        alive, agree = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for i in range(0, CARRIED, BATCH):
            agree[alive] += (x[alive, i : i + BATCH] == y[alive, i : i + BATCH]).sum(axis=1)
            alive = alive[agree[alive] >= needed(i + BATCH)]
        yield pa.record_batch({c: batch.column(c).take(pa.array(alive)) for c in ("a", "b")})


def candidate_links(sets: DataFrame) -> DataFrame:
    """Edges (a, b) between sets that may be alike: every linked pair is joined by a path of them. Pairs inside a bucket
    of at most CROWD sets are pruned one by one; members of a larger bucket are all tied to its least one."""
    keys = sets.select("set", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.count("*").alias("n"), F.min("set").alias("least")).filter("n > 1")
    shared = staged(keys.join(buckets, "band"))
    crowd = shared.filter(F.col("n") > CROWD).filter("set != least").select(F.col("set").alias("a"), F.col("least").alias("b")).distinct()
    few = shared.filter(F.col("n") <= CROWD).select("band", "set")
    pairs = few.withColumnRenamed("set", "a").join(few.withColumnRenamed("set", "b"), "band").filter("a < b").select("a", "b").distinct()
    carried = sets.select("set", "carried")
    both = pairs.join(carried.withColumnRenamed("set", "a").withColumnRenamed("carried", "x"), "a").join(carried.withColumnRenamed("set", "b").withColumnRenamed("carried", "y"), "b")
    return both.mapInArrow(_prune, "a long, b long").union(crowd)


def overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many marks each left set has in common with each right one, by a product of their incidence over the marks
    that more than one set has."""
    every = np.sort(np.concatenate([*left, *right]))
    shared = every[:-1][every[1:] == every[:-1]]
    shared = shared[np.concatenate(([True], shared[1:] != shared[:-1]))] if len(shared) else shared
    out = np.zeros((len(left), len(right)))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        return owner[hit], at[hit]

    (lo, lc), (ro, rc) = places(left), places(right)
    for i in range(0, len(shared), 4096):
        x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
        m, n = (lc >= i) & (lc < i + 4096), (rc >= i) & (rc < i + 4096)
        x[lo[m], lc[m] - i], y[ro[n], rc[n] - i] = 1, 1
        out += x @ y.T
    return out


def alike(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which left and right sets have a Jaccard similarity of LIKE: signatures are compared BATCH values at a time, pairs
    whose chance has fallen below TOLERANCE go, and what is left is verified exactly."""
    x, y = (np.stack([signature(s) for s in sets]) for sets in (left, right))
    alive, agree = np.ones((len(left), len(right)), bool), np.zeros((len(left), len(right)), np.int32)
    for i in range(0, BANDS * ROWS, BATCH):
        for j in range(i, i + BATCH):
            agree += x[:, None, j] == y[None, :, j]
        alive &= agree >= needed(i + BATCH)
        if not alive.any():
            return alive
    rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
    common = overlap([left[i] for i in rows], [right[j] for j in cols])
    sizes = np.array([len(left[i]) for i in rows])[:, None] + np.array([len(right[j]) for j in cols])[None, :]
    exact = np.zeros_like(alive)
    exact[np.ix_(rows, cols)] = common >= LIKE * (sizes - common) - 1e-9
    return exact & alive


def _roots(links: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name in each one's component of a square of links."""
    label = names.copy()
    links = links | links.T | np.eye(len(names), dtype=bool)
    while True:
        low = np.array([label[row].min() for row in links])
        if (low == label).all():
            return label
        label = low


def _block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    _, i, j = key
    rows = rows.sort_values("set", ignore_index=True)
    marks = _marks(rows["text"])
    names, copies, side = rows["set"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
    a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
    links = np.zeros((len(rows), len(rows)), bool)
    if len(a) and len(b):
        links[np.ix_(a, b)] = alike([marks[k] for k in a], [marks[k] for k in b])
    links |= links.T
    np.fill_diagonal(links, False)
    return pd.DataFrame({"set": names, "root": _roots(links, names), "links": (links * copies[None, :]).sum(axis=1)})


def linked_sets(docs: DataFrame, sets: DataFrame, sources: DataFrame) -> DataFrame:
    """(set, root, links) for every set with a candidate: root is the least set of its class and links counts the rows of
    docs with other sets at LIKE. sets has each set once, sources the row of docs (doc_id, text_key) that stands for it.

    Candidates are gathered into components; one of more than BLOCK_ROWS sets or BLOCK_BYTES bytes is compared block by
    block, each pair of blocks in a task of its own, and no pair of sets leaves a task.
    """
    parts = components(candidate_links(sets)).withColumnRenamed("node", "set").withColumnRenamed("root", "part")
    members = parts.join(sets.select("set", "copies", "bytes"), "set")
    widths = members.groupBy("part").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("width"))
    placed = members.join(widths, "part").withColumn("block", F.pmod(F.xxhash64("set"), F.col("width")).cast("int"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    named = placed.join(sources, "set").alias("p").join(texts.alias("t"), F.expr("p.doc_id <=> t.doc_id AND p.text_key = t.text_key"))
    one = named.select("p.set", "p.part", "p.copies", "p.block", "p.width", "t.text").dropDuplicates(["set"])
    dealt = one.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("width") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    done = staged(dealt.groupBy("part", "i", "j").applyInPandas(_block, "set long, root long, links long"))
    tied = done.filter("set != root")
    roots = components(tied.select(F.col("set").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "set")
    counts = done.groupBy("set").agg(F.sum("links").alias("links"))
    return counts.join(roots, "set", "left").select("set", F.coalesce("root", "set").alias("root"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): class_id, the least doc_id of its class of near duplicates; n_links, the
    other rows whose sets of five-word shingles (of lower-cased words; a shorter text is one shingle) have a Jaccard
    similarity of LIKE with its own, copies included; keeps, true for one row of each class (the least doc_id, then text);
    and the text_key of its row.

    Rows with one set of shingles are one set from the start, whatever their number; a set is named by 64 bits. Null and
    wordless texts are classes of their own without links. Null ids come last when a class is named; a row that repeats in
    full repeats in the result, and only one of its copies is kept by `keep_one`.
    """
    marked = staged(sketched(docs))
    some = marked.filter("set IS NOT NULL")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
    sets = staged(some.groupBy("set").agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"), least.alias("first"), F.any_value("bands").alias("bands"), F.any_value("carried").alias("carried")))
    sources = sets.select("set", "first.doc_id", "first.text_key")
    linked = linked_sets(docs, sets, sources)
    wide = staged(sets.select("set", "copies", "first").join(linked, "set", "left").select("set", "copies", "first", F.coalesce("root", "set").alias("root"), F.coalesce("links", F.lit(0)).alias("links")))
    heads = wide.groupBy("root").agg(F.min("first").alias("head"))
    classed = wide.join(heads, "root").select("set", (F.col("links") + F.col("copies") - 1).alias("n_links"), "head")
    found = marked.select("doc_id", "text_key", "set").join(classed, "set", "left")
    kept = F.expr("head.doc_id <=> doc_id AND head.text_key = text_key")
    return found.select("doc_id", "text_key", F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("head").isNull() | kept).alias("keeps"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class of near duplicates; every column stays. Rows that repeat in full leave one: only
    those are sorted out by row, so other texts are dealt once."""
    kept = near_duplicates(docs).filter("keeps")
    found = staged(kept.groupBy("doc_id", "text_key").agg(F.count("*").alias("__times")))
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    rows = keyed.alias("d").join(found.alias("k"), F.expr("d.doc_id <=> k.doc_id AND d.__key = k.text_key")).select("d.*", "k.__times")
    repeated = rows.filter("__times > 1").dropDuplicates(["doc_id", "__key"])
    return rows.filter("__times = 1").union(repeated).drop("__key", "__times")

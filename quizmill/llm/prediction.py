"""Language-model scores: prediction by partial matching over bytes, with escapes and exclusion, beside a word model."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizmill.llm.common import Words, body, lean, longs, rest, share, slices, staged

#: Bytes of the longest context; bytes of text in a block.
ORDER, BLOCK = 5, 24 << 20
#: Bytes that UTF-8 never has stand for the time before a text and for its end.
BEFORE, END = 0xFE, 0xFF
GRAM, WORD_KEY, TEXTS = 0, 1, 2
_U = np.uint64


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """ORDER + 1 bytes up to each byte of each text and to its end, as one number, and the text of each."""
    at, data = words.at, words.data
    n, size = len(at) - 1, np.diff(words.at)
    padded = np.full(len(data) + n * (ORDER + 1), BEFORE, np.uint64)
    owner = np.repeat(np.arange(n), size)
    padded[np.arange(len(data)) + owner * (ORDER + 1) + ORDER] = data
    ends = at[1:] + (np.arange(n) + 1) * (ORDER + 1) - 1
    padded[ends] = END
    m = len(padded) - ORDER
    g = np.zeros(m, np.uint64)
    for k in range(ORDER + 1):
        g = g << _U(8) | padded[k : k + m]
    texts = np.repeat(np.arange(n), size + ORDER + 1)[ORDER:]
    inside = np.ones(m, bool)
    starts = at[1:-1] + np.arange(1, n) * (ORDER + 1)  # where the next text's lead-in begins
    for k in range(ORDER):
        inside[starts + k - ORDER] = False
    return g[inside], texts[inside]


def _tallied(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its n (or its number)."""
    if n is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    total = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n, first) if len(first) else n
    return keys[first], total


class Tally:
    """Keys with counts that arrive in runs and are merged as they pile up."""

    def __init__(self) -> None:
        self.keys, self.n, self.runs = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
        self.waiting = 0

    def add(self, keys: np.ndarray, counts: bool) -> None:
        keys, n = _tallied(keys)
        self.runs.append((keys, n if counts else np.zeros_like(n)))
        self.waiting += len(keys)
        if self.waiting > max(1 << 19, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, n = (np.concatenate([own, *(run[k] for run in self.runs)]) for k, own in enumerate((self.keys, self.n)))
        (self.keys, self.n), self.runs, self.waiting = _tallied(keys, n), [], 0


def _count(key: tuple, rows: pa.Table) -> pa.Table:
    """Grams and words of a block with their number in its training texts, which may be 0."""
    lean()
    tallies = {GRAM: Tally(), WORD_KEY: Tally()}
    trained = 0
    for whole in rows.to_batches():
        for batch in slices(whole):
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for learnt in (True, False):
                some = batch.column("text").take(pa.array(np.flatnonzero(held != learnt)))
                if len(some):
                    trained += len(some) * learnt
                    words = Words(some)
                    tallies[GRAM].add(grams(words)[0], learnt)
                    tallies[WORD_KEY].add(words.hash, learnt)
    for tally in tallies.values():
        tally.merge()
    rest()
    out = [(kind, t.keys, t.n) for kind, t in tallies.items()] + [(TEXTS, np.zeros(1, np.uint64), np.array([trained]))]
    return pa.table(
        {
            "block": pa.array(np.full(sum(len(k) for _, k, _ in out), key[0].as_py()), pa.int32()),
            "kind": pa.array(np.concatenate([np.full(len(k), kind) for kind, k, _ in out]), pa.int32()),
            "key": longs(np.concatenate([k for _, k, _ in out])),
            "n": pa.array(np.concatenate([n for _, _, n in out]), pa.int64()),
        }
    )


def code_lengths(counts: DataFrame) -> DataFrame:
    """(key, value): log10 of the probability of each gram's last byte behind its other bytes.

    counts has every gram (key) with its number n in the training texts. A context with T bytes behind it, q kinds of them,
    gives (2 n - 1) / (2 T) to a byte that it had n times and escapes with q / (2 T) to the context one byte shorter, where
    the kinds it had are left out of n, T and q; at last all bytes not yet left out are equally likely. A context never had
    escapes for nothing. What an escape leaves out depends on the longer context alone, so each order is one join with the
    order below, on its suffix, and one window of at most 256 rows a context: no table is larger than counts, no group than
    256 rows. Values are rounded to single precision, which halves what blocks get back.
    """
    orders = {ORDER: counts.select("key", "n")}
    for k in range(ORDER - 1, -1, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        orders[k] = orders[k + 1].groupBy(shorter.alias("key")).agg(F.sum("n").alias("n"))
        if k == 3:
            orders[k] = staged(orders[k])

    def spent(out_total: Column, out_kinds: Column) -> Column:
        """Bits of the order below, whose columns are low_*: its own symbol, or its escape and what lies below that."""
        total, kinds = F.col("low_total") - out_total, F.col("low_kinds") - out_kinds
        hit = F.log10((2 * F.col("low_n") - 1) / (2 * total))
        miss = F.when(total > 0, F.log10(kinds / (2 * total))).otherwise(0.0) + F.col("low_rest")
        return F.when(F.col("low_n") > 0, hit).otherwise(miss)

    low = None
    for k in range(ORDER + 1):
        rows = orders[k].withColumn("context", F.shiftrightunsigned("key", 8))
        here = Window.partitionBy("context")
        had = (F.col("n") > 0).cast("long")
        if low is None:
            kinds = F.sum(had).over(here)
            rows = rows.withColumn("total", F.sum("n").over(here)).withColumn("kinds", kinds).withColumn("rest", -F.log10(256 - F.col("kinds")))
        else:
            below = low.select(F.col("key").alias("suffix"), *[F.col(c).alias(f"low_{c}") for c in ("n", "total", "kinds", "rest")])
            rows = rows.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(below, "suffix")
            rows = rows.withColumn("total", F.sum("n").over(here)).withColumn("kinds", F.sum(had).over(here)).withColumn("out", F.sum(had * F.col("low_n")).over(here))
            rows = rows.withColumn("rest", F.when(F.col("n") == 0, spent(F.col("out"), F.col("kinds"))))
        low = rows.select("key", "n", "total", "kinds", "rest")
    own = F.log10((2 * F.col("n") - 1) / (2 * F.col("total")))
    miss = F.when(F.col("total") > 0, F.log10(F.col("kinds") / (2 * F.col("total")))).otherwise(0.0) + F.col("rest")
    return low.select("key", F.when(F.col("n") > 0, own).otherwise(miss).cast("float").cast("double").alias("value"))


class Lookup:
    """Values by 64-bit key in an open table; every key asked for is in it."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, (3 * len(keys) // 2).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        at = np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(todo):
            free = at[slot] < 0
            at[slot[free]] = todo[free]
            left = at[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) & self.mask
        self.used = at >= 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits)
        self.keys[self.used], self.values[self.used] = keys[at[self.used]], values[at[self.used]]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        miss = np.flatnonzero((self.keys[slot] != keys) | ~self.used[slot])
        while len(miss):
            slot[miss] = (slot[miss] + 1) & self.mask
            miss = miss[(self.keys[slot[miss]] != keys[miss]) | ~self.used[slot[miss]]]
        return self.values[slot]


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """A row per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score and score, learning from
    rows that are not held out. A-Z count as a-z.

    `score` is log10 of the text's probability by a byte model of contexts up to ORDER bytes, its end included; `base_score`
    sums log10((c + 1) / (N + V + 1)) over its words and one end, where c is a token's number in the training texts, N that
    of all tokens and V the number of different ones; a word is known by 64 bits. Null texts are empty: one end. With
    nothing to learn from, every byte is equally likely and c, N and V are 0. An empty table gives no rows.

    Texts are dealt into blocks of about BLOCK bytes by a hash of the row. Each block sends its grams and words once, with
    counts; their probabilities are made in tables keyed by gram, and each block gets back what it asked for. So a task
    holds a block and its own part of the model, and never the model.
    """
    source = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), body().alias("text"), F.xxhash64("doc_id", "text").alias("row"))
    rows = source.withColumn("block", F.pmod("row", F.lit(max(12, share(docs, of=BLOCK)))).cast("int")).drop("row")
    counts = staged(rows.groupBy("block").applyInArrow(_count, "block int, kind int, key long, n long"))
    totals = staged(counts.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    known = {r.kind: (r.n or 0, r.kinds) for r in totals.filter(f"kind <> {GRAM}").groupBy("kind").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("kinds")).collect()}
    texts = known.get(TEXTS, (0, 0))[0]
    n_tokens, kinds = known.get(WORD_KEY, (0, 0))[0] + texts, (known.get(WORD_KEY, (0, 0))[1] or 0) + (texts > 0)
    lengths = code_lengths(totals.filter(f"kind = {GRAM}").select("key", "n")).withColumn("kind", F.lit(GRAM))
    words = totals.filter(f"kind = {WORD_KEY}").select("key", F.col("n").cast("double").alias("value"), "kind")
    model = counts.filter(f"kind <> {TEXTS}").select("block", "kind", "key").join(lengths.unionByName(words), ["kind", "key"])
    ident = dict(docs.dtypes)["doc_id"]

    def told(some: pa.Table, asked: pa.Table) -> pa.Table:
        lean()
        out = []
        if some.num_rows:
            kind, keys, values = (asked[c].to_numpy() for c in ("kind", "key", "value"))
            keys = keys.view(np.uint64)
            gram, word = (Lookup(keys[kind == k], values[kind == k]) for k in (GRAM, WORD_KEY))
            del asked, kind, keys, values
            for whole in some.to_batches():
                for batch in slices(whole):
                    w = Words(batch.column("text"))
                    g, owner = grams(w)
                    n = batch.num_rows
                    c = word(w.hash)
                    tokens = w.count + 1
                    base = np.bincount(w.owner, weights=np.log10(c + 1), minlength=n) + math.log10(texts + 1) - tokens * math.log10(n_tokens + kinds + 1)
                    out.append(pa.record_batch({
                        "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()),
                        "n_known": pa.array(np.bincount(w.owner, weights=c > 0, minlength=n).astype(np.int64) + (texts > 0), pa.int64()), "train_tokens": pa.array(np.full(n, n_tokens), pa.int64()),
                        "base_score": pa.array(base, pa.float64()), "score": pa.array(np.bincount(owner, weights=gram(g), minlength=n), pa.float64()),
                    }))
            del gram, word
            rest()
        return pa.Table.from_batches(out) if out else pa.table({c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    schema = f"doc_id {ident}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(told, schema)

"""Spelling variants: words within one edit, found by search schemes on bidirectional FM-indexes of the vocabulary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizmill.llm.common import body, staged

#: A word is a run of these letters; only A-Z are lowered.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many, by crc32 of its document and itself, loses a letter.
SLIP = 97
#: Words of a vocabulary: least code points and occurrences.
LENGTH, OFTEN = 5, 3
#: Rows of an index, and the share of one that a single half may fill before it is dealt to several.
BLOCK, SHARE = 1 << 16, 4
#: Letters of the queries that are searched together.
STEP = 1 << 17


def words_of(docs: DataFrame) -> DataFrame:
    """One row per run of letters: `word`, lower-cased in A-Z, less the letter that its document's slip takes. A null text
    has no runs, a null id counts as an empty one."""
    run = F.explode(F.regexp_extract_all(F.translate(body(), UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), run.alias("run"))
    marked = runs.select("run", F.crc32(F.concat("name", F.lit(":"), "run").cast("binary")).alias("mark"))
    at = "cast(mark % length(run) as int)"
    slipped = F.concat(F.expr(f"substring(run, 1, {at})"), F.expr(f"substring(run, {at} + 2)"))
    return marked.select(F.when(F.col("mark") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """(word, n): the words of at least `length` code points with at least `often` occurrences n over all documents."""
    return words_of(docs).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= often)


# -- the index of one block


class Ranks:
    """A wavelet matrix over a sequence of symbols: how often a symbol stands before a place, and how many smaller ones."""

    def __init__(self, symbols: np.ndarray, top: int) -> None:
        self.levels, self.zeros = [], []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(1 - ones, out=before[1:])
            self.levels.append((bit, before))
            self.zeros.append(int(before[-1]))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))
        every = np.arange(top + 1)
        self.first = self._walk(every, np.zeros(top + 1, np.int64), None)[0]

    def _walk(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray | None) -> tuple:
        less = np.zeros(len(lo), np.int64)
        for (bit, before), zeros in zip(self.levels, self.zeros, strict=True):
            one = ((symbol >> bit) & 1).astype(bool)
            low = before[lo].astype(np.int64)
            if hi is not None:
                high = before[hi].astype(np.int64)
                less += np.where(one, high - low, 0)
                hi = np.where(one, zeros + hi - high, high)
            lo = np.where(one, zeros + lo - low, low)
        return lo, hi, less

    def count(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray | None = None) -> tuple:
        """Occurrences of each symbol before lo and before hi, and the smaller symbols between them."""
        lo, hi, less = self._walk(symbol, lo, hi)
        return lo - self.first[symbol], None if hi is None else hi - self.first[symbol], less


class Half:
    """The FM-index of words that stand in order, each behind a delimiter (symbol 0), read as a circle: the symbol before
    each suffix in suffix order. The rows of the delimiters come first, in the order of the words."""

    def __init__(self, letters: np.ndarray, sizes: np.ndarray, top: int) -> None:
        n, k = len(letters) + len(sizes), len(sizes)
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[starts] = False
        text[inside] = letters
        rank = np.where(inside, text + k, 0)
        rank[starts] = np.arange(k)
        step = 1
        while True:  # delimiters differ from each other, so no comparison goes beyond a word
            key = rank * (n + top + 1) + np.roll(rank, -step)
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.last = text[order - 1]
        self.ranks = Ranks(self.last, top)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))


@dataclass
class Spans:
    """Synchronised suffix-rank intervals of patterns: `a` begins in the index that is read backwards, `b` in the one that is
    read forwards, both `size` rows long. `query` and `at` say whose they are and how much of the query they have read."""

    query: np.ndarray
    at: np.ndarray
    a: np.ndarray
    b: np.ndarray
    size: np.ndarray

    def take(self, keep: np.ndarray) -> Spans:
        return Spans(self.query[keep], self.at[keep], self.a[keep], self.b[keep], self.size[keep])


def _joined(parts: list[Spans]) -> Spans:
    return Spans(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("query", "at", "a", "b", "size")))


def _extended(index: Half, symbol: np.ndarray, near: np.ndarray, far: np.ndarray, size: np.ndarray) -> tuple:
    """Intervals longer by one symbol: `near` in the index that takes it in front, `far` in its mirror."""
    known = (symbol >= 0) & (size > 0)
    lo, hi, less = index.ranks.count(np.maximum(symbol, 0), near, near + size)
    return index.below[np.maximum(symbol, 0)] + lo, far + less, np.where(known, hi - lo, 0)


class Vocabulary:
    """Words with one error, over the two mirrored FM-indexes of a set of distinct words."""

    def __init__(self, words: list[str]) -> None:
        codes, sizes = _codes(words)
        self.alphabet = np.unique(codes)
        back = sorted(range(len(words)), key=lambda i: words[i][::-1])
        order = sorted(range(len(words)), key=words.__getitem__)
        self.halves = [self._half([words[i] for i in order]), self._half([words[i][::-1] for i in back])]
        self.orders = [np.array(order), np.array(back)]

    def _half(self, words: list[str]) -> Half:
        codes, sizes = _codes(words)
        return Half(self.symbols(codes), sizes, len(self.alphabet))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """Place of each code in the alphabet from 1; -1 for one that no word has."""
        at = np.searchsorted(self.alphabet, codes)
        return np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes, at + 1, -1)

    def near(self, queries: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places of all words one edit away whose left half, that of the query's len // 2 letters, is the
        query's; mirrored, whose right half is. The exact half is matched from the split outwards to its delimiter; then the
        search turns and extends across the other half, allowing the one error."""
        found, at = [], 0
        sizes = np.array([len(q) for q in queries])
        order = np.argsort(sizes, kind="stable")
        while at < len(queries):
            end = at + 1
            while end < len(queries) and (end + 1 - at) * sizes[order[end]] <= STEP:
                end += 1
            part = order[at:end]
            found.append([x if i else part[x] for i, x in enumerate(self._near([queries[i] for i in part], mirrored))])
            at = end
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def _near(self, queries: list[str], mirrored: bool) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(q) for q in queries])
        half = sizes - sizes // 2 if mirrored else sizes // 2
        codes, _ = _codes([q[::-1] for q in queries] if mirrored else queries)
        first = np.cumsum(sizes) - sizes
        flat = np.append(self.symbols(codes), -1)
        back, ahead = self.halves[::-1] if mirrored else self.halves
        n, rows = len(back.last), np.arange(len(queries))
        zero = np.zeros(len(queries), np.int64)
        spans = Spans(rows, half.copy(), zero, zero.copy(), np.full(len(queries), n))
        for left in range(int(half.max()), -1, -1):  # the exact half, outwards; the delimiter last
            reads = np.flatnonzero(half >= left)
            symbol = flat[first[reads] + left - 1] if left else np.zeros(len(reads), np.int64)
            spans.a[reads], spans.b[reads], spans.size[reads] = _extended(back, symbol, spans.a[reads], spans.b[reads], spans.size[reads])
        spans = spans.take(spans.size > 0)
        ones: list[Spans] = []
        hits: list[Spans] = []
        while len(spans.query) or ones:
            if ones:
                ones = [self._read(ahead, _joined(ones), flat, first, sizes, hits)]
                ones = [s for s in ones if len(s.query)]
            if len(spans.query):
                spans, slips = self._slip(ahead, spans, flat, first, sizes)
                ones.append(slips)
        if not hits:
            return np.zeros(0, int), np.zeros(0, int)
        every = _joined(hits)
        return every.query, self.orders[1 if mirrored else 0][every.a]

    @staticmethod
    def _read(ahead: Half, spans: Spans, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, hits: list[Spans]) -> Spans:
        """Spans with their error behind them read one letter more, or the delimiter at the end, which makes them hits."""
        over = spans.at == sizes[spans.query]
        symbol = np.where(over, 0, flat[first[spans.query] + np.minimum(spans.at, sizes[spans.query] - 1)])
        b, a, size = _extended(ahead, symbol, spans.b, spans.a, spans.size)
        spans = Spans(spans.query, spans.at + 1, a, b, size)
        hits.append(spans.take(over & (size > 0)))
        return spans.take(~over & (size > 0))

    @staticmethod
    def _slip(ahead: Half, spans: Spans, flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[Spans, Spans]:
        """One letter further: the spans that read it, and those that spend their error here on another letter in its
        place, a letter more before it, or its absence. Of equal edits in a run of one letter the last counts."""
        own, where = np.unique(spans.b * (len(ahead.last) + 1) + spans.size, return_inverse=True)
        start, size = own // (len(ahead.last) + 1), own % (len(ahead.last) + 1)
        rows = np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        top = len(ahead.below)
        kids, count = np.unique(np.repeat(np.arange(len(own)), size) * top + ahead.last[rows], return_counts=True)
        parent, symbol = kids // top, kids % top
        before = np.cumsum(count) - count
        lead = np.searchsorted(parent, np.arange(len(own) + 1))
        less = before - before[lead[parent]]
        begin = ahead.below[symbol] + ahead.ranks.count(symbol, start[parent])[0]
        fan = np.diff(lead)[where]
        who = np.repeat(np.arange(len(where)), fan)
        kid = np.repeat(lead[where] - np.cumsum(fan) + fan, fan) + np.arange(int(fan.sum()))
        ends = spans.at == sizes[spans.query]
        place = first[spans.query] + np.minimum(spans.at, sizes[spans.query] - 1)
        letter = np.where(ends, -2, flat[place])
        following = np.where(spans.at + 1 < sizes[spans.query], flat[place + 1], -3)
        child = Spans(spans.query[who], spans.at[who], spans.a[who] + less[kid], begin[kid], count[kid])
        same, real = symbol[kid] == letter[who], symbol[kid] > 0
        onward = Spans(child.query, child.at + 1, child.a, child.b, child.size)
        gone = ~ends & (letter != following)
        skipped = Spans(spans.query, spans.at + 1, spans.a, spans.b, spans.size).take(gone)
        return onward.take(same), _joined([onward.take(real & ~same & ~ends[who]), child.take(real & ~same), skipped])


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.array([len(w) for w in words], np.int64)


# -- the vocabulary in blocks


def _search(rows: pa.Table) -> pa.Table:
    """One block: rows (key, side, word, n, indexed, asks). Its indexed words make the index, the others only ask. An answer
    counts where its word is indexed under the half that asks, so no two blocks give the same one."""
    keys = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
    words, side, n = rows["word"].to_pylist(), rows["side"].to_numpy(), rows["n"].to_numpy()
    indexed, asks = (np.asarray(rows[c].to_numpy(zero_copy_only=False), bool) for c in ("indexed", "asks"))
    ask = keys.astype(np.int64) * len(keys) + rows["word"].combine_chunks().dictionary_encode().indices.to_numpy()
    place: dict[str, int] = {}
    of = np.array([place.setdefault(words[i], len(place)) for i in np.flatnonzero(indexed)], np.int64)
    names, counts = list(place), np.zeros(len(place), np.int64)
    counts[of] = n[indexed]
    member = np.sort(keys[indexed].astype(np.int64) * len(place) + of)
    out: dict[str, list] = {"word": [], "side": [], "near": [], "near_n": []}
    if names:
        vocabulary = Vocabulary(names)
        for mirrored in (0, 1):
            asking = np.flatnonzero(asks & (side == mirrored))
            asking = asking[np.unique(ask[asking], return_index=True)[1]]  # shares of one half may meet in a block
            query, word = vocabulary.near([words[i] for i in asking], bool(mirrored))
            mark = keys[asking[query]].astype(np.int64) * len(place) + word
            here = member[np.minimum(np.searchsorted(member, mark), len(member) - 1)] == mark
            query, word = asking[query[here]], word[here]
            out["word"] += [words[i] for i in query]
            out["side"] += [mirrored] * len(query)
            out["near"] += [names[i] for i in word]
            out["near_n"] += counts[word].tolist()
    return pa.table({"word": pa.array(out["word"], pa.string()), "side": pa.array(out["side"], pa.int32()), "near": pa.array(out["near"], pa.string()), "near_n": pa.array(out["near_n"], pa.int64())})


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n): all ordered pairs of words (word, n; each word once) that differ by exactly one inserted,
    deleted or replaced code point, and the n of the near one.

    One error leaves one half of a word as it is, so two near words meet under a left or a right half: every word is
    indexed under the halves that words of its own and of the neighbouring lengths have, and asks under its own two. Halves
    are dealt by hash to blocks of about `block` rows, each with an index of its own; a half of more than a SHARE-th of a
    block is dealt to several, all of which its words ask. A pair found under both halves is reported under the left.
    """
    size = F.length("word")

    def keys(side: int, mark: str, of: list[Column], cut: Callable[..., Column]) -> Column:
        own = of[1]
        return F.transform(F.array_distinct(F.array(*of)), lambda k: F.struct(F.lit(side).alias("side"), F.concat(F.lit(mark), cut("word", k)).alias("key"), (k == own).alias("asks")))

    lefts = [F.floor((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    rights = [F.ceil((size + d) / 2).cast("int") for d in (-1, 0, 1)]
    rows = words.select("word", "n", F.inline(F.concat(keys(0, "<", lefts, F.left), keys(1, ">", rights, F.right))))
    part = max(1, block // SHARE)
    crowded = staged(rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > part).select("key", F.ceil(F.col("rows") / part).cast("int").alias("width")))
    homed = rows.join(crowded, "key", "left").withColumn("width", F.coalesce("width", F.lit(1))).withColumn("home", F.pmod(F.xxhash64("word"), F.col("width")).cast("int"))
    homes = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("width") - 1)).otherwise(F.array("home"))
    dealt = homed.withColumn("salt", F.explode(homes)).withColumn("indexed", F.col("salt") == F.col("home"))
    blocks = max(1, -(-4 * words.count() // block))
    placed = dealt.select("key", "side", "word", "n", "indexed", "asks", F.pmod(F.xxhash64("key", "salt"), F.lit(blocks)).alias("block"))
    found = placed.repartition(blocks, "block").groupBy("block").applyInArrow(_search, "word string, side int, near string, near_n long")
    under_left = F.expr("startswith(near, left(word, cast(floor(length(word) / 2) as int)))")
    return found.filter((F.col("side") == 0) | ~under_left).select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form; each word once, forms without cycles): the end of each word's chain. Each round
    doubles the links that a root stands for, so a chain of n links takes log2(n) rounds."""
    known = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = staged(known.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        known = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, length: int = LENGTH, often: int = OFTEN) -> DataFrame:
    """One row per word of the vocabulary of docs (doc_id, text): word, n (occurrences), n_near (words one edit away), form
    (the near word of largest n, ties to the least in code-point order, if its n is at least twice the word's; else null),
    form_n (its n), root (the last form of the chain that starts at the word; the word itself if it has none).

    Forms at least double n, so chains cannot turn back and have fewer than 64 links. Null and empty texts add no words, rows that
    repeat count each time, an empty table gives no rows; other columns of docs play no part.
    """
    words = staged(vocabulary(docs, length, often))
    best = F.min(F.struct((-F.col("near_n")).alias("least"), "near"))
    nearest = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    form = F.expr("-best.least >= 2 * n")
    told = staged(
        words.join(nearest, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best.near")).alias("form"), F.when(form, -F.col("best.least")).alias("form_n"))
    )
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

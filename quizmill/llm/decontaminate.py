"""Benchmark decontamination: latent semantic retrieval of passages, then longest common subsequence and answer checks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quizmill.llm.common import Words as AnyWords
from quizmill.llm.common import body, slices

#: Words of a passage and of the step between two; items of fewer words than LEAST must stand word for word, and are
#: reported but prove no leak.
PASSAGE, STEP, LEAST = 64, 32, 8
#: Items that the driver takes at a time, passages that one model covers (and so its latent dimensions, at most), models
#: that a task holds, and power passes.
BLOCK, RANK, GROUP, POWERS = 1024, 256, 4, 2
#: What a word of every document still weighs in the search; cosine from which a passage is verified.
FLOOR, NEAR = 0.1, 0.25
#: Share of an item's words, in order, that proves a leak; a paraphrase of the lower share needs the item's answer as well.
LEAK, PARAPHRASE = 0.8, 0.6
#: What verifying a place costs, in looks at a word; it decides only how many words of an item are looked up.
VERIFY = 300
#: Rows of a model's basis that are added up at a time.
ROWS = 512
IDF_DIMS = 1 << 16
LOWERED = "__lowered"

_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Signs of two and three bytes that part words: U+0080 to U+00BF without its letters, U+2000 to U+207F, U+3000 to U+303F.
_SIGNS = {0xC2: np.array([128 <= b < 192 and b not in (0xAA, 0xB5, 0xBA) for b in range(256)]), 0xE2: np.isin(np.arange(256), (0x80, 0x81)), 0xE3: np.arange(256) == 0x80}
_LEADS = np.isin(np.arange(256), list(_SIGNS))


class Words(AnyWords):
    """Words of this operator are runs of letters and digits: what stands between them, and how, tells no copy apart."""

    @staticmethod
    def inside(data: np.ndarray) -> np.ndarray:
        out = _LETTER[data]
        leads = np.flatnonzero(_LEADS[data[:-1]])
        for lead, after in _SIGNS.items():
            at = leads[data[leads] == lead]
            at = at[after[data[at + 1]]]
            for i in range(2 if lead == 0xC2 else 3):
                out[np.minimum(at + i, len(data) - 1)] = False
        return out


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = np.zeros(IDF_DIMS + 1, np.int64), np.zeros(IDF_DIMS + 1, np.int64)
    for whole in batches:
        for batch in slices(whole):
            words = Words(batch.column("text"))
            dims = (words.hash >> np.uint64(48)).astype(np.int64)
            tokens[:IDF_DIMS] += np.bincount(dims, minlength=IDF_DIMS)
            keys = np.sort(words.owner * IDF_DIMS + dims)
            keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
            total[:IDF_DIMS] += np.bincount(keys % IDF_DIMS, minlength=IDF_DIMS)
            total[IDF_DIMS] += batch.num_rows
    seen = np.flatnonzero(total)
    yield pa.record_batch({"dim": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64()), "tokens": pa.array(tokens[seen], pa.int64())})


def weights(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """By word hash, over all of docs: inverse document frequency (never under FLOOR), and share of all words."""
    counted = docs.select(F.lower(body()).alias("text")).mapInArrow(_frequencies, "dim long, n long, tokens long")
    df, tokens = np.zeros(IDF_DIMS + 1), np.zeros(IDF_DIMS + 1)
    for r in counted.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).collect():
        df[r.dim], tokens[r.dim] = r.n, r.tokens
    idf = np.log((1 + df[IDF_DIMS]) / (1 + df[:IDF_DIMS])) + FLOOR
    return idf.astype(np.float32), (tokens[:IDF_DIMS] + 1) / (tokens.sum() + IDF_DIMS)


@dataclass
class Item:
    item_id: object
    words: list[int]
    answer: list[int]
    often: Counter = field(init=False)  # how often it has each word
    known: frozenset = field(init=False)

    def __post_init__(self) -> None:
        self.often = Counter(self.words)
        self.known = frozenset(self.often)

    def most(self, region: list[int]) -> int:
        """No fewer than the words it has in common with the region, in order: those that stand there in any order."""
        return sum(map(self.often.__getitem__, self.known.intersection(region)))


def _items(rows: list) -> list[Item]:
    """Word hashes of items and of their answers: what stands behind the last question mark, or the last sentence of three
    words or more."""
    out = []
    for r in rows:
        words = Words(pa.array([r.text]))
        tail = r.text.rpartition("?")[2].strip() or r.text
        ends = [s for s in re.split(r"(?<=[.!?])\s+", tail.strip()) if len(s.split()) >= 3]
        out.append(Item(r.item_id, words.hash.tolist(), Words(pa.array([ends[-1] if ends else tail])).hash.tolist()))
    return out


def _hits(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where h holds known words (sorted), and the place of each among them."""
    some = np.zeros(IDF_DIMS, bool)
    some[(known >> np.uint64(48)).astype(np.int64)] = True
    here = np.flatnonzero(some[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, h[here]), len(known) - 1)
    same = known[at] == h[here]
    return here[same], at[same]


def _weigh(h: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return idf[(h >> np.uint64(48)).astype(np.int64)]


@dataclass
class Latent:
    """At most RANK benchmark passages in the space of all their singular vectors."""

    idf: np.ndarray
    words: np.ndarray  # sorted hashes
    basis: np.ndarray  # words x rank, weights applied
    passages: np.ndarray  # passages x rank, unit length before the projection
    items: np.ndarray  # of each passage, its place in the block


@dataclass
class Units:
    """Parts of items and the rarest words of each, by which they are looked up in texts. A part that stands in `span`
    words to the share PARAPHRASE (whole, if under LEAST words) has at least `need` of those words there."""

    words: np.ndarray  # sorted hashes of the rarest words
    first: np.ndarray  # where each word's parts begin, one more than words
    parts: np.ndarray
    need: np.ndarray
    span: np.ndarray
    items: list[int]  # of each part, its place in the block
    judged: list[Item]  # what is verified where the part may stand


@dataclass
class Block:
    """What a task holds: items, the models of their passages, and their parts."""

    items: list[Item]
    models: list[Latent]
    units: Units


def _passages(items: list[Item]) -> list[tuple[int, list[int]]]:
    out = []
    for k, item in enumerate(items):
        for i in range(0, max(1, len(item.words) - STEP), STEP):
            out.append((k, item.words[i : i + PASSAGE]))
    return out


def _sparse(passages: list[list[int]], idf: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for p in passages:
        h = np.array(p, np.uint64)
        at = np.searchsorted(words, h)
        cols, n = np.unique(at, return_counts=True)
        value = n * _weigh(words[cols], idf)
        out.append((cols, value / max(float(np.sqrt((value**2).sum())), 1e-9)))
    return out


def latent(spark: SparkSession, passages: list[tuple[int, list[int]]], idf: np.ndarray) -> Latent:
    """A randomised singular value decomposition of the passages' TF-IDF matrix A: a random Omega is multiplied by A'A
    POWERS times, passage by passage in Spark tasks, and an orthonormal basis of the outcome is kept. It has a direction
    per passage, so the projection is exact and the cosine is that of TF-IDF."""
    words = np.array(sorted({w for _, p in passages for w in p}), np.uint64)
    rows = _sparse([p for _, p in passages], idf, words)
    rank = min(len(words), len(rows))
    q = np.random.default_rng(1).normal(size=(len(words), rank))
    frame = spark.createDataFrame([(c.tolist(), v.tolist()) for c, v in rows], "cols array<int>, value array<double>").repartition(8)
    for _ in range(POWERS):
        q = np.linalg.qr(q)[0]

        def product(parts: Iterator[pd.DataFrame], q: np.ndarray = q) -> Iterator[pd.DataFrame]:
            out: dict[int, np.ndarray] = {}
            for part in parts:
                for cols, value in zip(part["cols"], part["value"], strict=True):
                    inner = value @ q[cols]
                    for c, v in zip(cols, value, strict=True):
                        out[c] = out.get(c, 0) + v * inner
            yield pd.DataFrame({"word": list(out), "row": [r.tobytes() for r in out.values()]})

        made = frame.mapInPandas(product, "word int, row binary").collect()
        q = np.zeros_like(q)
        for r in made:
            q[r.word] += np.frombuffer(r.row)
    basis = np.linalg.qr(q)[0]
    inside = np.stack([v @ basis[c] for c, v in rows])
    return Latent(idf, words, (basis * _weigh(words, idf)[:, None]).astype(np.float32), inside.astype(np.float32), np.array([k for k, _ in passages]))


def _parts(item: Item) -> list[tuple[list[int], Item]]:
    """Words to look up, and what is verified where they stand: the item, in equal parts of at most PASSAGE words (what
    holds a share of the whole holds it of one of them), and of a longer item each passage, every quarter of one: of any
    PASSAGE words in a row, one has seven eighths."""
    n = len(item.words)
    m = -(-n // PASSAGE)
    out = [(item.words[i * n // m : (i + 1) * n // m], item) for i in range(m)]
    if n > PASSAGE:
        for i in sorted({*range(0, n - PASSAGE, PASSAGE // 4), n - PASSAGE}):
            words = item.words[i : i + PASSAGE]
            out.append((words, Item(item.item_id, words, item.answer)))
    return out


def _least(n: int) -> int:
    """Fewest words, in order, that can prove an item of n words."""
    return n if n < LEAST else next(m for m in range(n + 1) if m / n >= PARAPHRASE)


def _span(n: int) -> int:
    """Words of text that an item of n words may spread over."""
    return n if n < LEAST else n + n // 2


def units(items: list[Item], rate: np.ndarray) -> Units:
    """Of n words, of which a text must have m, any k have at least k - (n - m) there. Of the k rarest, k is taken where
    the looks (by the words' rates) and the places expected to have so many by chance (Chernoff's bound) cost least; any
    k finds everything."""
    owners, judged, need, span, rarest = [], [], [], [], []
    for at, item in enumerate(items):
        for words, whole in _parts(item):
            h = np.array(words, np.uint64)
            p = _weigh(h, rate)
            order = np.lexsort((h, p))
            h, p = h[order], p[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            k = np.arange(len(h) - _least(len(h)) + 1, len(h) + 1)
            wanted = k - k[0] + 1
            looks = np.cumsum(p * new)[k - 1]
            chance = looks * _span(len(h))
            bound = np.where(chance < wanted, np.exp(wanted * np.log(chance / wanted) + wanted - chance), 1.0)
            best = int((looks + VERIFY * bound).argmin())
            rarest.append(np.unique(h[: k[best]]))
            need.append(int(wanted[best]))
            span.append(_span(len(h)))
            owners.append(at)
            judged.append(whole)
    flat, part = np.concatenate(rarest), np.repeat(np.arange(len(rarest)), [len(r) for r in rarest])
    order = np.lexsort((part, flat))
    known, first = np.unique(flat[order], return_index=True)
    return Units(known, np.append(first, len(flat)), part[order], np.array(need), np.array(span), owners, judged)


def _places(u: Units, words: Words, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(part, row, first, last) of all runs of words that may belong to a part, in this order."""
    if not len(h):
        return
    hit, at = _hits(u.words, h)
    n = np.diff(u.first)[at]
    begin = np.repeat(u.first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) if len(hit) else np.zeros(0, np.int64)
    key = np.sort(u.parts[begin + np.arange(len(begin))].astype(np.int64) * len(h) + np.repeat(hit, n))
    part, place = np.divmod(key, len(h))
    end = np.arange(len(key)) + u.need[part] - 1
    inside = np.flatnonzero(end < len(key))
    end = end[inside]
    owner = words.owner
    inside, end = (x[(part[end] == part[inside]) & (place[end] - place[inside] < u.span[part[inside]]) & (owner[place[end]] == owner[place[inside]])] for x in (inside, end))
    yield from zip(part[inside].tolist(), owner[place[inside]].tolist(), place[inside].tolist(), place[end].tolist(), strict=True)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits per word of b."""
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if here := where.get(w):
            met = row & here
            row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def leaked(item: Item, region: list[int]) -> float:
    """The share of the item's words that the region has in order, 0 if that proves nothing: LEAK is proof, PARAPHRASE
    only with as much of the answer. An item under LEAST words must stand there without a gap."""
    n = len(item.words)
    if n < LEAST:
        return float(any(region[i : i + n] == item.words for i in range(len(region) - n + 1)))
    if item.most(region) / n < PARAPHRASE:
        return 0.0
    share = common_words(item.words, region) / len(item.words)
    if share >= LEAK:
        return share
    return share if share >= PARAPHRASE and common_words(item.answer, region) >= LEAK * len(item.answer) else 0.0


@dataclass
class Windows:
    """Passages of a run of texts in a model's space: PASSAGE words, a step and the one behind it, of the same text."""

    owner: np.ndarray
    start: np.ndarray
    vector: np.ndarray
    norm: np.ndarray


def _sums(basis: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The rows of basis that `at` names, added up from each start to the next, and a row of zeros behind them. Few rows
    at a time go through one small array."""
    out = np.zeros((len(starts) + 1, basis.shape[1]), np.float32)
    ends = np.append(starts[1:], len(at))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + ROWS, side="right")))
        np.add.reduceat(basis[at[starts[i] : ends[j - 1]]], starts[i:j] - starts[i], axis=0, out=out[i:j])
        i = j
    return out


def _windows(model: Latent, words: Words, h: np.ndarray) -> Windows | None:
    """The passages that have a word of the model."""
    weight = _weigh(h, model.idf)
    n = words.count
    begins = words.first[:-1]
    steps = np.maximum(1, -(-n // STEP))  # every text has a step, empty ones an empty one
    first = np.concatenate(([0], np.cumsum(steps)))
    owner = np.repeat(np.arange(len(n)), steps)
    step = np.repeat(begins, steps) + (np.arange(first[-1]) - first[owner]) * STEP
    of_word = first[words.owner] + (np.arange(len(h)) - begins[words.owner]) // STEP
    square = np.bincount(of_word, weights=weight.astype(float) ** 2, minlength=first[-1])
    hit, at = _hits(model.words, h)
    if not len(hit):
        return None
    cell = of_word[hit]  # ascending
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    cells, sums = cell[starts], _sums(model.basis, at, starts)
    spots = np.unique(np.concatenate([cells, cells[(cells > 0) & (owner[cells] == owner[cells - 1])] - 1]))
    look = np.full(first[-1] + 1, -1)
    look[cells] = np.arange(len(cells))
    follows = (spots + 1 < first[-1]) & (owner[np.minimum(spots + 1, first[-1] - 1)] == owner[spots])
    vector = sums[look[spots]] + sums[np.where(follows, look[np.minimum(spots + 1, first[-1])], -1)]
    norm = np.sqrt(square[spots] + np.where(follows, square[np.minimum(spots + 1, first[-1] - 1)], 0))
    return Windows(owner[spots], step[spots], vector, np.maximum(norm, 1e-9))


def _search(block: Block, texts: pa.Array) -> list[tuple]:
    """(row, item_id, cosine, overlap) of what the texts hold."""
    words = Words(texts)
    h = words.hash
    near: dict[tuple[int, int], list[tuple[float, int]]] = {}
    seen = [(model, w) for model in block.models if (w := _windows(model, words, h))]
    for model, w in seen:
        for i in range(0, len(w.owner), 4096):
            cosine = w.vector[i : i + 4096] @ model.passages.T / w.norm[i : i + 4096, None]
            for s, p in zip(*np.nonzero(cosine >= NEAR), strict=True):
                near.setdefault((int(w.owner[i + s]), int(model.items[p])), []).append((float(cosine[s, p]), int(w.start[i + s])))
    found: dict[tuple[int, int], float] = {}
    for (doc, k), places in near.items():
        item, best = block.items[k], 0.0
        lo, hi = words.first[doc], words.first[doc + 1]
        reach = max(PASSAGE, len(item.words))
        for _, s in sorted(places, reverse=True):
            best = max(best, leaked(item, h[max(lo, s - reach + STEP) : min(hi, s + PASSAGE + reach - STEP)].tolist()))
            if best >= LEAK:
                break
        if best:
            found[doc, k] = best
    _look_up(block.units, words, h, found)
    out = []
    for (doc, k), best in found.items():
        cosine = max((c for c, _ in near.get((doc, k), [])), default=0.0) or _cosine(seen, doc, k)
        out.append((doc, block.items[k].item_id, cosine, best))
    return out


def _look_up(u: Units, words: Words, h: np.ndarray, found: dict[tuple[int, int], float]) -> None:
    """Add to found (by row and item) what stands in the texts. Runs that begin within a span of each other are first
    judged as one; only if that may be a leak is each judged in the words about it."""
    last, clean = None, 0
    for part, doc, first, end in _places(u, words, h):
        if (part, doc) != last:
            last, clean = (part, doc), 0
        which, item = (doc, u.items[part]), u.judged[part]
        if first < clean or found.get(which, 0.0) >= LEAK:
            continue
        lo, hi, reach, span = words.first[doc], words.first[doc + 1], _span(len(item.words)), int(u.span[part])
        low = max(lo, end - reach + 1)
        if not leaked(item, h[low : min(hi, first + span + reach)].tolist()):
            clean = first + span
            continue
        share = leaked(item, h[low : min(hi, first + reach)].tolist())
        if share:
            found[which] = max(share, found.get(which, 0.0))


def _cosine(seen: list[tuple[Latent, Windows]], doc: int, k: int) -> float:
    """Of the row's passages, the cosine of the one that is nearest to the item."""
    best = 0.0
    for model, w in seen:
        a, b = np.searchsorted(w.owner, [doc, doc + 1])
        mine = model.passages[model.items == k]
        if b > a and len(mine):
            best = max(best, float((w.vector[a:b] @ mine.T / w.norm[a:b, None]).max()))
    return best


def blocks(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> Iterator[Block]:
    """The benchmark's items of `least` words or more in blocks of whole items with at most GROUP * RANK passages (or one longer item), with document
    frequencies over all of docs. Each model of a block has at most RANK passages. The driver holds about BLOCK items."""
    named = benchmark.filter("text IS NOT NULL").select("item_id", F.lower("text").alias("text"))
    parts = max(1, -(-named.count() // BLOCK))
    known = None
    for k in range(parts):
        part = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        items = [i for i in _items(sorted(part.collect(), key=lambda r: (str(r.item_id), r.text))) if len(i.words) >= least]
        some, size = [], 0
        for item in [*items, None]:
            more = len(_passages([item])) if item else 0
            if some and (item is None or size + more > GROUP * RANK):
                known = weights(docs) if known is None else known
                passages = _passages(some)
                models = [latent(docs.sparkSession, passages[i : i + RANK], known[0]) for i in range(0, len(passages), RANK)]
                yield Block(some, models, units(some, known[1]))
                some, size = [], 0
            if item:
                some, size = [*some, item], size + more


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, overlap) for every row of docs and item of the benchmark that it holds: cosine of the
    nearest passage, and the share of the item's words that stand there in order. Of an item of more than PASSAGE words, a
    passage is enough, and the share is the passage's if that is what was found.

    Each text is cut into passages of PASSAGE words every STEP words and compared, in Spark tasks, with all passages of a
    block of the benchmark (a stated query set; a benchmark of any size goes block by block, one scan of docs each, so what
    a task holds is bounded). Rare or short passages that this misses are looked up by their own words: every place where an item may
    stand within one and a half times its length is verified, however common its words are. Candidates are verified on the
    words themselves, runs of letters and digits in lower case; items of fewer than LEAST words, down to one, must stand
    word for word. Items that are null or have no word take no part; null texts hold nothing. A repeated row is reported
    each time, equal items each by their id; an empty table gives no rows.
    """
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("cosine", T.DoubleType()), T.StructField("overlap", T.DoubleType())])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    source = docs.select("doc_id", F.lower(body()).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(docs, benchmark):

        def search(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole):
                    rows = _search(block, b.column("text"))
                    ids = b.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                    yield pa.record_batch({"doc_id": ids, "item_id": pa.array([r[1] for r in rows], item_type), "cosine": pa.array([r[2] for r in rows], pa.float64()), "overlap": pa.array([r[3] for r in rows], pa.float64())})

        out = out.union(source.mapInArrow(search, schema))
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold a benchmark item of LEAST words or more, as leaks() finds them; every column of the
    others stays. Shorter items, which stand in texts by chance, take no row away: leaks() lists them. Each row is judged
    where it stands, so nothing is shuffled."""
    out = docs.withColumn(LOWERED, F.lower(body()))
    for block in blocks(docs, benchmark, LEAST):

        def clean(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in slices(whole, LOWERED):
                    held = {r[0] for r in _search(block, b.column(LOWERED))}
                    yield b.take(pa.array([i for i in range(b.num_rows) if i not in held], pa.int64())) if held else b

        out = out.mapInArrow(clean, out.schema)
    return out.drop(LOWERED)

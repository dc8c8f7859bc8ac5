"""Cross-tokenizer alignment: two tokenizations of one text cut into groups where both end, and links scored corpus-wide."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizmill.llm import bpe
from quizmill.llm.common import row_key, scratch, share, slices, staged

#: The vocabularies: a byte-level BPE file and a sentencepiece model.
LEFT, RIGHT = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text of a block, whose links are counted together, and the most blocks that are laid out as buckets.
BLOCK, MOST = 6 << 20, 1 << 16
#: Bytes and tokens of a run that is aligned at a time, and pairs in a row of counts.
STEP, TOKENS, ROW = 1 << 17, 1 << 17, 1 << 14
#: Links of a block that meet their counts at a time.
LINKS = 1 << 20

_COUNTS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
_LIST = pa.list_(pa.int32())


class Pieces:
    """A sentencepiece model and the bytes of its pieces: U+2581 is a blank, <0xHH> is byte HH."""

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes((int(p[3:5], 16),)) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]

    def id_lists(self, texts: list[str]) -> tuple[pa.ListArray, np.ndarray]:
        """The ids of each text, and whether they spell blank and text."""
        ids = self.model.encode(texts, num_threads=1)
        good = [bool(t) and b"".join(map(self.bytes.__getitem__, i)) == f" {t}".encode() for t, i in zip(texts, ids, strict=True)]
        return pa.array([i if g else [] for i, g in zip(ids, good, strict=True)], _LIST), np.array(good, bool)


@lru_cache(maxsize=1)
def pieces(model: bytes) -> Pieces:
    """One model a worker process."""
    return Pieces(model)


def sizes(tokens: list[bytes]) -> pa.Array:
    """Bytes of each token of a vocabulary."""
    return pa.array([len(t) for t in tokens], pa.int32())


def both(texts: list[str], left: bpe.Tokenizer, right: Pieces) -> tuple[pa.ListArray, pa.ListArray]:
    """Ids of blank and text by the left tokenizer, and of the text, to which it adds the blank, by the right one. A text
    that is empty, or that the pieces do not spell, has none of either."""
    b, good = right.id_lists(texts)
    return left.id_lists([f" {t}" if g else "" for t, g in zip(texts, good, strict=True)]), b


def ends(lists: pa.ListArray, size: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The flat ids of the lists, their parents, and the key of each: the byte where its list begins in the run and the
    byte where it ends in the list, added up. Sums are cumulative in each list: those of the run less what was before."""
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(size.take(flat))
    before = pa.concat_arrays([pa.array([0], total.type), total])
    begin = before.take(pc.subtract(lists.offsets.slice(0, len(lists)), lists.offsets[0]))
    within = pc.subtract(total, begin.take(parent))
    return flat, parent, pc.add(begin.take(parent), within)


class Aligned:
    """The alignment of two runs of id lists that spell the same bytes.

    The keys of both sides meet in a hash join: what it keeps are the bytes where tokens of both sides end, the ends of
    groups. Between two ends of any kind lies a stretch inside one token of either side, which is a link: `doc`, its list;
    `pair`, the left id above 32 bits and the right one below. Lists that an alignment has marked need no second join.
    """

    def __init__(self, a: pa.ListArray, b: pa.ListArray, a_size: pa.Array, b_size: pa.Array, marked: bool = False) -> None:
        self.lists = len(a)
        self.offsets = [pc.subtract(x.offsets, x.offsets[0]) for x in (a, b)]
        flags = None
        if marked:
            (a, flags), (b, _) = _unmarked(a), _unmarked(b)
        self.flat_a, parent, key_a = ends(a, a_size)
        self.flat_b, _, key_b = ends(b, b_size)
        if marked:
            self.shared = np.asarray(key_a)[flags]
        else:
            met = pa.table({"key": key_a}).join(pa.table({"key": key_b}), "key", join_type="left semi", use_threads=False)
            self.shared = np.sort(np.asarray(met["key"].combine_chunks()))
        self.a, self.b, self.parent = np.asarray(key_a), np.asarray(key_b), np.asarray(parent)
        every = np.concatenate((self.a, self.b))
        every.sort(kind="stable")  # two sorted runs
        stretch = every[np.concatenate((every[1:] != every[:-1], [True]))] if len(every) else every
        at = np.searchsorted(self.a, stretch)
        self.doc = self.parent[at]
        self.pair = np.asarray(self.flat_a)[at].astype(np.int64) << 32 | np.asarray(self.flat_b)[np.searchsorted(self.b, stretch)]

    def marked(self) -> tuple[pa.ListArray, pa.ListArray]:
        """Both lists with twice the id for each token, and one more where it ends a group."""
        out = []
        for flat, keys, offsets in ((self.flat_a, self.a, self.offsets[0]), (self.flat_b, self.b, self.offsets[1])):
            twice = np.asarray(flat) * np.int32(2)
            twice[np.searchsorted(keys, self.shared)] += 1
            out.append(pa.ListArray.from_arrays(offsets, pa.array(twice)))
        return tuple(out)

    def counts(self, docs: np.ndarray | None = None) -> pa.Table:
        """How often each pair of ids is linked, in all lists or in those that `docs` marks: pair, n."""
        pairs = self.pair if docs is None else self.pair[docs[self.doc]]
        told = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        return told.rename_columns(["n" if c == "count_all" else c for c in told.column_names])

    def _groups(self) -> tuple[pa.ListArray, pa.ListArray, pa.Array]:
        """The ids of either side in each group, and where each list's groups begin."""
        at_a, at_b = (np.concatenate(([0], np.searchsorted(keys, self.shared) + 1)).astype(np.int32) for keys in (self.a, self.b))
        per = np.bincount(self.parent[at_a[1:] - 1], minlength=self.lists)
        first = pa.array(np.concatenate(([0], np.cumsum(per))).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(at_a), self.flat_a), pa.ListArray.from_arrays(pa.array(at_b), self.flat_b), first

    def groups(self) -> pa.ListArray:
        """For each list, its groups as structs of the ids of either side."""
        a, b, first = self._groups()
        return pa.ListArray.from_arrays(first, pa.StructArray.from_arrays([a, b], ["a", "b"]))

    def group_texts(self) -> pa.Array:
        """For each list, its groups as a1,a2|b1;a3|b2,b3."""
        a, b, first = self._groups()
        sides = [pc.binary_join(pa.ListArray.from_arrays(x.offsets, pc.cast(x.values, pa.string())), ",") for x in (a, b)]
        return pc.binary_join(pa.ListArray.from_arrays(first, pc.binary_join_element_wise(*sides, "|")), ";")


def _unmarked(lists: pa.ListArray) -> tuple[pa.ListArray, np.ndarray]:
    flat = np.asarray(lists.flatten())
    return pa.ListArray.from_arrays(pc.subtract(lists.offsets, lists.offsets[0]), pa.array(flat >> 1)), (flat & 1).astype(bool)


def _added(parts: list[pa.Table]) -> pa.Table:
    told = pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return told.rename_columns(["n" if c == "n_sum" else c for c in told.column_names])


def _tokenised(batches: Iterator[pa.RecordBatch], left: Broadcast, right: Broadcast, size_a: pa.Array, size_b: pa.Array) -> Iterator[pa.RecordBatch]:
    """Rows of block, doc_id, a, b, marked with the ends of groups; and at the end of the task its link counts by block, without ids."""
    one, two = bpe.loaded(left.value, False), pieces(right.value)
    counts: dict[int, list[pa.Table]] = {}
    kind = None
    for whole in batches:
        kind = whole.schema.field("doc_id").type
        for batch in slices(whole, step=STEP):
            a, b = both(batch.column("text").fill_null("").to_pylist(), one, two)
            aligned, blocks = Aligned(a, b, size_a, size_b), np.asarray(batch.column("block"))
            a, b = aligned.marked()
            yield pa.record_batch({"block": batch.column("block"), "doc_id": batch.column("doc_id"), "a": a, "b": b, "counts": pa.nulls(batch.num_rows, _COUNTS)})
            for block in np.unique(blocks):
                here = blocks == block
                parts = counts.setdefault(int(block), [])
                parts.append(aligned.counts(None if here.all() else here))
                if len(parts) == 16:
                    parts[:] = [_added(parts)]
    for block, parts in counts.items():
        told = _added(parts).combine_chunks()
        for i in range(0, told.num_rows, ROW):
            part = told.slice(i, ROW)
            rows = pa.StructArray.from_arrays([part[c].combine_chunks() for c in ("pair", "n")], ["pair", "n"])
            none = pa.nulls(1, _LIST)
            one_row = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows).cast(_COUNTS)
            yield pa.record_batch({"block": pa.array([block], pa.int32()), "doc_id": pa.nulls(1, kind), "a": none, "b": none, "counts": one_row})


def _scored(docs: pa.Table, counts: pa.Table, size_a: pa.Array, size_b: pa.Array, as_text: bool) -> pa.Table:
    """The rows of a block and the corpus-wide counts of its pairs: its result rows."""
    bpe.loaded.cache_clear()  # this worker tokenises no more
    pieces.cache_clear()
    if not docs.num_rows:
        return pa.table({})
    docs = docs.combine_chunks()
    a, b = (docs[c].combine_chunks() for c in ("a", "b"))
    tokens = np.cumsum(np.asarray(pc.list_value_length(a)) + np.asarray(pc.list_value_length(b)))
    known = counts.select(["pair", "count", "best"]).combine_chunks()
    known = known.set_column(2, "best", pc.cast(known["best"], pa.int64()))
    sums = np.zeros((3, len(a)), np.int64)
    groups, n_groups, links, at = [], [], [], 0
    while at < len(a):
        gone = tokens[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(tokens, gone + TOKENS, side="right")))
        aligned = Aligned(a.slice(at, end - at), b.slice(at, end - at), size_a, size_b, marked=True)
        groups.append(aligned.group_texts() if as_text else aligned.groups())
        n_groups.append(np.bincount(aligned.parent[np.searchsorted(aligned.a, aligned.shared)], minlength=end - at))
        links.append(pa.table({"doc": aligned.doc.astype(np.int32) + np.int32(at), "pair": aligned.pair}))
        at = end
        if at == len(a) or sum(len(x) for x in links) >= LINKS:
            met = pa.concat_tables(links).join(known, "pair", join_type="left outer", use_threads=False)
            told = met.group_by("doc", use_threads=False).aggregate([([], "count_all"), ("best", "sum"), ("count", "sum")])
            for row, name in zip(sums, ("count_all", "best_sum", "count_sum"), strict=True):
                row[np.asarray(told["doc"])] = np.asarray(told[name])
            links = []
    numbers = {"n_a": pc.list_value_length(a), "n_b": pc.list_value_length(b), "n_groups": pa.array(np.concatenate(n_groups))}
    columns = {"doc_id": docs["doc_id"]} | {c: pc.cast(x, pa.int64()) for c, x in numbers.items()}
    return pa.table(columns | {c: pa.array(x) for c, x in zip(("n_links", "n_best", "count_sum"), sums, strict=True)} | {"groups": pa.chunked_array(groups)})


def _laid_out(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows written once, in buckets by block where a table can have so many, so that reading them by block moves nothing."""
    if blocks > MOST:
        return staged(rows)
    spark = rows.sparkSession
    name = f"aligned_{uuid.uuid4().hex}"
    rows.write.option("path", scratch(spark)).option("compression", "zstd").bucketBy(blocks, "block").saveAsTable(name)
    return spark.table(name)


def align(docs: DataFrame, left: str = LEFT, right: str = RIGHT, as_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_a and n_b, its tokens by the byte-level file `left` (of blank and text,
    special tokens as plain text) and by the model `right` (which adds the blank); `groups`, array<struct<a array<int>,
    b array<int>>> (or, `as_text`, a text a1,a2|b1;a3|b2,b3), its tokens cut where both end at one byte, and n_groups; n_links, the pairs of an a and a b token whose bytes
    overlap; count_sum, over these, how many links of all docs join their two ids; and n_best, how many of them no other
    a id exceeds for their b id, ties included.

    A null or empty text, or one that the tokens of a side do not spell, has no tokens: zeros and no groups. Rows that
    repeat each count. Other columns are not carried.

    Texts are dealt to blocks of about BLOCK bytes by a hash of id and text. Each block's links are counted where it is
    tokenised; Spark adds the counts of all blocks, finds the highest of each right id, and hands every block the counts of
    its own pairs. No link leaves its block, and a pair that every document has is one row a block. Tokens are laid out by
    block (up to MOST blocks, about half a terabyte of text; beyond, they are shuffled once more), so only texts and counts are shuffled.
    """
    context = docs.sparkSession.sparkContext
    specs = {"left": context.broadcast(bpe.read(left)), "right": context.broadcast(bpe.read(right))}
    size = {"size_a": sizes(bpe.Decoder(bpe.read(left)).bytes), "size_b": sizes(Pieces(bpe.read(right)).bytes)}
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = share(docs, of=BLOCK)
    schema = f"block int, doc_id {kind}, a array<int>, b array<int>, counts array<struct<pair: bigint, n: bigint>>"
    texts = docs.select(F.pmod(row_key(), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text").repartition(blocks, "block")
    told = _laid_out(texts.mapInArrow(partial(_tokenised, **specs, **size), schema), blocks)
    pairs = told.filter("counts IS NOT NULL").select(F.col("block").alias("home"), F.inline("counts"))
    counts = staged(pairs.groupBy("pair").agg(F.sum("n").alias("count")))
    named = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = named.groupBy("b").agg(F.max("count").alias("highest"))
    known = named.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    shares = pairs.select("home", "pair").join(known, "pair").select("home", "pair", "count", "best")
    rows = told.filter("counts IS NULL").select("block", "doc_id", "a", "b")
    numbers = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    out = f"doc_id {kind}, {numbers}, groups {'string' if as_text else 'array<struct<a: array<int>, b: array<int>>>'}"

    def scored(one: pa.Table, two: pa.Table) -> pa.Table:
        return _scored(one, two, **size, as_text=as_text)

    return rows.groupBy("block").cogroup(shares.groupBy("home")).applyInArrow(scored, out)

"""Byte pair encoding and decoding by a contiguous rank array, exactly as a byte-level tokenizer file says."""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

from quizmill.llm.common import STEP, slices

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words of more bytes keep their boundaries in a linked list under a heap: one scan a merge would be quadratic.
SHORT = 256
#: Encoded words in a generation of those that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1 << 17, 64
_NONE = 1 << 30


def packed(ids: list[int]) -> bytes:
    """Ids as 32-bit numbers one after the other."""
    return array("i", ids).tobytes()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Words of byte-level texts, with the classes of letters, digits and white space left open (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: Texts of code points up to here are cut by written-out classes, which the standard library runs faster.
_NARROW = 0x24F


def _ranges(codes: list[int]) -> str:
    first = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    last = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(first, last, strict=True))


class Splitter:
    """Words of a text. Letters and digits younger than Python's own tables are known to some libraries only; a text with
    one of them is cut by the library that belongs to the file."""

    def __init__(self, letters: dict[str, int]) -> None:
        classes = {"L": r"\p{L}", "N": r"\p{N}", "S": r"\s"}
        narrow = {k: _ranges([c for c in range(_NARROW + 1) if regex.match(p, chr(c))]) for k, p in classes.items()}
        every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
        young = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        self.letters, self.wide = letters, re.compile(f"[^{_ranges([*range(_NARROW + 1)])}]")
        self.narrow_words = re.compile(SPLIT.format(**narrow)).findall
        self.words = regex.compile(SPLIT.format(**classes)).findall
        self.young = re.compile(f"[{_ranges(young)}]" if young else r"(?!)")
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)

    def __call__(self, text: str) -> list[str]:
        if not self.wide.search(text):
            return self.narrow_words(text)
        if not self.young.search(text):
            return self.words(text)
        return [bytes(map(self.letters.__getitem__, w)).decode() for w, _ in self.library.pre_tokenize_str(text)]


def read(path: str) -> bytes:
    """The bytes of a vocabulary file, read where the driver runs; what reaches the workers is as large as the file."""
    with open(path, "rb") as f:
        return f.read()


class Decoder:
    """The bytes of each id of a byte-level BPE file, added tokens included: `texts(lists)` and `text(ids)`."""

    def __init__(self, spec: bytes) -> None:
        said = json.loads(spec)
        letters = byte_letters()
        known = {i: bytes(letters[c] for c in token) for token, i in said["model"]["vocab"].items()}
        known |= {t["id"]: t["content"].encode() for t in said.get("added_tokens", ())}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        #: all tokens' bytes one after the other, with where each begins; an empty one stands for unknown ids
        self.size = np.array([*map(len, self.bytes), 0])
        self.first = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(self.bytes), np.uint8)

    def texts(self, lists: pa.ListArray) -> list[str]:
        """The bytes of each list's ids read as UTF-8; a null list is empty, ids outside the vocabulary are passed over, broken
        bytes become U+FFFD."""
        sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        ids = np.asarray(lists.flatten().cast(pa.int64()).fill_null(-1))
        ids = np.where((ids >= 0) & (ids < len(self.bytes)), ids, len(self.bytes))
        size = self.size[ids]
        ends = np.concatenate(([0], np.cumsum(size)))
        data = self.all[np.repeat(self.first[ids] - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        at = ends[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]

    def text(self, ids: list[int]) -> str:
        return self.texts(pa.array([ids], pa.list_(pa.int64())))[0]


class Tokenizer:
    """A byte-level BPE file: `ids(text)`. Words come from the file family's pattern; with `special` the
    added tokens are cut out of the text first, the longest at a place."""

    def __init__(self, spec: bytes, special: bool = True) -> None:
        said = json.loads(spec)
        kind, model = said.get("pre_tokenizer") or {}, said["model"]
        if model.get("type", "BPE") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or said.get("normalizer") or model.get("dropout"):
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.id = {raw(token): i for token, i in model["vocab"].items()}
        pairs = [(raw(a), raw(b)) for a, b in pairs]
        #: the merge rank of two neighbouring ids, and the id that each rank makes
        self.rank = {self.id[a] << 32 | self.id[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [self.id[a + b] for a, b in pairs]
        self.single = [self.id.get(bytes((b,)), -1) for b in range(256)]
        added = {t["content"]: t["id"] for t in said.get("added_tokens", ())}
        self.added = added if special else {}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = Splitter(letters)
        self.memory: tuple[dict[str, bytes], dict[str, bytes]] = {}, {}
        keys = np.array(list(self.rank), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int32)[order]
        self.ids_made, self.ids_single = np.array([*self.made, -1], np.int32), np.array(self.single, np.int32)
        bytes_pair = self.ids_single[:, None].astype(np.int64) << 32 | self.ids_single[None, :]
        self.first_ranks = self._rank(bytes_pair.ravel())

    def _rank(self, pair: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def together(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of many short words: word(), a row of `parts` and of `ranks` for each word, one merge in all of
        them at a time. Words that nothing merges in any more leave."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        for low, high in ((0, 8), (8, 16), (16, 32), (32, SHORT)):
            rows = np.flatnonzero((size > low) & (size <= high))
            if not len(rows):
                continue
            width = int(size[rows].max())
            codes = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            left, column = size[rows], np.arange(width)
            parts = np.where(column < left[:, None], self.ids_single[codes], -1)
            pair = codes[:, :-1].astype(np.int32) << 8 | codes[:, 1:]
            ranks = np.where(column[1:] < left[:, None], self.first_ranks[pair], _NONE)
            while len(rows):
                at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), int)
                least = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), _NONE)
                over = least == _NONE
                for i, n, ids in zip(rows[over].tolist(), left[over].tolist(), parts[over], strict=True):
                    out[i] = ids[:n].tobytes()
                rows, left, parts, ranks, at, least = (x[~over] for x in (rows, left - 1, parts, ranks, at, least))
                if not len(rows):
                    break
                line, column = np.arange(len(rows)), np.arange(width - 1)
                parts[line, at] = self.ids_made[least]
                parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)
                ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), 1)
                width -= 1
                merged = parts[line, at].astype(np.int64)
                some = at > 0
                ranks[line[some], at[some] - 1] = self._rank(parts[line[some], at[some] - 1].astype(np.int64) << 32 | merged[some])
                some = at < left - 1
                ranks[line[some], at[some]] = self._rank(merged[some] << 32 | parts[line[some], at[some] + 1])
        return out

    def _cut(self, text: str) -> list[str]:
        """Words of a text; added tokens, which no word can equal, among them."""
        if not self.cut or not self.cut.search(text):
            return self.words(text)
        out, at = [], 0
        for found in self.cut.finditer(text):
            out += self.words(text[at : found.start()])
            out.append(found.group())
            at = found.end()
        return out + self.words(text[at:])

    def _encode(self, word: str) -> bytes:
        return packed([self.added[word]]) if word in self.added else packed(self.word(word.encode()))

    def id_lists(self, texts: list[str]) -> pa.ListArray:
        """The ids of each text. Words met before are looked up and the new ones encoded together. Memory has two
        generations: when the young one is full it becomes the old one, from which words that come again are taken back."""
        young, old = self.memory
        cut = [self._cut(t) for t in texts]
        lacking = [w for w in set(chain.from_iterable(cut)) if w not in young]
        young.update((w, old[w]) for w in lacking if w in old)
        new = [w for w in lacking if w not in young]
        short = [w for w in new if len(w) * 4 <= SHORT and w not in self.added]
        young.update(zip(short, self.together([w.encode() for w in short]), strict=True))
        young.update((w, self._encode(w)) for w in new if w not in young)
        lists = lists_of([b"".join(map(young.__getitem__, words)) for words in cut])
        for w in new:
            if len(w) > LONGEST:
                del young[w]
        if len(young) > REMEMBERED:
            self.memory = {}, young
        return lists

    def ids(self, text: str) -> list[int]:
        return self.id_lists([text])[0].values.to_pylist() if text else []

    def word(self, word: bytes) -> list[int]:
        """The ids of one word. `parts` holds the id of each stretch between two boundaries and `ranks` the merge rank of
        each part with the next. The least rank, leftmost first, loses its boundary: one entry goes from either array and
        the ranks on its two sides are looked up anew, until no neighbours merge."""
        if len(word) > SHORT:
            return self._long(word)
        rank, made = self.rank.get, self.made
        parts = [self.single[b] for b in word]
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != _NONE:
            i = ranks.index(low)
            parts[i] = part = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | part, _NONE)
            if i < len(ranks):
                ranks[i] = rank(part << 32 | parts[i + 1], _NONE)
        return parts

    def _long(self, word: bytes) -> list[int]:
        """The same for a word of any length: parts are linked, ranks wait in a heap and stale ones are passed over."""
        n, rank = len(word), self.rank.get
        parts = [self.single[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        heap: list[tuple[int, int]] = []

        def look(i: int) -> None:
            if after[i] < n and (r := rank(parts[i] << 32 | parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i))

        for i in range(n - 1):
            look(i)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank(parts[i] << 32 | parts[j]) != r:
                continue
            parts[i], parts[j], after[i] = self.made[r], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [p for p in parts if p >= 0]


@lru_cache(maxsize=4)
def loaded(spec: bytes, special: bool) -> Tokenizer:
    """One tokenizer a worker process."""
    return Tokenizer(spec, special)


@lru_cache(maxsize=4)
def decoder(spec: bytes) -> Decoder:
    return Decoder(spec)


def lists_of(ids: list[bytes]) -> pa.ListArray:
    """Lists of packed ids as an array."""
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def _encode(batches: Iterator[pa.RecordBatch], spec: Broadcast, special: bool, column: str, out: str) -> Iterator[pa.RecordBatch]:
    tokenizer = loaded(spec.value, special)
    for whole in batches:
        for batch in slices(whole, column):
            rest = {c: batch.column(c) for c in batch.schema.names if c != out}
            yield pa.record_batch(rest | {out: tokenizer.id_lists(batch.column(column).fill_null("").to_pylist())})


def _decode(batches: Iterator[pa.RecordBatch], spec: Broadcast, column: str, out: str) -> Iterator[pa.RecordBatch]:
    table = decoder(spec.value)
    for batch in batches:
        held = at = 0
        lists = batch.column(column)
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        for end in range(1, batch.num_rows + 1):
            held += int(sizes[end - 1])
            if held >= STEP // 4 or end == batch.num_rows:
                part = batch.slice(at, end - at)
                texts = pa.array(table.texts(part.column(column)), pa.string())
                yield pa.record_batch({c: part.column(c) for c in part.schema.names if c != out} | {out: texts})
                at, held = end, 0


def _schema(df: DataFrame, out: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` {kind}"])


def encode(docs: DataFrame, column: str = "text", out: str = "ids", vocabulary: str = VOCABULARY, special: bool = True) -> DataFrame:
    """docs with the token ids of a text column, array<int>; every row and other column stays, a column named `out` is
    replaced. Null and empty texts have no ids. `special` reads the vocabulary's added tokens inside a text as
    themselves; without it they are plain text. Nothing is shuffled; words are encoded once a worker while remembered."""
    spec = docs.sparkSession.sparkContext.broadcast(read(vocabulary))
    return docs.mapInArrow(partial(_encode, spec=spec, special=special, column=column, out=out), _schema(docs, out, "array<int>"))


def decode(rows: DataFrame, column: str = "ids", out: str = "decoded", vocabulary: str = VOCABULARY) -> DataFrame:
    """rows with the text of their id lists, added tokens included; null lists give an empty text, ids outside the
    vocabulary nothing. Every row and other column stays, a column named `out` is replaced."""
    spec = rows.sparkSession.sparkContext.broadcast(read(vocabulary))
    return rows.mapInArrow(partial(_decode, spec=spec, column=column, out=out), _schema(rows, out, "string"))

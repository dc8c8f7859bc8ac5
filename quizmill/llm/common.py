"""What the operators share: staged tables, null-safe columns, and word hashes over Arrow buffers."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than the blank and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step takes.
STEP = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[32, *range(9, 14)]] = False
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new place in the shared folder of spark.checkpoint.dir. The folder is the cluster's to clear."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: it cuts the lineage and outlives a lost executor."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def body(column: str | Column = "text") -> Column:
    """A text, empty for null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def row_key() -> Column:
    """64 bits of id and text: rows that repeat have one key, so whatever depends on it agrees between them."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def fold(n: int, column: str = "doc_id") -> Column:
    """crc32 of an id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def share(df: DataFrame, column: str = "text", of: int = 8 << 20) -> int:
    """How many shares of about `of` bytes the column has."""
    total = df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0
    return max(1, math.ceil(total / of))


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and where each text begins (one more than texts); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


@lru_cache(maxsize=1)
def lean() -> None:
    """Once a process: blocks of a megabyte or more go back to the system as soon as they are freed (mallopt's
    M_MMAP_THRESHOLD, where the C library has it), those of Arrow too."""
    pa.set_memory_pool(pa.system_memory_pool())
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 20)


def rest() -> None:
    """Hand small freed blocks back as well, so that a worker that waits for its next task holds little."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", step: int = STEP, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in runs of at most `rows` rows with about `step` bytes of text each; a longer text stands alone."""
    lean()
    _, at = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, side="right")) - 1)
        j = min(j, n, i + rows)
        yield batch.slice(i, j - i)
        i = j
    rest()


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, x, dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Words:
    """The words of a run of texts: `start` and `end` are byte places in `data`, `first` has each text's first word
    (one more than texts) and `hash` 64 bits of each word's bytes, A-Z read as a-z."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray) -> None:
        data, at = text_bytes(texts)
        self.at, self.data = at, _LOWER[data]
        inside = self.inside(data)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        if len(data):
            begin = at[:-1][at[:-1] < len(data)]
            opens[begin] |= inside[begin]
            last = at[1:][at[1:] > 0] - 1
            closes[last] |= inside[last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, at)

    @staticmethod
    def inside(data: np.ndarray) -> np.ndarray:
        """Which bytes belong to words."""
        return _IN_WORD[data]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hash(self) -> np.ndarray:
        size = 1 << max(20, int(len(self.data) + 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * down[self.start])

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """64 bits of each run of n words, sorted and without repeats; a shorter text is one run, an empty one none."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = out * _U(_BASE) + hashes[i : len(hashes) - k + 1 + i]
    out = np.sort(mixed(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def with_columns(batch: pa.RecordBatch, names: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch, and further ones."""
    return pa.record_batch({c: batch.column(c) for c in names} | added)


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


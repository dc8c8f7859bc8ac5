"""Pattern work on whole columns of text, in Arrow batches.

Arrow's kernels use RE2: every pattern takes linear time, and the patterns are those of the SQL, word for word. Each function is
made once per pattern, so a value that several columns ask for is computed once a row. A batch crosses to the worker once for
all the functions of a projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "\u0001", "\u0002"
SPACE = " \t\n\f\r"
WORD = r"[\p{L}\p{N}_]"
#: Bytes of text that one step over a batch takes.
STEP = 4 << 20
PART = pa.struct([("para", pa.int32()), ("s", pa.string()), ("n", pa.int64())])
TIDY = [(r"\s+", " "), (r"([a-z])([A-Z])", r"\1 \2"), (r"(\d)([A-Za-z])", r"\1 \2"), (r"([.!?])([A-Z])", r"\1 \2"), (r"•\s*", "• "), (r"(\d+)\.\s*", r"\1. ")]


def words(pattern: str) -> str:
    """The pattern with word characters of any script. RE2 has no look-behind; a match that could start inside a word also starts
    at its beginning."""
    return pattern.replace(r"\b(", "(").replace(r"\w", WORD)


def either(patterns: list[str], flags: str = "s") -> str:
    return f"(?{flags}:" + "|".join(f"(?:{words(p)})" for p in patterns) + ")"


@cache
def _tests(pattern: str):
    @F.arrow_udf("boolean")
    def tests(x: pa.Array) -> pa.Array:
        return pc.match_substring_regex(x, pattern)

    return tests


@cache
def _counts(patterns: tuple[str, ...]):
    @F.arrow_udf("long")
    def counts(x: pa.Array) -> pa.Array:
        total = pc.count_substring_regex(x, patterns[0]).cast(pa.int64())
        for p in patterns[1:]:
            total = pc.add(total, pc.count_substring_regex(x, p).cast(pa.int64()))
        return total

    return counts


@cache
def _marks(pattern: str):
    @F.arrow_udf("string")
    def marks(x: pa.Array) -> pa.Array:
        made = pc.replace_substring_regex(x, f"({pattern})", rf"{OPEN}\1{CLOSE}")
        return pc.if_else(pc.match_substring_regex(x, pattern), made, pa.scalar(None, pa.string()))

    return marks


def tests(c: Column, pattern: str) -> Column:
    return _tests(pattern)(c)


def counts(c: Column, *patterns: str) -> Column:
    """Matches of all patterns together."""
    return _counts(patterns)(c)


def marks(c: Column, pattern: str) -> Column:
    """The text with each match between OPEN and CLOSE, null without a match."""
    return _marks(pattern)(c)


def tidy(x: pa.Array) -> pa.Array:
    for pattern, repl in TIDY:
        x = pc.replace_substring_regex(x, pattern, repl)
    return x


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _repaired(x: pa.Array, protected: str) -> pa.Array:
    """Texts with the gaps between protected spans tidied, as marks split them."""
    pieces = pc.split_pattern(pc.replace_substring_regex(x, f"({protected})", rf"{OPEN}\1{CLOSE}"), OPEN)
    later = pc.list_slice(pieces, 1, None, return_fixed_size_list=False)
    flat = pc.list_flatten(later)
    span = pc.replace_substring_regex(flat, f"(?s){CLOSE}.*", "")
    gap = pc.replace_substring_regex(flat, f"(?s)^[^{CLOSE}]*{CLOSE}?([^{CLOSE}]*).*$", r"\1")
    sizes = pc.fill_null(pc.list_value_length(later), 0).to_numpy(zero_copy_only=False)
    rest = pc.binary_join(_lists(pc.binary_join_element_wise(span, tidy(gap), ""), sizes), "")
    whole = pc.binary_join_element_wise(tidy(pc.list_element(pieces, 0)), rest, "")
    return pc.ascii_trim(whole, SPACE)


@cache
def _repairs(protected: str):
    @F.arrow_udf("string")
    def repairs(x: pa.Array) -> pa.Array:
        return _repaired(x, protected)

    return repairs


def repairs(c: Column, protected: str) -> Column:
    """Tidy everything outside the protected spans, trim the whole."""
    return _repairs(protected)(c)


def _cut(x: pa.Array, limit: int) -> pa.Array:
    found = pc.split_pattern_regex(pc.fill_null(x, ""), r"\n\s*\n")
    row = pc.list_parent_indices(found).to_numpy()
    text = pc.ascii_trim(pc.list_flatten(found), SPACE)
    full = pc.not_equal(text, "")
    text, row = text.filter(full), row[full.to_numpy(zero_copy_only=False)]
    n = pc.count_substring_regex(text, r"\S+").to_numpy()
    long = pa.array(n > limit)
    cut = pc.replace_substring_regex(text, r"([.!?])\s+", rf"\1{OPEN}")
    pieces = pc.split_pattern(pc.if_else(long, cut, pa.scalar("")), OPEN)  # a short paragraph is one piece, empty until it is filled in
    owner = pc.list_parent_indices(pieces).to_numpy()
    s = pc.if_else(long.take(pa.array(owner)), pc.list_flatten(pieces), text.take(pa.array(owner)))
    per_row = np.bincount(row, minlength=len(x))
    para = np.arange(len(text)) - (np.cumsum(per_row) - per_row)[row]
    made = pa.StructArray.from_arrays([pa.array(para[owner].astype(np.int32)), s, pc.count_substring_regex(s, r"\S+").cast(pa.int64())], fields=list(PART))
    return _lists(made, np.bincount(row[owner], minlength=len(x)))


@cache
def _parts(limit: int):
    @F.arrow_udf("array<struct<para:int,s:string,n:bigint>>")
    def parts(x: pa.Array) -> pa.Array:
        return _cut(x, limit)

    return parts


def parts(c: Column, limit: int) -> Column:
    """Paragraphs as (para, s, n words), those above the limit cut at sentence ends."""
    return _parts(limit)(c)


def laid(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after the other, and where each text begins, with the end of the last; no text may be null."""
    _, at, data = x.buffers()
    at = np.frombuffer(at, np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64) if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def texts(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts that laid() has laid out."""
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most STEP bytes of text; a longer text stands alone."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64))])
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + STEP, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def without_signs(x: pa.Array) -> pa.Array:
    """The texts with another control in place of OPEN and CLOSE. Lengths stay, and no pattern tells one control from the other."""
    data, at = laid(x)
    signs = (data == ord(OPEN)) | (data == ord(CLOSE))
    return texts(np.where(signs, np.uint8(3), data), at) if signs.any() else x


def found(x: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Where every match begins and ends, counted in bytes of all the texts one after the other. x holds no OPEN and no CLOSE."""
    hit = pc.match_substring_regex(x, pattern)
    data, at = laid(pc.replace_substring_regex(x.filter(hit), pattern, rf"{OPEN}\0{CLOSE}"))
    begins, ends = np.flatnonzero(data == ord(OPEN)), np.flatnonzero(data == ord(CLOSE))
    row = np.searchsorted(at, begins, side="right") - 1
    signs = 2 * (np.arange(len(begins)) - np.searchsorted(begins, at[row]))  # in the text before the match
    moved = laid(x)[1][np.flatnonzero(hit)][row] - at[row] - signs
    return begins + moved, ends + moved - 1

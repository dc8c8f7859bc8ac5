"""Language identification: nearest of several clustered TF-IDF n-gram centroids per language, with rejection by distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.common import body, fold, slices, text_bytes, with_columns

#: Buckets of hashed letter trigrams, centroids per language, and the most labelled rows per language that they are
#: clustered from. Document frequencies are counted over every training row.
DIMS, CENTROIDS, SAMPLE = 4096, 3, 400
#: A text is rejected below this share of the cosine that QUANTILE of the sampled texts of its length stay under.
SLACK, QUANTILE = 0.5, 0.01
#: Texts of fewer trigrams are judged by short pieces of the sampled texts, and by this quantile of theirs: pieces of junk
#: among the texts, at a cosine near 0, are more than QUANTILE of them.
PIECES, SHORT = 64, 0.05
UNKNOWN = "und"
#: Most texts whose vectors are held at a time, and the inner column that says whether a text has a letter.
ROWS, LETTERS = 512, "__letters"

#: Letters in lower case; every other ASCII byte is a blank; other bytes stand for themselves.
_LETTER = np.full(256, 32, np.int64)
_LETTER[128:] = np.arange(128, 256)
_LETTER[97:123] = _LETTER[65:91] = np.arange(97, 123)


def counts(texts: pa.Array) -> np.ndarray:
    """Letter trigrams of each text by hash; a run of letters has a blank on either side."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    size = np.diff(at)
    padded = np.full(len(data) + 2 * n, 32, np.int64)
    owner = np.repeat(np.arange(n), size + 2)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n), size) + 1] = _LETTER[data]
    if len(padded) < 3:
        return np.zeros((n, DIMS), np.float32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    use = b != 32
    code = (a * 65536 + b * 256 + c)[use] * 0x9E3779B1 & 0xFFFFFFFF
    return np.bincount(owner[1:-1][use] * DIMS + (code >> 20), minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def vectors(grams: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(grams) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def _buckets(grams: np.ndarray) -> np.ndarray:
    """Length class of each text: log2 of its trigrams."""
    return np.minimum(20, np.log2(1 + grams.sum(axis=1)).astype(int))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS + 1, np.int64)
    for whole in batches:
        for batch in slices(whole, rows=ROWS):
            total[:DIMS] += (counts(batch.column("text")) > 0).sum(axis=0)
            total[DIMS] += batch.num_rows
    seen = np.flatnonzero(total)
    yield pa.record_batch({"dim": pa.array(seen, pa.int64()), "n": pa.array(total[seen], pa.int64())})


def _piece(text: str, size: int) -> str:
    """Whole words from a third of the text on, of about `size` bytes."""
    words = text.split()
    start = end = len(words) // 3
    while end < len(words) and sum(len(w.encode()) + 1 for w in words[start:end]) < size:
        end += 1
    return " ".join(words[start:end])


def _cluster(idf: np.ndarray, centroids: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order")
        grams = counts(pa.array(rows["text"], pa.large_string()))
        v, length = vectors(grams, idf), _buckets(grams)
        centres = v[[0]]
        while len(centres) < min(centroids, len(v)):  # farthest first
            centres = np.vstack([centres, v[(v @ centres.T).max(axis=1).argmin()]])
        for _ in range(10):
            near = (v @ centres.T).argmax(axis=1)
            sums = np.stack([v[near == k].sum(axis=0) if (near == k).any() else centres[k] for k in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        best = (v @ centres.T).max(axis=1)
        for k in range(1, int(np.log2(PIECES))):
            grams = counts(pa.array([_piece(t or "", 5 * 2**k // 4) for t in rows["text"]], pa.large_string()))
            some = grams.any(axis=1)
            best = np.append(best, (vectors(grams[some], idf) @ centres.T).max(axis=1))
            length = np.append(length, _buckets(grams[some]))
        low = [float(np.quantile(best[length == k], SHORT if 2**k < PIECES else QUANTILE)) if (length == k).any() else np.nan for k in range(21)]
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centre": [c.astype(np.float32).tobytes() for c in centres], "low": [low] * len(centres)})

    return fit


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    floor: np.ndarray  # least cosine by length class


def fit(train: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """Learn from (text, lang); rows without a language are no use. Frequencies cover every row; centroids come from a
    hash-chosen sample of about `sample` rows per language, clustered by cosine, one language to a task."""
    rows = train.filter("lang IS NOT NULL").select("text", "lang")
    found = {r.dim: r.n for r in rows.mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()}
    df = np.array([found.get(i, 0) for i in range(DIMS)], float)
    idf = (np.log((1 + found.get(DIMS, 0)) / (1 + df)) + 0.1).astype(np.float32)
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per language, as the model itself has
    order = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30))
    wanted = reduce(lambda other, r: other | ((F.col("lang") == r.lang) & (F.col("order") * r.n < (sample << 30))), sizes, F.lit(False))
    chosen = rows.withColumn("order", order).filter(wanted)
    few = chosen.dropDuplicates(["lang", "text"])
    made = sorted(few.groupBy("lang").applyInPandas(_cluster(idf, centroids), "lang string, centre binary, low array<double>").collect(), key=lambda r: (r.lang, bytes(r.centre)))
    if not made:
        return Model(idf, [], np.zeros((0, DIMS), np.float32), np.zeros(21))
    lows = np.array([r.low for r in made], float)
    floor = np.array([np.nanmin(x) if (~np.isnan(x)).any() else np.nan for x in lows.T])
    known = np.flatnonzero(~np.isnan(floor))
    floor = np.interp(np.arange(21), known, floor[known]) * SLACK
    return Model(idf, [r.lang for r in made], np.stack([np.frombuffer(r.centre, np.float32) for r in made]), floor)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (the language of the nearest centroid), score (its cosine, 0 to 1) and rejected (it is too far
    for a text of its length). A text that is null or has no letter is `und`, score 0, rejected; so is every text when
    nothing was learnt. Columns of docs with those names are replaced; every row stays."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    langs, centres = np.array([*model.langs, UNKNOWN], object), model.centres

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, rows=ROWS):
                grams = counts(batch.column("text"))
                near = vectors(grams, model.idf) @ centres.T if len(centres) else np.zeros((len(grams), 1))
                known = batch.column(LETTERS).to_numpy(zero_copy_only=False).astype(bool) & (len(centres) > 0)
                best = np.where(known, near.argmax(axis=1), len(langs) - 1)
                score = np.where(known, np.clip(near.max(axis=1), 0, 1), 0.0)
                far = ~known | (score < model.floor[_buckets(grams)])
                yield with_columns(batch, names, {"lang_pred": pa.array(langs[best], pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(far)})

    out = T.StructType([*docs.select(*names).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.select(*names, body().rlike(r"\p{L}").alias(LETTERS)).mapInArrow(predict, out)


def trained(docs: DataFrame, folds: int = 5) -> Model:
    """A model of the documents outside fold 0."""
    return fit(docs.filter(fold(folds) != 0))

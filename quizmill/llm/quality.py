"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizmill.llm.common import Words, body, slices, text_bytes, with_columns

#: Hashed words, factors, most sampled rows of each label, passes of the fit, and the score from which a text is good.
DIMS, FACTORS, SAMPLE, PASSES, CUT = 4096, 8, 2000, 12, 0.3
SEED = 3
#: Most texts whose inputs are held at a time, and the inner column of the size that the table tells.
ROWS, TOLD = 512, "__told"

_CLASS = np.zeros((256, 6), np.float32)  # letters, capitals, digits, blanks, line ends, other ASCII
for _k, _codes in enumerate(([*range(65, 91), *range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), (32, 9), (10,), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])):
    _CLASS[list(_codes), _k] = 1
STATS = 20


def features(texts: pa.Array, n_chars: pa.Array | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (log counts of unit length) and structure statistics of each text."""
    raw, at = text_bytes(texts)
    n, size = len(at) - 1, np.diff(at).astype(float)
    words = Words(texts)
    total, owner, h = words.count.astype(float), words.owner, words.hash
    bags = np.bincount(owner * DIMS + (h >> np.uint64(52)).astype(np.int64), minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)
    bags = np.log1p(bags)
    bags /= np.maximum(np.sqrt((bags * bags).sum(axis=1, keepdims=True)), 1e-9)
    of_byte = np.repeat(np.arange(n), np.diff(at))
    kinds = np.stack([np.bincount(of_byte, weights=_CLASS[raw, k], minlength=n) for k in range(6)], axis=1)
    shares = kinds / np.maximum(size, 1)[:, None]
    length = (words.end - words.start).astype(float)
    mean = np.bincount(owner, weights=length, minlength=n) / np.maximum(total, 1)
    spread = np.sqrt(np.maximum(0, np.bincount(owner, weights=length**2, minlength=n) / np.maximum(total, 1) - mean**2))
    order = np.lexsort((h, owner))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kindsof = np.bincount(owner[order][new], minlength=n)
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top = np.zeros(n)
    np.maximum.at(top, owner[order][new], runs)
    again = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n) if len(h) > 1 else np.zeros(n)
    one = np.maximum(total, 1)
    last, first = (words.data[words.end - 1], words.data[words.start]) if len(h) else (np.zeros(0, int), np.zeros(0, int))
    other = _CLASS[:, 5] > 0
    full = np.isin(last, [44, 46, 33, 63])
    told = np.zeros(n) if n_chars is None else np.nan_to_num(np.asarray(n_chars.to_pandas(), float))
    stats = np.column_stack([
        np.log1p(total), np.log1p(size), mean, spread, *shares.T, kindsof / one, top / one, again / one,
        np.bincount(owner, weights=(other[last] & ~full).astype(float), minlength=n) / one, np.bincount(owner, weights=full.astype(float), minlength=n) / one,
        np.bincount(owner, weights=other[first].astype(float), minlength=n) / one, np.bincount(owner, weights=(length == 1).astype(float), minlength=n) / one,
        np.log1p(kinds[:, 4]), total / (1 + kinds[:, 4]) / 100, np.log1p(np.maximum(told, 0)),
    ])
    return bags, stats.astype(np.float32)


@dataclass
class Machine:
    """score = sigmoid(bias + w.x + half of sum over factors of (v.x)^2 - (v^2).(x^2)), linear in the inputs."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def inputs(self, bags: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([bags, np.clip((stats - self.mean) / self.scale, -4, 4) / 4]).astype(np.float32)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.weight + 0.5 * ((x @ self.factor) ** 2 - (x * x) @ (self.factor**2)).sum(axis=1)


def learn(bags: np.ndarray, stats: np.ndarray, label: np.ndarray, passes: int = PASSES) -> Machine:
    """Adaptive-gradient descent on the log loss, labels weighed alike."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(DIMS + STATS, np.float32), (rng.normal(size=(DIMS + STATS, FACTORS)) * 0.05).astype(np.float32), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    x, gw, gv, gb = m.inputs(bags, stats), np.full(DIMS + STATS, 1e-6, np.float32), np.full((DIMS + STATS, FACTORS), 1e-6, np.float32), 1e-6
    even = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    for _ in range(passes):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
            b = x[rows]
            miss = ((1 / (1 + np.exp(-np.clip(m.logit(b), -30, 30))) - label[rows]) * even[rows] / len(rows)).astype(np.float32)
            dw = b.T @ miss + 1e-5 * m.weight
            dv = b.T @ (miss[:, None] * (b @ m.factor)) - ((b * b).T @ miss)[:, None] * m.factor + 1e-5 * m.factor
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + miss.sum() ** 2
            m.weight -= 0.1 * dw / np.sqrt(gw)
            m.factor -= 0.02 * dv / np.sqrt(gv)
            m.bias -= float(0.1 * miss.sum() / np.sqrt(gb))
    return m


def _pack(m: Machine) -> pd.DataFrame:
    return pd.DataFrame({"name": ["bias", "weight", "factor", "mean", "scale"], "value": [np.asarray(v, np.float32).tobytes() for v in (m.bias, m.weight, m.factor, m.mean, m.scale)]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """Learn from docs (doc_id, text, n_chars) with labels (doc_id, quality): about `sample` hash-chosen documents of each
    label (so few that their ids are broadcast), in one task. A document with several labels takes the greatest; null ids and labels are no use. None when a
    label has no document."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = known.groupBy("quality").agg(F.count("*").alias("n"))
    order = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30))
    chosen = known.join(sizes, "quality").withColumn("order", order).filter(F.col("order") * F.col("n") < F.lit(sample << 30)).select("doc_id", "quality", "order")
    size = "n_chars" if "n_chars" in docs.columns else F.length("text").alias("n_chars")
    rows = docs.select("doc_id", body().alias("text"), size)

    def train(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("doc_id").sort_values("order", ignore_index=True)
        whole = pa.record_batch({"text": pa.array(part["text"], pa.large_string()), "n_chars": pa.array(part["n_chars"], pa.float64(), from_pandas=True)})
        made = [features(b.column("text"), b.column("n_chars")) for b in slices(whole, rows=ROWS)]
        label = (part["quality"] == part["quality"].max()).to_numpy(float)
        if label.all():
            return pd.DataFrame({"name": [], "value": []})
        return _pack(learn(np.vstack([a for a, _ in made]), np.vstack([b for _, b in made]), label))

    found = {r.name: np.frombuffer(r.value, np.float32) for r in rows.join(F.broadcast(chosen), "doc_id").withColumn("task", F.lit(0)).groupBy("task").applyInPandas(train, "name string, value binary").collect()}
    return Machine(float(found["bias"][0]), found["weight"], found["factor"].reshape(-1, FACTORS), found["mean"], found["scale"]) if found else None


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs with `score`, 0 to 1. Null and empty texts are scored by their (zero) inputs; without a machine all are 0.5."""
    size = F.col("n_chars") if "n_chars" in docs.columns else F.length("text")
    names = [c for c in docs.columns if c != "score"]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, rows=ROWS):
                logit = machine.logit(machine.inputs(*features(b.column("text"), b.column(TOLD)))) if machine else np.zeros(b.num_rows)
                yield with_columns(b, names, {"score": pa.array(1 / (1 + np.exp(-np.clip(logit.astype(float), -30, 30))))})

    out = T.StructType([*docs.select(*names).schema.fields, T.StructField("score", T.DoubleType())])
    return docs.select(*names, size.cast("double").alias(TOLD)).mapInArrow(predict, out).select(*docs.columns, *(["score"] if "score" not in docs.columns else []))

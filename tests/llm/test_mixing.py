"""mix() against a plain loop, and its odd inputs."""

import pytest
from pyspark.sql import functions as F

from quizmill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, target int"


def plain_targets(sizes: dict, weights=(1, 2, 3), most=3) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free -= over
    return out


def rows(spark):
    texts = {"a": 40, "b": 3, None: 11, "d": 300, "e": 1, "f": 0}
    data = [(i * 10 + k, " ".join(["w"] * (1 + i % 4)) if s != "f" else None, s, 1, 2) for k, (s, n) in enumerate(texts.items()) for i in range(max(n, 1))]
    return data + [data[0], data[0], (None, "x y", "a", 1, 1), (None, None, None, 1, 1)]


def test_targets_and_cuts(spark):
    data = rows(spark)
    got = mixing.mix(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, source, *_ in data:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for source, n in taken.items():
        assert n == int(want[source] + 1e-9)


def test_reruns_agree_and_empty(spark):
    df = spark.createDataFrame(rows(spark), SCHEMA)
    a, b = (sorted(map(repr, mixing.mix(x).collect())) for x in (df, df.repartition(7)))
    assert a == b
    assert mixing.mix(df.filter("false")).count() == 0
    assert mixing.mix(df.withColumn("text", F.lit(" "))).agg(F.sum("taken")).first()[0] == 0

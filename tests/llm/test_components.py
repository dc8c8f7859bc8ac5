"""Components of stars, chains and random graphs against union by hand."""

import random

from quizmill.llm.components import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components(spark):
    rnd = random.Random(3)
    names = list({rnd.randrange(-(1 << 62), 1 << 62) for _ in range(900)})
    rnd.shuffle(names)
    chain = list(zip(names[:300], names[1:300]))
    star = [(names[300], x) for x in names[301:500]]
    loose = [(names[500 + rnd.randrange(400)], names[500 + rnd.randrange(400)]) for _ in range(220)]
    edges = chain + star + [(a, b) for a, b in loose if a != b] + chain[:5]
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == plain(edges)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0

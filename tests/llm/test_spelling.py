"""Spelling variants against plain versions."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from quizmill.llm import queries, spelling
from tests.llm.conftest import plain


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_near(words):
    """Pairs one edit away by shared deletions, checked letter by letter."""
    bins = collections.defaultdict(set)
    for w in words:
        for cut in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            bins[cut].add(w)
    near = collections.defaultdict(set)
    for group in bins.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    return near


def plain_variants(docs, length=5, often=3):
    n = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = plain(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= length and c >= often}
    near = plain_near(words)
    form = {}
    for w, c in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * c else None
    out = []
    for w, c in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("letters,size", [("ab", 4), ("abc", 9), ("aéß÷", 6), ("a", 12)])
def test_the_index_finds_every_word_with_one_error(letters, size):
    rng = random.Random(size)
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(2, size))) for _ in range(150)})
    index = spelling.Vocabulary(words)
    asked = words + ["zz", "abz", "zba"]
    for mirrored in (False, True):
        query, word = index.near(asked, mirrored)
        got = collections.Counter((asked[q], words[w]) for q, w in zip(query, word))
        want = set()
        for q in asked:
            h = len(q) // 2
            want |= {(q, w) for w in words if one_edit(q, w) and (w.endswith(q[h:]) if mirrored else w.startswith(q[:h]))}
        # an edit at the split may be read on either side of it
        assert set(got) <= {(q, w) for q in asked for w in words if one_edit(q, w)}
        assert want <= set(got) and max(got.values(), default=1) == 1


def test_intervals_of_both_indexes_stay_level():
    words = ["banana", "bandana", "ban", "anab"]
    index = spelling.Vocabulary(words)
    front, back = index.halves
    text = ["$" + w + "$" for w in words]
    for pattern in ("an", "ana", "ban", "b"):
        codes = index.symbols(spelling._codes([pattern])[0])
        a, b, size = (spelling.np.array([x]) for x in (0, 0, len(front.last)))
        for c in codes[::-1]:
            a, b, size = spelling._extended(front, spelling.np.array([c]), a, b, size)
        x, y, level = (spelling.np.array([v]) for v in (0, 0, len(front.last)))
        for c in codes:
            y, x, level = spelling._extended(back, spelling.np.array([c]), y, x, level)
        assert (a[0], b[0], size[0]) == (x[0], y[0], level[0])
        assert size[0] == sum(t.startswith(pattern, i) for t in text for i in range(len(t)))


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_near_words_at_any_block_size(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(400)}
    words |= {"shared" + "".join(rng.choice("xyz") for _ in range(3)) for _ in range(20)} | {"q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1500}
    n = {w: i + 1 for i, w in enumerate(sorted(words))}
    got = spelling.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), block).collect()
    near = plain_near(n)
    assert collections.Counter((r.word, r.near, r.near_n) for r in got) == collections.Counter((a, b, n[b]) for a in near for b in near[a])


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w36"), ("y", "w37")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {a: "w37" for a, _ in forms}


def test_odd_rows(spark, odd, odd_rows):
    assert rows_of(spelling.variants(odd)) == plain_variants([(r[0], r[1]) for r in odd_rows])
    assert rows_of(spelling.variants(odd, 1, 1)) == plain_variants([(r[0], r[1]) for r in odd_rows], 1, 1)
    assert spelling.variants(odd.filter("false")).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling(spark, sf)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = plain_variants(docs)
    assert rows_of(got) == want and sum(bool(r[1]) for r in want) > 50 and any(r[1] != r[2] and r[1] for r in want)
    assert got.filter(F.length("word") < 5).count() == 0

"""Cross-tokenizer alignment against a plain version on the libraries' own output."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from quizmill.llm import alignment, bpe, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
LETTERS = bpe.byte_letters()


def tokens(text):
    """(id, bytes) of both sides, or nothing."""
    whole = (" " + (text or "")).encode()
    a = [(i, bytes(LETTERS[c] for c in A.id_to_token(i))) for i in A.encode(whole.decode(), add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text or "")]
    good = text and b"".join(t for _, t in a) == whole == b"".join(t for _, t in b)
    return (a, b) if good else ([], [])


def spans(side):
    out, at = [], 0
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def plain_alignment(rows):
    told, total = [], collections.Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(text))
        links, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        total.update(links)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        text_of = []
        if cuts:
            x = y = 0
            for cut in cuts:
                left, right = [], []
                while x < len(a) and a[x][2] <= cut:
                    left.append(str(a[x][0]))
                    x += 1
                while y < len(b) and b[y][2] <= cut:
                    right.append(str(b[y][0]))
                    y += 1
                text_of.append(",".join(left) + "|" + ",".join(right))
        told.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text_of).encode()).hexdigest() if cuts else ""))
    high = collections.Counter()
    for (_, b), n in total.items():
        high[b] = max(high[b], n)
    return collections.Counter((d, na, nb, ng, len(ls), sum(total[x] == high[x[1]] for x in ls), sum(total[x] for x in ls), sha) for d, na, nb, ng, ls, sha in told)


def digest(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    return collections.Counter(tuple(r) for r in queries.op13_alignment(spark, "").collect())


TEXTS = [None, "", " ", "  two  blanks ", "a", "é漢\U0001f600 x", "▁ is a blank to one side", "<s> <|endoftext|> <0x41> </s> <unk>", "tab\tand\nline\r\n", "\x00 nul", "the the the the", "the  the", "aaaaaaaaaaaaaaaaaaaaaaaa", "ﬁ ｆｕｌｌ １２", "unbelievable tokenizations", "word " * 3000, "​﻿"]


def test_odd_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "the the"), (900, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert digest(spark, docs, monkeypatch) == plain_alignment(rows)


def test_groups_and_links_of_given_lengths():
    size_a, size_b = pa.array([0, 1, 2, 3], pa.int32()), pa.array([0, 1, 2, 3, 4], pa.int32())
    a, b = pa.array([[1, 2, 3], [], [3]], pa.list_(pa.int32())), pa.array([[3, 1, 2], [], [1, 2]], pa.list_(pa.int32()))
    got = alignment.Aligned(a, b, size_a, size_b)
    assert got.groups().to_pylist() == [[{"a": [1, 2], "b": [3]}, {"a": [3], "b": [1, 2]}], [], [{"a": [3], "b": [1, 2]}]]
    assert sorted((d, p >> 32, p & 0xFFFFFFFF) for d, p in zip(got.doc.tolist(), got.pair.tolist())) == [(0, 1, 3), (0, 2, 3), (0, 3, 1), (0, 3, 2), (2, 3, 1), (2, 3, 2)]
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["n"] for r in got.counts().to_pylist()} == {(1, 3): 1, (2, 3): 1, (3, 1): 2, (3, 2): 2}
    assert got.group_texts().to_pylist() == ["1,2|3;3|1,2", "", "3|1,2"]
    again = alignment.Aligned(*got.marked(), size_a, size_b, marked=True)
    assert again.groups() == got.groups() and again.pair.tolist() == got.pair.tolist() and again.doc.tolist() == got.doc.tolist()
    assert got.counts(np.array([False, True, True])).to_pylist() == [{"pair": 3 << 32 | 1, "n": 1}, {"pair": 3 << 32 | 2, "n": 1}]
    later = [x.slice(1) for x in got.marked()]
    assert alignment.Aligned(*later, size_a, size_b, marked=True).group_texts().to_pylist() == ["", "3|1,2"]
    cut = alignment.Aligned(a.slice(1), b.slice(1), size_a, size_b)
    assert cut.groups().to_pylist() == [[], [{"a": [3], "b": [1, 2]}]]


def test_odd_rows(spark, odd, odd_rows, monkeypatch):
    assert digest(spark, odd, monkeypatch) == plain_alignment([(r[0], r[1]) for r in odd_rows])
    assert digest(spark, odd.filter("false"), monkeypatch) == collections.Counter()


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_alignment(spark, sf)
    assert all(kind == "bigint" for name, kind in got.dtypes if name != "groups_sha256")
    assert collections.Counter(tuple(r) for r in got.collect()) == plain_alignment(rows)


def test_groups_spell_the_text(spark):
    left, right = bpe.Decoder(bpe.read(alignment.LEFT)), alignment.Pieces(bpe.read(alignment.RIGHT))
    row = alignment.align(spark.createDataFrame([(1, "Some naïve façade, well-formed.")], "doc_id long, text string")).first()
    sides = [b"".join(table[i] for g in row.groups for i in g[side]) for side, table in (("a", left.bytes), ("b", right.bytes))]
    assert sides[0] == sides[1] == " Some naïve façade, well-formed.".encode()

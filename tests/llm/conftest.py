"""Odd rows that every operator must take."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, gone string, score string, text_key int, held_out string, block int, size int, word string"


def plain(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, wordless and very long texts, ties and repeated rows; columns named like inner ones."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron".split()
    story = " ".join(words[i * 7 % 15] + str(i % 11) for i in range(120))
    texts = [None, "", " \n\t ", "One", "one two three", "ONE two three", story, story + " end", story.upper(), story, "line shared by all\n" + story[:300] + "\nÉté ß 漢字 \U0001f600 x"]
    texts += [f"the line on every site\nown words {i} of this page\nthe line on every site\nsecret: abcdef{i}0123456789" for i in range(12)]
    texts += [" ".join(words[i * i % 15] for i in range(30000)), "\n".join(["the line on every site"] * 500)]
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 12}", len(t or ""), *("x" if k in (1, 2, 4, 7) else 5 for k in range(8))) for i, t in enumerate(texts)]
    blank = (None,) * 8
    return rows + [rows[6], rows[6], (None, None, None, None, None, *blank), (None, story, "en", None, None, *blank), (900, story, None, None, None, *blank)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()

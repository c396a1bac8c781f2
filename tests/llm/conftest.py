"""Small hand-made tables with nulls, empty and very long texts, ties, repeated rows and clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, id long, n string, hash string, component string"


def word(rng):
    return "".join(rng.choice(["an", "tor", "wé", "li", "Qu", "ß", "x9", "the"]) for _ in range(rng.randint(1, 3)))


def make_docs(seed=1, n=60):
    rng = random.Random(seed)
    base = [[word(rng) for _ in range(rng.randint(12, 90))] for _ in range(n)]
    texts = [" ".join(b) for b in base]
    for b in base[:15]:  # near copies at many similarities
        for edits in (1, 1, 2, 4):
            c = list(b)
            for _ in range(edits):
                c[rng.randrange(len(c))] = word(rng) + "q"
            texts.append("\n".join(c))
    texts += [texts[3].upper(), texts[4], None, "", " \t\n", "one two", "One  TWO", "a b c d", "12 345 !!", "<|endoftext|> x",
              "word " * 5, " ".join(word(rng) for _ in range(40_000)), "y" * 200_000]
    rows = [(i, t, None if i % 11 == 0 else ("aa", "bb")[i % 2], "s", 7, "n", "h", "c") for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, texts[5], "aa", "s", 7, "n", "h", "c"), (None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)

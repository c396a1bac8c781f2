import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm import hashing, tokens, urls
from offerlake.llm.common import gapless_rank, word_count
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_words_and_hashes_equal_a_plain_split(piece):
    texts = [r[1] for r in make_docs()]
    hashes, words = {}, {}
    for part in hashing.words_of(pa.array(["skip", *texts])[1:], piece=piece):
        counts, at = part.counts(), 0
        for row, text in enumerate(texts[part.low:part.high]):
            expected = WORD.findall((text or "").translate(LOWER))
            assert counts[row] == len(expected)
            for w in expected:
                h = int(part.hash[at])
                assert hashes.setdefault(w, h) == h and words.setdefault(h, w) == w
                at += 1


def test_word_count_in_sql(spark, docs):
    for text, n in docs.select("text", word_count(F.col("text"))).collect():
        assert n == len(WORD.findall(text or ""))


def test_gapless_rank(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") % 7).alias("c"))
    rows = gapless_rank(df, ["g"], "c", ["id"], "r").collect()
    for g in range(3):
        assert sorted(r.r for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    rows = tokens.token_counts(docs, batch_bytes=500).collect()
    expected = sorted((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()),
                       len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in rows) == expected
    assert all(r.over_limit == (r.n_tokens > 1024) for r in rows) and any(r.over_limit for r in rows)


def test_token_counts_of_odd_characters():
    import random

    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    counter, tokenizer = tokens.Counter(path, tokens.whole_tokens(path)), Tokenizer.from_file(path)
    rng = random.Random(3)
    parts = ["a", "é", "<|endoftext|>", " ", "  ", "\n", "\x1c", "\x85", "\u3000", "1", "'s", "!", "中", "\u0558", "\u1c89", "\U0001f600", "\xa0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert counter.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_tokens_each_encode_alone():
    from tokenizers import Tokenizer

    tokenizer, whole = Tokenizer.from_file(tokens.tokenizer_path()), tokens.whole_tokens(tokens.tokenizer_path())
    assert len(whole) > 40_000 and " the" in whole
    assert all(len(tokenizer.encode(w, add_special_tokens=False).ids) == 1 for w in list(whole)[:2000])


def test_token_counts_of_no_rows(no_docs):
    assert tokens.token_counts(no_docs).collect() == []


def test_url_rules_and_terms(spark):
    cases = [
        (1, "https://A.Example.NET/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://foo.net", "foo.net", "", None, "allow"),
        (3, "http://foo.net/", "foo.net", "/", "net/", "block"),
        (4, "http://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"),
        (5, "http://x.org/casino", "x.org", "/casino", None, "block"),
        (6, "http://x.org/casinos", "x.org", "/casinos", None, "allow"),
        (7, "http://free-bets.com/a?b#c", "free-bets.com", "/a", None, "block"),
        (8, "http://free.com/free/free", "free.com", "/free/free", None, "allow"),
        (9, "ftp:no-scheme.net/", "", "", None, "allow"),
        (10, None, "", "", None, "allow"),
        (11, "http://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (12, "http://example.com/de/?x=/", "example.com", "/de/", "example.com/de/", "block"),
        (13, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (13, "a://b://c/d", "b:", "//c/d", None, "allow"),
        (None, "", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(c[0], c[1], "h", "v") for c in cases], "page_id long, url string, host string, verdict string")
    key = lambda r: (r[0] is None, r[0] or 0)
    rows = sorted((tuple(r)[:5] for r in urls.judge_urls(pages).collect()), key=key)
    assert rows == [(c[0], *c[2:]) for c in cases]
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_long_array_keeps_all_bits():
    values = np.array([0, 1, (1 << 64) - 1], np.uint64)
    assert hashing.long_array(values).to_pylist() == [0, 1, -1]


def test_vocabulary_from_a_table(spark):
    table = spark.createDataFrame([("Casino", 1.0), ("win", 0.3), ("win", 0.5), (" bonus ", 0.4), (None, 1.0), ("", 1.0), ("both", 0.2), ("BOTH", 2.0), ("loose", None)],
                                  "term string, weight double")
    strict, soft = urls.vocabulary(table)
    assert (strict, soft) == (["both", "casino"], ["bonus", "loose", "win"])
    pages = spark.createDataFrame([(1, "http://a.b/CASINO"), (2, "http://a.b/win"), (3, "http://a.b/win-bonus?" + "x" * 300_000), (4, None), (5, "http://a.b/casinos"),
                                   (6, "http://a.b/" + "y" * 300_000 + "/both")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.strict_hits, r.soft_hits) for r in urls.judge_urls(pages, strict=strict, soft=soft).collect()}
    assert got == {1: ("block", 1, 0), 2: ("allow", 0, 1), 3: ("block", 0, 2), 4: ("allow", 0, 0), 5: ("allow", 0, 0), 6: ("block", 1, 0)}
    assert {r.verdict for r in urls.judge_urls(pages, strict=[], soft=[]).collect()} == {"allow"}

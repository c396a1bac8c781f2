import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from offerlake.llm import ann, langid, lm
from tests.conftest import SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def remainder(i, m):
    return -1 if i is None else zlib.crc32(str(i).encode()) % m


def plain_model(rows):
    """(unigram counts, probability of token after context) by the textbook formulas."""
    count, pairs = Counter(), Counter()
    for words in rows:
        count.update(words)
        pairs.update(zip([None, *words[:-1]], words))
    after, before = defaultdict(Counter), Counter()
    for (v, w), n in pairs.items():
        after[v][w] = n
        before[w] += 1

    def discounts(values):
        n = [sum(x == k for x in values) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        return [0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0), k) if n[k - 1] else k / 2 for k in (1, 2, 3))]

    d2, d1, all_ = discounts(pairs.values()), discounts(before.values()), sum(before.values())
    rest = sum(d1[min(x, 3)] for x in before.values()) / all_

    def one(w):
        return max(before[w] - d1[min(before[w], 3)], 0) / all_ + rest / (len(count) + 1)

    def two(v, w):
        if v not in after:
            return one(w)
        total = sum(after[v].values())
        c = after[v][w]
        return max(c - d2[min(c, 3)], 0) / total + sum(d2[min(x, 3)] for x in after[v].values()) / total * one(w)

    return count, two


def test_scores_equal_the_textbook(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "HELD_TOKENS", 3000)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm.score_texts(docs, train).collect()
    rows = [(r.doc_id, WORD.findall((r.text or "").translate(LOWER)) + ["</s>"]) for r in docs.select("doc_id", "text").collect()]
    count, two = plain_model([w for i, w in rows if remainder(i, 7) != 2])
    tokens, types = sum(count.values()), len(count)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    want = sorted(((i, remainder(i, 7) == 2, len(w), sum(count[x] > 0 for x in w), tokens,
                    sum(math.log10((count[x] + 1) / (tokens + types + 1)) for x in w),
                    sum(math.log10(two(v, x)) for v, x in zip([None, *w[:-1]], w))) for i, w in rows), key=key)
    got = sorted((tuple(r)[:7] for r in got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    some = next(iter(count))
    assert sum(two(some, w) for w in count) + two(some, "never seen") == pytest.approx(1)


def test_scores_of_no_rows_and_without_training(spark, docs, no_docs):
    assert lm.score_texts(no_docs, F.lit(True)).collect() == []
    rows = lm.score_texts(docs.limit(20), F.lit(False)).collect()
    assert len(rows) == 20 and all(r.score == 0 and r.held_out and r.train_tokens == 0 for r in rows)


def test_parts_grow_with_the_input(spark, docs, monkeypatch):
    texts = docs.where("doc_id < 60")
    scores = lambda: sorted((r.doc_id, r.n_known, round(r.score, 6)) for r in lm.score_texts(texts, F.col("doc_id") % 3 != 0).collect())
    usual = scores()
    monkeypatch.setattr(lm, "PART_BYTES", 400, raising=False)
    size = sum(len((r.text or "").encode()) for r in texts.collect())
    assert lm.fit(texts)[1] == -(-size // 400) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scores() == usual


def test_packed_arrays():
    arrays = [np.array([], np.uint64), np.array([1, 2, 255]), np.array([1 << 63], np.uint64), np.array([70_000])]
    back = lm.unpacked(lm.packed(*arrays))
    assert [b.tolist() for b in back] == [a.tolist() for a in arrays] and back[1].itemsize == 1


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumns({"score": F.lit(1), "held_out": F.lit("x")})
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = langid.identify(docs, train).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 3) == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 30
    kept = langid.keep_identified(docs, train)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(truth)


def test_language_of_odd_texts(spark, docs, no_docs):
    rows = {r.doc_id: r for r in langid.identify(docs, F.lit(True)).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        if not t or not any(c.isalpha() for c in t):
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
        else:
            assert rows[i].lang_pred in ("aa", "bb", "und")
    assert langid.identify(no_docs, F.lit(True)).collect() == []
    assert {r.lang_pred for r in langid.identify(docs, F.lit(False)).collect()} == {"und"}


def test_backoff_goes_from_words_to_shorter_grams():
    table = np.array([[-1.0, -7.0], [-2.0, -7.0], [-7.0, -0.5]], np.float32)
    s = langid.Scorer(["x", "y"], 1, pa.chunked_array([["the", "abc", "a"]]), table)
    assert s.predict("THE the")[0] == "x" and s.predict("zabcz")[0] == "x" and s.predict("za")[0] == "y"
    assert s.predict("zzz") == ("und", 0.0) and s.predict("1 2") == ("und", 0.0)
    assert s.predict("the")[1] == pytest.approx(1 / (1 + 10 ** -6))


def plain_langid(rows, longest=5, penalty=-7.0, weight=10):
    """Predictions of every text from the labelled ones, with dicts only."""
    words = defaultdict(Counter)
    for _, text, lang in rows:
        if text is not None and lang is not None:
            words[lang].update(re.findall(r"[^\W\d_]+", text.lower()))
    langs = sorted(lang for lang in words if words[lang])
    counts = [{lang: Counter() for lang in langs} for _ in range(longest + 1)]
    for lang in langs:
        for w, n in words[lang].items():
            counts[0][lang][w] += n
            padded = f" {w} "
            for k in range(1, longest + 1):
                for i in range(len(padded) - k + 1):
                    counts[k][lang][padded[i:i + k]] += n
    known = [set().union(*(c.keys() for c in by.values())) for by in counts]
    all_ = [{lang: sum(c.values()) for lang, c in by.items()} for by in counts]

    def logs(k, s):
        return [math.log10(counts[k][lang][s] / all_[k][lang]) if counts[k][lang][s] else penalty for lang in langs]

    def scores(w):
        if w in known[0]:
            return logs(0, w)
        for k in range(longest, 0, -1):
            grams = [g for i in range(len(w) + 3 - k) if (g := f" {w} "[i:i + k]) in known[k]]
            if grams:
                return [sum(x) / len(grams) for x in zip(*(logs(k, g) for g in grams), strict=True)]
        return None

    out = []
    for _, text, _ in rows:
        found = [(n, x) for w, n in Counter(re.findall(r"[^\W\d_]+", (text or "").lower())).items() if (x := scores(w)) is not None]
        total = sum(n for n, _ in found)
        if not total:
            out.append(("und", 0.0))
            continue
        mean = [sum(n * x[i] for n, x in found) / total for i in range(len(langs))]
        best = max(range(len(langs)), key=lambda i: (mean[i], -i))
        out.append((langs[best], 1 / sum(10 ** ((m - mean[best]) * min(total, weight)) for m in mean)))
    return out


def test_language_scores_equal_plain_python(spark):
    source = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame([(90_001, "abc", "e1"), (90_002, "xyz", "f1"), (90_003, "xyz", None), (90_004, "zzy abd", None), (90_005, "", "e1"),
                                   (90_006, "the été ß", None), (90_007, "the the", "g1"), (90_008, None, "h1")], source.schema)
    docs = source.unionByName(extra)
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, F.lit(True)).collect()}
    for (i, text, _), (lang, score) in zip(rows, plain_langid(rows), strict=True):
        assert got[i][1] == pytest.approx(score, abs=1e-4) and (got[i][0] == lang or score < 0.51), (i, got[i], lang, score)
    assert got[90_003][0] == "f1"  # a word seen once


def test_keep_identified_on_odd_rows(spark, docs, no_docs):
    clash = docs.withColumnsRenamed({"id": "held_out", "n": "lang_pred", "hash": "_text"})
    found = langid.identify(clash, F.lit(True)).select("doc_id", "lang_pred", "score").collect()
    want = Counter(r.doc_id for r in found if r.lang_pred != "und" and r.score >= 0.5)
    kept = langid.keep_identified(clash, F.lit(True))
    assert kept.columns == clash.columns and Counter(r.doc_id for r in kept.collect()) == want
    assert langid.keep_identified(no_docs, F.lit(True)).collect() == []


def test_a_missing_model_file_is_an_error(spark, docs, tmp_path):
    texts = docs.where("doc_id < 40")
    folder, parts, sums = lm.fit(texts, model_dir=str(tmp_path / "m"))
    lm.Model(folder, parts, sums)
    (tmp_path / "m" / f"words-{sums['word_parts'][0]}.npy").unlink()
    with pytest.raises(FileNotFoundError):
        lm.Model(folder, parts, sums)


def test_model_folder_has_to_be_mounted(spark, monkeypatch):
    assert lm.model_folder(spark).startswith("/")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    monkeypatch.setattr(lm, "scratch_path", lambda *_: "/shared/folder")
    try:
        conf.set("fs.defaultFS", "viewfs://cluster/")
        conf.set("fs.viewfs.mounttable.cluster.link./shared", "file:///tmp")
        with pytest.raises(ValueError, match="no mounted path"):
            lm.model_folder(spark)
    finally:
        conf.set("fs.defaultFS", before)


def vectors(n=1500, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.6 * rng.normal(size=(n, dim))).astype(np.float32)
    x[200:260] = x[200]  # one common vector
    rows = [(i, [float(v) for v in x[i]], 1, "r") for i in range(n)]
    rows[5] = (5, None, 1, "r")
    rows[50] = (50, [0.0] * dim, 1, "r")
    rows[7] = (7, [None] + rows[7][1][1:], 1, "r")
    rows[100] = (100, [float("nan")] + rows[100][1][1:], 1, "r")
    rows[9] = (9, [float("inf")] + rows[9][1][1:], 1, "r")
    return [*rows, rows[60], rows[61], (None, rows[61][1], 1, "r"), (n, [], 1, "r"), (n + 50, [1.0, 2.0], 1, "r")], x


VECTORS = "vec_id long, embedding array<float>, label int, rank string"


@pytest.mark.parametrize("shard_rows", [400, 4096])
def test_nearest_against_brute_force(spark, shard_rows):
    rows, x = vectors()
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, VECTORS), shard_rows=shard_rows).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    out = {5, 50, 7, 100, 9}
    ids = np.array([i for i in range(len(x)) if i not in out])
    unit = x[ids].astype(float) / np.linalg.norm(x[ids].astype(float), axis=1, keepdims=True)
    queries = [i for i in ids if i % 50 == 0]
    assert sorted(got) == queries  # the two vectors of another dimension have no neighbour
    found = 0
    for q in queries:
        score = unit @ unit[np.flatnonzero(ids == q)[0]]
        score[ids == q] = -9
        order = np.lexsort((ids, -np.round(score, 12)))[:5]
        near = sorted(got[q])
        assert [n[0] for n in near] == [1, 2, 3, 4, 5] and len({n[1] for n in near}) == 5
        by_id = dict(zip(ids.tolist(), score.tolist(), strict=True))
        assert all(n[2] == pytest.approx(by_id[n[1]], abs=1e-12) for n in near)
        assert [(-round(n[2], 12), n[1]) for n in near] == sorted((-round(n[2], 12), n[1]) for n in near)
        found += len({n[1] for n in near} & set(ids[order].tolist()))
    assert found >= 0.95 * 5 * len(queries)
    assert [n[1] for n in sorted(got[200])] == [201, 202, 203, 204, 205]
    assert [n[1] for n in sorted(got[250])] == [200, 201, 202, 203, 204]


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in ann.nearest(df).collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert ann.nearest(df.limit(0)).collect() == []
    assert ann.nearest(df.where("vec_id = 1")).collect() == []


def test_rows_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(50, 1, 1), (50, 1, 2), (50, 2, 1), (50, 2, 2)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    assert sorted(r.vec_id for r in got) == [1, 1, 2, 2, 50, 50]


def test_blocks_of_queries_give_the_same(spark):
    rows, _ = vectors(n=700)
    df = spark.createDataFrame(rows, VECTORS)
    one, many = (sorted(map(tuple, ann.nearest(df, query_block=b).collect())) for b in (8192, 3))
    assert [r[:3] for r in one] == [r[:3] for r in many]


def test_pruning_keeps_diverse_edges():
    unit = np.array([[1, 0], [0.999, 0.04], [0.998, 0.06], [0, -1]], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    kept = ann.prune(unit, np.array([0]), np.array([[0, 1, 2, 3, 3, -1]]), 1.0, 3)[0]
    assert kept.tolist() == [1, 3, 4]

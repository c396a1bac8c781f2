import random
import re
from collections import defaultdict

import numpy as np
import pytest

from offerlake.llm import neardup
from offerlake.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    """{id: (set sizes, smallest id reachable)} by comparing every two rows."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for k, (a, s) in enumerate(sets) for b, t in sets[:k]
             if s and t and 100 * len(s & t) >= percent * len(s | t)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("percent", [85, 80, 50])
def test_components_equal_brute_force(docs, percent):
    rows = docs.select("doc_id", "text").collect()
    bands = (60, 2) if percent == 50 else (neardup.BANDS, neardup.BAND_ROWS)
    got = neardup.near_duplicates(docs, percent, bands=bands[0], band_rows=bands[1], block=4).collect()
    label = brute([tuple(r) for r in rows], percent)
    assert len(got) == len(rows)
    sizes = defaultdict(set)
    for r in rows:
        sizes[r.doc_id].add(len(shingle_set(r.text)))
    for r in got:
        assert r.n_shingles in sizes[r.doc_id]
        assert r.component_id == label.get(r.doc_id) and r.kept == (r.doc_id is None or r.component_id == r.doc_id)
    assert len(set(label.values())) < len(label) - 10


def test_large_group_with_a_border(spark):
    """A bucket whose members link through others than its smallest id, over several blocks."""
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):  # text i lacks i // 2 words at the front: neighbours are near, the ends are far apart
        rows.append((i, " ".join(base[i // 2:] + [f"t{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = brute(rows, 85)
    got = neardup.near_duplicates(df, 85, block=8).collect()
    assert {r.doc_id: r.component_id for r in got} == label and len(set(label.values())) == 1


def test_no_rows(no_docs):
    assert neardup.near_duplicates(no_docs).collect() == []
    assert neardup.deduplicate(no_docs).collect() == []


def test_nothing_alike(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df).collect()) == [(1, 2, 1, True), (2, 2, 2, True)]


def test_stage_keeps_one_of_each_group(docs):
    rows = docs.select("doc_id", "text").collect()
    label = brute([tuple(r) for r in rows], 80)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(label.values()))
    assert ids.count(None) == 2


def test_signatures_estimate_better_than_independent_ranks():
    rng = np.random.default_rng(0)
    for n in (3, 40, 1500):
        errors = []
        for _ in range(40):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 2, dtype=np.uint64))
            k = len(pool)
            a, b = np.sort(pool[:k * 3 // 4]), np.sort(pool[k // 4:])
            s = neardup.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
            errors.append((s[0] == s[1]).mean() - (len(a) + len(b) - k) / k)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.05


def test_signature_is_of_the_set_alone():
    x = np.arange(1, 50, dtype=np.uint64) * np.uint64(977)
    alone = neardup.superminhash(x, np.array([0, 49]), 64)[0]
    among = neardup.superminhash(np.concatenate([x[:3], x, x[:0], x[::-1]]), np.array([0, 3, 52, 52, 101]), 64)
    assert (among[1] == alone).all() and (among[3] == alone).all() and (among[2] == np.iinfo(np.uint64).max).all()


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (200, 200)] + [(1000, k) for k in range(1001, 1400)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[7] == got[9] == got[5] == 5
    assert all(got[k] == 1000 for k in range(1000, 1400)) and 200 not in got


def test_deduplicate_with_clashing_columns_and_repeated_ids(spark):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    rows = [(1, words(1), 5, "a"), (2, words(1), 5, "b"), (3, words(2), 5, "c"), (3, words(3), 5, "d"), (3, None, 5, "e"), (None, words(1), 5, "f"),
            (None, None, 5, "g"), (4, words(3) + " tail", 5, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept int, row string")
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    # ids 3 and 4 are one group; of the rows of id 3 the one without a text comes first
    assert sorted(r["row"] for r in kept.collect()) == ["a", "e", "f", "g"]
    assert neardup.deduplicate(docs.limit(0)).collect() == []


@pytest.mark.parametrize("block", [4, 256])
def test_a_hot_bucket_of_several_components(spark, block):
    """One bucket holds a large component around its smallest id, and others at every distance from it."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for edits in [0] * 4 + [1] * 30 + list(range(2, 60)) * 2:
        words = list(base)
        for at in rng.sample(range(120), edits):
            words[at] = f"c{rng.randrange(12)}"
        rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, percent=80, bands=20, band_rows=1, block=block).collect()}
    assert got == brute(rows, 80)

import random

import numpy as np
import pyarrow as pa
import pytest

from offerlake.llm import decontam
from offerlake.llm.hashing import words_of


def distance_to_run(item, text):
    """Fewest edits from item to any run of text, by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_best_run_equals_the_plain_recurrence():
    rng = random.Random(1)
    for _ in range(300):
        item = np.array([rng.randint(0, 3) for _ in range(rng.randint(1, 9))], np.uint64)
        text = np.array([rng.randint(0, 3) for _ in range(rng.randint(0, 12))], np.uint64)
        cost, a, b = decontam.best_run(item, text)
        assert cost == distance_to_run(item.tolist(), text.tolist()) and 0 <= a <= b <= len(text)
        full = [[max(i, j) if not i * j else 0 for j in range(b - a + 1)] for i in range(len(item) + 1)]
        for i in range(1, len(item) + 1):
            for j in range(1, b - a + 1):
                full[i][j] = min(full[i - 1][j - 1] + (item[i - 1] != text[a + j - 1]), full[i - 1][j] + 1, full[i][j - 1] + 1)
        assert full[len(item)][b - a] == cost


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [[rng.choice(vocabulary) for _ in range(rng.choice([5, 12, 12, 30, 47]))] for _ in range(40)]
    texts = []
    for i in range(160):
        words = [rng.choice(vocabulary[:20] if i % 3 else vocabulary) for _ in range(rng.randint(0, 80))]
        if i % 2:
            item = list(items[rng.randrange(len(items))])
            for _ in range(rng.randint(0, len(item) // 4)):
                at = rng.randrange(len(item))
                item[at:at + rng.randint(0, 1)] = [f"z{rng.random()}"] * rng.randint(0, 1)
            at = rng.randint(0, len(words))
            words[at:at] = item
        texts.append(" ".join(words))
    return items, texts


def test_finds_what_brute_force_finds(spark, case):
    items, texts = case
    edits = lambda n: decontam.allowed_edits(n)
    expected = {(d, i): c for d, t in enumerate(texts) for i, item in enumerate(items)
                if (c := distance_to_run(item, t.split())) <= edits(len(item))}
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, " ".join(x).upper()) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontam.find_items(docs, bench).collect()}
    assert set(got) <= set(expected)
    assert all(got[k] == 0 for k in expected if expected[k] == 0)
    assert len(got) >= 0.97 * len(expected) and len(expected) > 60
    assert sum(got[k] == expected[k] for k in got) >= 0.97 * len(got)
    clean = {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}


def test_item_blocks_give_the_same_result(spark, case, monkeypatch):
    items, texts = case
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    whole = sorted(tuple(r) for r in decontam.find_items(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 13)
    assert sorted(tuple(r) for r in decontam.find_items(docs, bench).collect()) == whole


def test_one_bounded_block_of_items_at_a_time(spark, case, monkeypatch):
    items, texts = case
    docs = spark.createDataFrame(list(enumerate([*texts, None, texts[1]])), "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    find = lambda: sorted(tuple(r) for r in decontam.find_items(docs, bench).collect())
    clean = lambda: sorted(r.doc_id for r in decontam.drop_contaminated(docs, bench).collect())
    whole = find(), clean()
    context, shared = type(spark.sparkContext), []

    def broadcast(self, value, plain=context.broadcast):
        shared.append((sum(len(t.split()) for t in value[1]), sum(b._jbroadcast.isValid() for _, _, b in shared), plain(self, value)))
        return shared[-1][2]

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 25)
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 100, raising=False)
    assert (find(), clean()) == whole
    assert len(shared) > 12 and max(words for words, _, _ in shared) <= 100 + 47
    assert all(alive == 0 for _, alive, _ in shared)


def test_count_filter_loses_nothing(case):
    items, texts = case
    block = decontam.Items(list(range(len(items))), [" ".join(x) for x in items], 80)
    for words in words_of(pa.array(texts)):
        bounds = np.append(0, np.cumsum(words.counts()))
        start, size = block.windows(words.hash, bounds[words.row + 1])
        passed = set(zip(start.tolist(), size.tolist(), strict=True))
        for row, text in enumerate(texts[words.low:words.high]):
            split = text.split()
            for item in items:
                for at in range(len(split)):
                    window = split[at:at + len(item)]
                    if len(window) >= len(item) - 3 and whole_distance(item, window) <= decontam.allowed_edits(len(item)):
                        assert (bounds[row] + at, len(item)) in passed


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, w in enumerate(a, 1):
        new = [i]
        for j, x in enumerate(b, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_nulls_and_empty_tables(spark, docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one two"), (None, "a b c d e"), (4, "a b c d e")], "item_id long, text string")
    text = docs.where("doc_id = 4").first().text
    more = bench.union(spark.createDataFrame([(5, text)], "item_id long, text string"))
    found = decontam.find_items(docs, more).collect()
    assert {r.doc_id for r in found if r.item_id == 5 and r.edits == 0} >= {4}
    assert not [r for r in found if r.item_id in (1, 2, 3)]
    assert decontam.find_items(no_docs, more).collect() == []
    assert decontam.find_items(docs, bench.limit(0)).collect() == []
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontam.drop_contaminated(docs, more).columns == docs.columns


def changed(item, kind, edits, rng):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        out[at:at + (kind != "insert")] = [] if kind == "delete" else [f"new{rng.random()}"]
    return out


@pytest.mark.parametrize("kind", ["insert", "delete", "substitute"])
@pytest.mark.parametrize("size, trials", [(48, 60), (200, 24), (500, 10), (1500, 4)])
def test_target_recall_with_the_most_edits_at_every_length(size, trials, kind):
    rng = random.Random(size)
    items = [[f"{i}_{rng.randrange(400)}" for _ in range(size)] for i in range(trials)]
    around = lambda: [f"other{rng.random()}" for _ in range(30)]
    texts = [" ".join(around() + changed(item, kind, decontam.allowed_edits(size), rng) + around()) for item in items]
    block = decontam.Items(list(range(trials)), [" ".join(x) for x in items], 80)
    found = {(words.low + row, item): edits for words in words_of(pa.array(texts)) for row, item, _, _, edits, _ in block.find(words)}
    assert set(found) <= {(i, i) for i in range(trials)}
    assert len(found) >= int(decontam.TARGET_RECALL * trials)


def test_short_items_are_found_exactly_where_asked_for(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 14))) for _ in range(80)]
    items = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 2, 2, 3, 3, 4, 4, 4)] + ["", "g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if x and f" {x} " in f" {t} "}
    got = decontam.find_items(docs, bench, min_words=1).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected) > 50
    assert all(r.edits == 0 and " ".join(texts[r.doc_id].split()[r.start_word:r.end_word]) == items[r.item_id] for r in got)
    clean = {r.doc_id for r in decontam.drop_contaminated(docs, bench, min_words=1).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in expected}


def test_dropping_with_clashing_columns_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 1)
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a b {item} c", "x"), (2, "clean text of some words", "y"), (3, None, "z")], "doc_id long, text string, _held string")
    items = spark.createDataFrame([(1, item), (2, "other words that are nowhere to be found")], "item_id long, text string")
    assert sorted(r._held for r in decontam.drop_contaminated(docs, items).collect()) == ["y", "z"]

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from offerlake.llm import bestfit

ODD = ["", " ", "it's I'LL 'SAT ''s don't 'rest 'reSt x'd 1's .'s 'm'm'm '", "Straße ÉCOLE é İstanbul ΣΑΣ 한국어 하",
       "<|endoftext|> a <|ENDOFTEXT|> <|startoftext|>x", "a<|x|>", "１２３ ½ Ⅷ ٣ 12 345", "x y z\u0085w\x1cq\x00", "日本語「」、。",
       "नमस्ते दुनिया", "😀👩‍👩 ‍a​b", "y" * 3000, "Ångstrom Ω ﬁ ſ K", "'ve'VE'll'ld 'l l 've", "..''..'s'", "﻿abc"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bestfit.tokenizer_path())


@pytest.fixture(scope="module")
def coder():
    return bestfit.Coder(bestfit.tokenizer_path())


def same(library, coder, texts):
    ids, bounds = coder.encode(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids + [1], repr(text[:60])


def test_ids_of_odd_texts(library, coder):
    same(library, coder, ODD)
    same(library, coder, ODD[::-1] + ["z" * 3_000_000 + " end", "", "a b"])


def test_memo_is_emptied(library):
    small = bestfit.Coder(bestfit.tokenizer_path())
    for _ in range(3):
        same(library, small, ODD)
        small.forget()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("'sStTrevmldLE .,<|>1\ńÉé"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_ids_of_any_text(texts):
    same(*PAIR, texts)


PAIR = (Tokenizer.from_file(bestfit.tokenizer_path()), bestfit.Coder(bestfit.tokenizer_path()))


def plain(lengths, capacity):
    """Remaining capacities of the bins of best-fit decreasing, one piece at a time."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in bins if r >= n]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


def bins_of(moves, lengths, capacity):
    count, by_length = Counter(lengths), defaultdict(list)
    for m in moves:
        by_length[m[0]].append(m)
    used = defaultdict(dict)
    for n, total in count.items():
        for k in range(total):
            _, first, each, start, offset = [m for m in by_length[n] if m[1] <= k][-1]
            b, inside = divmod(k - first, each)
            assert offset + inside * n not in used[start + b]
            used[start + b][offset + inside * n] = n
    for places in used.values():  # gapless from 0
        at = 0
        for offset in sorted(places):
            assert offset == at
            at += places[offset]
        assert at <= capacity
    return sorted(capacity - sum(p.values()) for p in used.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_moves_are_best_fit_decreasing(lengths, capacity):
    assert bins_of(bestfit.best_fit_decreasing(Counter(lengths), capacity), lengths, capacity) == plain(lengths, capacity)


def test_moves_stay_few():
    rng = np.random.default_rng(1)
    lengths = Counter(np.minimum(4096, rng.lognormal(6, 1.2, 300_000).astype(int) + 1).tolist())
    few, many = (bestfit.best_fit_decreasing({n: c * k for n, c in lengths.items()}) for k in (1, 1000))
    assert len(many) < 2 * len(few) < 100_000


@given(st.sets(st.integers(0, 100)), st.integers(0, 100))
def test_tree_finds_the_tightest(some, need):
    tree = bestfit.CapacityTree(100)
    for s in some:
        tree.mark(s, True)
    assert tree.tightest(need) == min((s for s in some if s >= need), default=None)


def test_packing_of_documents(spark, docs, library):
    pieces = bestfit.tokenized(docs)
    packed = bestfit.pack_best_fit(pieces, cell_rows=7)
    rows = packed.collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = np.array(library.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, low in enumerate(range(0, len(ids), 4096)):
            part = ids[low:low + 4096]
            want[(r.doc_id, k, low, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length, r.ids_crc32))
    assert sorted(4096 - sum(n for _, n, _ in b) for b in bins.values()) == plain([r.length for r in rows], 4096)
    whole = {r.sequence_id: bytes(r.ids) for r in bestfit.sequences(pieces, packed).collect()}
    for s, parts in bins.items():
        at = 0
        for offset, n, crc in sorted(parts):
            assert offset == at and zlib.crc32(whole[s][at * 4:(at + n) * 4]) == crc
            at += n
        assert len(whole[s]) == 4 * at <= 4 * 4096


def test_packing_of_no_documents(spark, no_docs):
    assert bestfit.pack_best_fit(bestfit.tokenized(no_docs)).collect() == []


def test_a_length_of_many_documents(spark):
    rng = random.Random(2)
    rows = [(i, "a b c" if i % 3 else " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 3000)))) for i in range(300)]
    got = bestfit.pack_best_fit(bestfit.tokenized(spark.createDataFrame(rows, "doc_id long, text string")), cell_rows=10).collect()
    used = Counter()
    for r in got:
        used[r.sequence_id] += r.length
    assert sorted(4096 - n for n in used.values()) == plain([r.length for r in got], 4096)

"""Operator 8: interpolated modified Kneser-Ney language model (bigrams over words).

1. Tasks count the bigrams of their texts as sorted arrays of 64-bit word hashes and
   deal them by context to parts; a frequent context goes over ``SLOTS`` parts by its next
   word. A part merges its arrays and writes the sorted hash array of its bigrams with
   their counts into the model folder.
2. The facts per word (count, numbers of followers seen once, twice, more often, and
   different predecessors) are dealt by ranges of the word hash, summed and written
   as sorted hash arrays in the same way. Only counts of counts reach the driver: they
   fix the discounts.
3. Workers map the arrays into memory, look the sorted distinct bigrams of a run of
   texts up in them, and add up log10 probabilities.

The model folder must be a path that all machines mount: by default it lies below
``spark.checkpoint.dir`` if that is a ``file:`` path; otherwise it is a parameter.
Files get their name only when complete, so a repeated task does no harm. Which parts have
files is known from the counts, and a missing one is an error.

p(w|v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w), with p(w) from the numbers of
different predecessors, discounted in the same way and interpolated with 1 / (V + 1);
the one beyond V is the share of all unknown words. After an unknown word, p(w).

Defined results
    null, empty and blank texts have one token, the end. Texts of any length are scored
    whole. A null id counts as not held out. With nothing to learn from, every token has
    probability 1. Repeated rows are learned from and returned as often as they occur. An
    empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import scratch_path, small_batches, text_bytes
from offerlake.llm.hashing import U64, Words, mix, words_of

#: Hashes of the sentence's begin (a context only) and end (a token).
BEGIN, END = U64(0x243F6A8885A308D3), U64(0x13198A2E03707344)
#: Tokens a task holds before it hands on their counts.
HELD_TOKENS = 2_000_000
#: Bytes of text to a part, about 4 million words: what a task merges stays bounded at every size.
PART_BYTES = 24_000_000
#: Parts that the followers of one context go to.
SLOTS = 8

_ODD = U64(0x9E3779B97F4A7C15)


def pairs_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, context and token of every token, the end of each row included."""
    rows = words.high - words.low
    count = words.counts()
    ends = np.cumsum(count) + np.arange(rows)
    token = np.full(len(words.hash) + rows, END, U64)
    token[np.arange(len(words.hash)) + words.row] = words.hash
    row = np.repeat(np.arange(rows), count + 1)
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - count] = BEGIN
    return row, context, token


def bigram_key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _ODD + token)


def bigram_part(context: np.ndarray, token: np.ndarray, parts: int) -> np.ndarray:
    slot = mix(token + U64(7)) & U64(SLOTS - 1)
    return ((mix(context + slot * _ODD) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def word_part(word: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash: the parts one after the other are sorted."""
    return ((word >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, each in the fewest bytes that hold its largest value."""
    out = [np.array([len(arrays)], np.uint32).tobytes()]
    for a in arrays:
        a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
        out += [np.array([len(a), a.itemsize], np.uint32).tobytes(), a.tobytes()]
    return b"".join(out)


def unpacked(blob: bytes) -> list[np.ndarray]:
    out, at = [], 4
    for _ in range(int(np.frombuffer(blob, np.uint32, 1)[0])):
        size, width = (int(x) for x in np.frombuffer(blob, np.uint32, 2, at))
        out.append(np.frombuffer(blob, f"u{width}", size, at + 8))
        at += 8 + size * width
    return out


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return np.flatnonzero(new)


def _merged(context: np.ndarray, token: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((token, context))
    context, token, count = context[order], token[order], count[order]
    at = _starts(context, token)
    return context[at], token[at], np.add.reduceat(count, at) if len(at) else count


def _count(parts: int):
    """For mapInArrow over (text): packed bigram counts (contexts, their run lengths, tokens, counts) per part."""

    def hand_on(held: list) -> Iterator[pa.RecordBatch]:
        context, token = (np.concatenate(x) for x in zip(*held, strict=True))
        context, token, count = _merged(context, token, np.ones(len(token), np.int64))
        part = bigram_part(context, token, parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        for low in range(0, parts, 16):
            numbers, blobs = [], []
            for p in range(low, min(low + 16, parts)):
                own = order[bounds[p]:bounds[p + 1]]
                if len(own):
                    v = context[own]
                    at = _starts(v)
                    numbers.append(p)
                    blobs.append(packed(v[at], np.diff(np.append(at, len(v))), token[own], count[own]))
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for words in words_of(batch.column(0)):
                _, context, token = pairs_of(words)
                held.append((context, token))
                size += len(token)
                if size >= HELD_TOKENS:
                    yield from hand_on(held)
                    held, size = [], 0
        if held:
            yield from hand_on(held)

    return count


def _save(folder: str, name: str, array: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    temporary = f"{folder}/.{name}.{os.getpid()}.{id(array)}"
    with open(temporary, "wb") as f:
        np.save(f, array)
    os.replace(temporary, f"{folder}/{name}.npy")


def _merge_bigrams(folder: str, parts: int):
    """For applyInPandas by part: writes the part's bigrams; returns facts per word and counts of counts."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        pieces = [unpacked(b) for b in rows["blob"]]
        context = np.concatenate([np.repeat(p[0].astype(U64), p[1]) for p in pieces])
        token, count = (np.concatenate([p[k] for p in pieces]).astype(t) for k, t in ((2, U64), (3, np.int64)))
        del pieces
        context, token, count = _merged(context, token, count)
        key = bigram_key(context, token)
        order = np.argsort(key)
        _save(folder, f"bigrams-{part}", key[order])
        small = np.minimum(count[order], 255)
        _save(folder, f"counts-{part}", small.astype(np.uint8))
        _save(folder, f"large-{part}", np.stack([at := np.flatnonzero(small == 255), count[order][at]]))
        at = _starts(context)
        seen = [np.add.reduceat((count == k) if k < 3 else (count >= k), at, dtype=np.int64) for k in (1, 2, 3)]
        own = np.argsort(token, kind="stable")
        ends = _starts(token[own])
        before = np.diff(np.append(ends, len(own)))
        total = np.add.reduceat(count[own], ends)
        # words as contexts and as tokens in one sorted list: count, followers seen 1, 2, 3+ times, predecessors
        word = np.concatenate([context[at], token[own][ends]])
        zero = np.zeros(len(at), np.int64), np.zeros(len(ends), np.int64)
        begun = np.where(context[at] == BEGIN, np.add.reduceat(count, at), 0)
        facts = [np.concatenate(x) for x in ((begun, total), *((s, zero[1]) for s in seen), (zero[0], before))]
        word, facts = _summed(word, facts)
        to = word_part(word, parts)
        bounds = np.searchsorted(to, np.arange(parts + 1))
        out = [(p, packed(word[a:b], *(f[a:b] for f in facts))) for p in range(parts)
               if (a := bounds[p]) < (b := bounds[p + 1])]
        found = np.array([*((count == k).sum() for k in (1, 2, 3, 4)), part])
        out.append((part, packed(found)))
        return pd.DataFrame(out, columns=["part", "blob"]).astype({"part": "int32"})

    return merge


def _summed(word: np.ndarray, facts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(word, kind="stable")
    word = word[order]
    at = _starts(word)
    return word[at], [np.add.reduceat(f[order].astype(np.int64), at) for f in facts] if len(at) else facts


def _merge_words(folder: str):
    """For applyInPandas by part: writes the part's words; returns the sums that the driver adds up."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        pieces = [unpacked(b) for b in rows["blob"]]
        counted = [p[0].astype(np.int64) for p in pieces if len(p) == 1]
        found = sum((c[:4] for c in counted), np.zeros(4, np.int64))
        pieces = [p for p in pieces if len(p) > 1]
        sums = np.zeros(7, np.int64)
        if pieces:
            word, facts = _summed(np.concatenate([p[0] for p in pieces]).astype(U64),
                                  [np.concatenate([p[k] for p in pieces]) for k in range(1, 6)])
            _save(folder, f"words-{part}", word)
            _save(folder, f"total-{part}", facts[0].astype(U64))
            _save(folder, f"facts-{part}", np.stack(facts[1:], axis=1).astype(np.uint32))
            real = word != BEGIN
            before = facts[4][real]
            sums = np.array([real.sum(), facts[0][real].sum(), before.sum(), *((before == k).sum() for k in (1, 2, 3, 4))])
        return pd.DataFrame([[*found.tolist(), *sums.tolist(), [int(c[4]) for c in counted], [part] if pieces else []]], columns=SUMS + PARTS)

    return merge


SUMS = ["b1", "b2", "b3", "b4", "types", "tokens", "before", "w1", "w2", "w3", "w4"]
PARTS = ["bigram_parts", "word_parts"]


def discounts(n: list[int]) -> np.ndarray:
    """D(1), D(2), D(3+) after D(0) = 0, from the numbers of items seen 1 to 4 times."""
    out = [0.0]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.0
    for k in (1, 2, 3):
        out.append(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) if n[k - 1] else k / 2)
    return np.array(out)


def model_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, as Hadoop resolves that path; it has to be a ``file:`` one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "lm"))
    whole = urlparse(path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString())
    if whole.scheme != "file":
        raise ValueError(f"spark.checkpoint.dir is on {whole.scheme}:, no mounted path: give model_dir, a folder that all machines mount")
    return unquote(whole.path)


class Model:
    """A model folder mapped into memory; one per Python worker. ``sums`` also lists the parts
    that have bigrams and words: a file of theirs that is not there raises an error."""

    def __init__(self, folder: str, parts: int, sums: dict):
        def mapped(kind: str, filled: list[int]) -> list[np.ndarray | None]:
            out: list[np.ndarray | None] = [None] * parts
            for p in filled:
                out[p] = np.load(f"{folder}/{kind}-{p}.npy", mmap_mode="r")
            return out

        self.parts, self.sums = parts, sums
        self.bigrams, self.counts, self.large = (mapped(k, sums["bigram_parts"]) for k in ("bigrams", "counts", "large"))
        self.words, self.total, self.facts = (mapped(k, sums["word_parts"]) for k in ("words", "total", "facts"))
        self.d2 = discounts([sums[f"b{k}"] for k in (1, 2, 3, 4)])
        self.d1 = discounts([sums[f"w{k}"] for k in (1, 2, 3, 4)])

    def word_facts(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and facts of sorted words; zeros where unknown."""
        total, facts = np.zeros(len(word), np.int64), np.zeros((len(word), 4), np.int64)
        bounds = np.searchsorted(word_part(word, self.parts), np.arange(self.parts + 1))
        for p, known in enumerate(self.words):
            a, b = bounds[p], bounds[p + 1]
            if a < b and known is not None:
                at = np.minimum(np.searchsorted(known, word[a:b]), len(known) - 1)
                hit = np.flatnonzero(known[at] == word[a:b])
                total[a + hit], facts[a + hit] = self.total[p][at[hit]], self.facts[p][at[hit]]
        return total, facts

    def bigram_counts(self, context: np.ndarray, token: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Counts of bigrams given in the order of their keys."""
        out = np.zeros(len(key), np.int64)
        part = bigram_part(context, token, self.parts)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p, known in enumerate(self.bigrams):
            own = order[bounds[p]:bounds[p + 1]]
            if len(own) and known is not None:
                at = np.minimum(np.searchsorted(known, key[own]), len(known) - 1)
                hit = np.flatnonzero(known[at] == key[own])
                count = self.counts[p][at[hit]].astype(np.int64)
                many = np.flatnonzero(count == 255)
                places, values = self.large[p]
                count[many] = values[np.searchsorted(places, at[hit][many])] if len(many) else 0
                out[own[hit]] = count
        return out

    def predecessor_probability(self, before: np.ndarray) -> np.ndarray:
        s = self.sums
        if not s["before"]:
            return np.full(len(before), 1 / (s["types"] + 1))
        w3 = s["types"] - s["w1"] - s["w2"]
        kept = self.d1[1] * s["w1"] + self.d1[2] * s["w2"] + self.d1[3] * w3
        return (np.maximum(before - self.d1[np.minimum(before, 3)], 0) + kept / (s["types"] + 1)) / s["before"]

    def score(self, words: Words) -> tuple[np.ndarray, ...]:
        """Per row: tokens, known tokens, base log10, model log10."""
        row, context, token = pairs_of(words)
        rows = words.high - words.low
        vocabulary, of_token = np.unique(np.append(token, BEGIN), return_inverse=True)
        of_context = np.empty(len(token), np.int64)
        of_context[1:] = of_token[:-2]
        of_context[context == BEGIN] = of_token[-1]
        of_token = of_token[:-1]
        total, facts = self.word_facts(vocabulary)
        unigram = self.predecessor_probability(facts[:, 3])
        key = bigram_key(context, token)
        order = np.argsort(key)
        at = _starts(key[order])
        first = order[at]
        count = self.bigram_counts(context[first], token[first], key[first])
        v, w = of_context[first], of_token[first]
        held = np.maximum(total[v], 1)
        rest = facts[v, :3] @ self.d2[1:] / held
        p = np.where(total[v] > 0, np.maximum(count - self.d2[np.minimum(count, 3)], 0) / held + rest * unigram[w], unigram[w])
        log = np.empty(len(token))
        log[order] = np.repeat(np.log10(p), np.diff(np.append(at, len(token))))
        seen = total.copy()
        seen[vocabulary == BEGIN] = 0
        base = np.log10((seen[of_token] + 1) / (self.sums["tokens"] + self.sums["types"] + 1))
        known = np.bincount(row, seen[of_token] > 0, rows)
        return np.bincount(row, minlength=rows), known.astype(np.int64), np.bincount(row, base, rows), np.bincount(row, log, rows)


def fit(docs: DataFrame, text_col: str = "text", model_dir: str | None = None) -> tuple[str, int, dict]:
    """Count the texts of ``docs`` into a model folder: (folder, parts, sums)."""
    spark = small_batches(docs.sparkSession)
    size = docs.agg(F.sum(text_bytes(F.col(text_col)))).first()[0] or 0
    folder, parts = model_dir or model_folder(spark), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    counted = docs.select(text_col).mapInArrow(_count(parts), "part int, blob binary")
    facts = counted.groupBy("part").applyInPandas(_merge_bigrams(folder, parts), "part int, blob binary")
    kinds = ", ".join([f"{c} long" for c in SUMS] + [f"{c} array<long>" for c in PARTS])
    sums = facts.groupBy("part").applyInPandas(_merge_words(folder), kinds)
    # numbers of parts, as many as there are files for each kind
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS],
                     *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in PARTS]).first().asDict()
    return folder, parts, total


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
                model_dir: str | None = None) -> DataFrame:
    """Learn from the rows where ``train`` holds and score all: ``id_col``, held_out, n_tokens,
    n_known, train_tokens, base_score, score (log10), perplexity."""
    train = F.coalesce(train, F.lit(True))
    folder, parts, sums = fit(docs.where(train), text_col, model_dir)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, parts, sums)
        for batch in batches:
            for words in words_of(batch.column(2), piece=1 << 21):
                take = slice(words.low, words.high)
                columns = [pa.array(c) for c in model.score(words)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[take], batch.column(1)[take], *columns],
                                                 names=[id_col, "held_out", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col), (~train).alias("held_out"), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(sums["tokens"]).cast("long").alias("train_tokens"),
                         "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))

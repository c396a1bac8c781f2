"""Operator 9: language identification, words first, then shorter and shorter n-grams.

A word that some language knows is scored by its log10 frequency in each language
(a penalty where a language lacks it). Any other word is scored by the mean of its
character n-grams of the largest length of which any is known, from ``LONGEST`` down to 1. A
text's score per language is the mean over its words; the highest wins.

The model is fitted on a bounded sample of labelled rows: per language the ``sample``
rows with the smallest hash of their id. Its counts are made in Spark. The sample bounds
the tables that are broadcast: they hold every different word and n-gram of these whole texts, those
seen once too.

Defined results
    ``und`` with score 0 for a null text, one without a letter, or without anything
    learned; also for a text none of whose words and n-grams is known. The score is the
    winner's share when the means, times at most ``WEIGHT`` words, are taken as log10
    likelihoods. Ties go to the language first in order. Whole texts are read. Repeated rows
    give repeated result rows, an empty table none. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.llm.common import small_batches, written

#: Labelled rows per language that the model is fitted on, at most.
SAMPLE = 500
#: Range of the hash by which the sample is drawn.
DRAW = 1 << 40
#: Longest character n-gram of the backoff.
LONGEST = 5
#: log10 frequency that stands for a word or n-gram that a language lacks.
PENALTY = -7.0
#: Words that a text counts for in its score, at most.
WEIGHT = 10
#: Words scored by n-grams that a worker remembers; emptied when full.
MEMO_SIZE = 200_000

LETTERS = r"\p{L}+"


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample: int = SAMPLE) -> tuple[list[str], int, pa.ChunkedArray, np.ndarray]:
    """Languages, the number of words, words and then n-grams, and their log10 frequencies (a row each)."""
    labelled = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    # a hash threshold per language leaves about twice the sample; the window only sees those
    ids = labelled.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"),
                          F.pmod(F.xxhash64(id_col), F.lit(DRAW)).alias("_draw"))
    below = ids.groupBy("_lang").agg((F.lit(2.0 * sample * DRAW) / F.count(F.lit(1))).alias("_below")).withColumnRenamed("_lang", "_l")
    near = ids.join(F.broadcast(below), F.col("_lang") == F.col("_l")).where(F.col("_draw") < F.col("_below"))  # a row per language
    drawn = Window.partitionBy("_lang").orderBy("_draw", "_id")
    chosen = near.withColumn("_n", F.row_number().over(drawn)).where(F.col("_n") <= sample).select("_lang", "_id").distinct()
    texts = labelled.select(F.col(lang_col).alias("lang"), F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), (F.col("_i") == F.col("_id")) & (F.col("lang") == F.col("_lang")))  # sample rows per language
    words = texts.select("lang", F.explode(F.regexp_extract_all(F.lower("_text"), F.lit(f"({LETTERS})"))).alias("s")).groupBy(
        "lang", "s").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("s"), F.lit(" "))
    grams = words.select("lang", "n", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")).where(
        F.length("p") >= F.col("size")).select("lang", "n", "size", F.explode(F.transform(
            F.sequence(F.lit(1), F.length("p") - F.col("size") + 1), lambda i: F.substring("p", i, F.col("size")))).alias("s"))
    counts = words.select("lang", F.lit(0).alias("size"), "s", "n").unionByName(
        grams.groupBy("lang", "size", "s").agg(F.sum("n").alias("n")))
    sums = written(counts.groupBy("lang", "size").agg(F.sum("n").alias("_all")).select(
        F.col("lang").alias("_l"), F.col("size").alias("_k"), "_all"), "langid")
    langs = [r[0] for r in sums.select("_l").distinct().orderBy("_l").collect()]
    if not langs:
        return [], 0, pa.chunked_array([], pa.string()), np.empty((0, 0), np.float32)
    share = F.log10(F.col("n") / F.col("_all")).cast("float")
    scored = counts.join(sums, (F.col("lang") == F.col("_l")) & (F.col("size") == F.col("_k")))
    rows = scored.groupBy("size", "s").agg(*[
        F.max(F.when(F.col("lang") == x, share)).alias(f"f{i}") for i, x in enumerate(langs)]).toArrow()
    rows = rows.sort_by("size")  # words first
    table = np.empty((rows.num_rows, len(langs)), np.float32)
    for i in range(len(langs)):
        table[:, i] = rows.column(2 + i).fill_null(PENALTY).to_numpy()
    return langs, int(np.sum(rows.column(0).to_numpy() == 0)), rows.column(1), table


class Scorer:
    """Scores texts with a fitted model; one per Python worker."""

    def __init__(self, langs: list[str], words: int, strings: pa.ChunkedArray, table: np.ndarray):
        import regex

        self.langs, self.letters = langs, regex.compile(LETTERS).findall
        self.plain = re.compile(r"[a-z]+").findall
        self.known = {s: i for i, s in enumerate(strings[:words].to_pylist())}
        self.fixed = words
        self.grams, self.table = {s: words + i for i, s in enumerate(strings[words:].to_pylist())}, table
        self.rows = np.zeros((words + MEMO_SIZE, len(langs)))
        self.rows[:words] = table[:words]
        self.valid = np.ones(len(self.rows), bool)

    def back_off(self, word: str) -> int:
        """Row of a word that no language knows."""
        at = len(self.known)
        if at == len(self.rows):
            self.known = {w: i for w, i in self.known.items() if i < self.fixed}
            at = self.fixed
        padded, get = f" {word} ", self.grams.get
        self.valid[at] = False
        for size in range(LONGEST, 0, -1):
            found = [g for i in range(len(padded) - size + 1) if (g := get(padded[i:i + size])) is not None]
            if found:
                self.rows[at], self.valid[at] = np.add.reduce(self.table.take(found, 0), 0, np.float64) / len(found), True
                break
        self.known[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        text = text.lower()
        counts = Counter(self.plain(text) if text.isascii() else self.letters(text))
        if len(self.known) + len(counts) > len(self.rows):
            self.known = {w: i for w, i in self.known.items() if i < self.fixed}
        total, weight, known = np.zeros(len(self.langs)), 0, self.known
        parts = list(counts.items())
        for low in range(0, len(parts), MEMO_SIZE):  # a text may have more new words than are remembered
            at, n = [], []
            for word, c in parts[low:low + MEMO_SIZE]:
                i = known.get(word)
                if i is None:
                    i = self.back_off(word)
                    known = self.known
                at.append(i)
                n.append(c)
            n = np.where(self.valid[at], n, 0)
            total += n @ self.rows[at]
            weight += int(n.sum())
        if not weight:
            return "und", 0.0
        mean = total / weight
        best = int(mean.argmax())
        share = 1 / np.power(10.0, (mean - mean[best]) * min(weight, WEIGHT)).sum()
        return self.langs[best], float(share)


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample: int = SAMPLE) -> DataFrame:
    """``id_col``, held_out, lang_pred, score of every row; learned from the rows where ``train`` holds."""
    train = F.coalesce(train, F.lit(True))
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, train, id_col, text_col, lang_col, sample))  # bounded by the sample

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[id_col, "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col), (~train).alias("held_out"), F.col(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(predict, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, train: Column, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is found with at least ``min_score``."""
    spark = small_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast(fit(docs, F.coalesce(train, F.lit(True)), id_col, text_col, lang_col, sample))
    place = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(place)]
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)

"""Operator 4: benchmark decontamination by CGK embedding and bit-sampling LSH.

A text holds an item if some run of its words is within ``(1 - similarity) * words of
the item`` word edits of it (insertions, deletions, substitutions).

1. Items of more than ``SEGMENT`` words are cut into segments of nearly the same length, as
   walks drift apart with the number of edits; a shorter item is one segment. Some segment has
   at most its share of the edits, so it is enough to look for segments.
2. Windows as long as a segment start at every word. A window that lacks too many of the
   words of the segments of its length, repeats beyond those in any segment not counted, cannot
   be within the edits of any of them (a count filter: it loses nothing) and goes no further.
3. The CGK embedding reads a sequence by a random walk: it writes the current word and
   steps on or not by a random bit of (word, step). After edits the walks over window
   and item fall back into step, so few places of the embedding differ. Past the end it
   writes a blank.
4. Each walk is sampled at ``PLACES`` places for each of ``TABLES`` tables; a window whose words
   agree with a segment's at all places of a table is a candidate. ``WALKS`` has the number of
   walks for a segment's length, by which ``TARGET_RECALL`` is reached at the most edits allowed.
5. Candidates are verified by the exact edit distance of the whole item to the best run of
   words around the place that the window gives it.

Items are taken in blocks of about ``BLOCK_ITEMS`` items and at most ``BLOCK_WORDS`` words and
one item more. One block at a time is on the driver and broadcast: of several, the result of
each is written before the next is read. Each block reads the texts once. Verbatim items are always candidates; README has the
measured recall for edited ones of up to 1,500 words.

Defined results
    One row per text row and item found, with the fewest edits (then the earliest place);
    clean texts have no row. Items of fewer than ``min_words`` words are not
    looked for; by default those of fewer than ``MIN_WORDS``, which are too short to tell from
    chance (README has figures). Below ``MIN_WORDS`` words no edit is allowed: they match verbatim. Null and empty texts and items match nothing. Texts of
    any length are read whole. Repeated rows give repeated result rows; repeated items give
    a row each. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.llm.common import remove, scratch_path, small_batches, unused, word_count, written
from offerlake.llm.hashing import U64, Words, mix, words_of

SIMILARITY_PERCENT = 80
#: Share of the items with the most edits allowed that the tables are to find, whatever the length and the kind of edits.
TARGET_RECALL = 0.99
#: Walks for segments of up to so many words.
WALKS = {4: 1, 40: 12, 48: 16}  # of up to 4 words no edits are allowed, and one walk finds what is equal
SEGMENT, TABLES, PLACES = max(WALKS), 8, 3
MIN_WORDS = 5
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
#: Words back that the count filter looks for repeats.
NEAR = 8
#: Windows embedded at once.
CHUNK = 1 << 16

_ODD = U64(0x9E3779B97F4A7C15)
BLANK = U64(0x452821E638D01377)


def allowed_edits(size, percent: int = SIMILARITY_PERCENT):
    return size * (100 - percent) // 100


def walks_of(size: int) -> int:
    return next(walks for longest, walks in WALKS.items() if size <= longest)


def sampled_places(size: int) -> np.ndarray:
    """Steps (walks x tables x places) at which embeddings of ``size`` words are read; a
    walk moves on at every other step, so it is about at the end after 2 * size steps."""
    draw = np.random.default_rng(size).random((walks_of(size), TABLES, PLACES))
    return np.sort((draw * 2 * size).astype(np.int64), axis=2)


def table_keys(tokens: np.ndarray, start: np.ndarray, size: np.ndarray, stop: np.ndarray, walk: int,
               places: dict[int, np.ndarray]) -> np.ndarray:
    """Keys (sequences x tables) of the sequences [start, min(start + size, stop)) under one walk.
    Sequences of different sizes have different keys."""
    end = np.minimum(start + size, stop)
    steps = 2 * int(size.max())
    path = np.empty((steps, len(start)), np.int64)
    at, bits = start.copy(), None
    for j in range(steps):
        if j % 64 == 0:  # 64 random bits of every word serve 64 steps
            bits = np.append(mix(tokens + _ODD * np.full(1, (walk << 20) + j // 64 + 1, U64)), U64(0))
        path[j] = at
        at = at + (((bits[at] >> U64(j % 64)) & U64(1)).astype(np.int64) & (at < end))
    padded = np.append(tokens, BLANK)
    kinds, kind = np.unique(size, return_inverse=True)
    read = np.stack([places[k][walk] for k in kinds.tolist()])[kind]
    where = path[read, np.arange(len(size))[:, None, None]]
    word = padded[np.where(where < end[:, None, None], where, len(tokens))]
    weights = mix(np.arange(1, PLACES + 1, dtype=U64)) | U64(1)
    salt = mix(np.arange(TABLES, dtype=U64) + _ODD * np.full(1, walk + 1, U64))
    return mix((mix(word) * weights).sum(axis=2, dtype=U64) + salt + mix(size.astype(U64))[:, None])


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits from ``item`` to a run of ``text``, and the run (start, end), the earliest."""
    n = len(text)
    cost, begun = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1)
    for i, word in enumerate(item):
        swap = cost[:-1] + (text != word)
        drop = cost[1:] + 1
        step = np.append(i + 1, np.minimum(swap, drop))
        origin = np.append(0, np.where(swap <= drop, begun[:-1], begun[1:]))
        # insertions: the lowest of (cost so far - place) from the left, as a running minimum
        low = np.minimum.accumulate(step - ramp)
        source = np.maximum.accumulate(np.where(step - ramp == low, ramp, 0))
        new = np.append(True, low[1:] < low[:-1])
        source = np.maximum.accumulate(np.where(new, ramp, 0))
        cost, begun = low + ramp, origin[source]
    end = int(cost.argmin())
    return int(cost[end]), int(begun[end]), end


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, ids: list, texts: list[str | None], percent: int, min_words: int = MIN_WORDS):
        self.percent = percent
        self.items: list[tuple[object, np.ndarray]] = []
        words = list(words_of(pa.array(texts, pa.string()))) if texts else []
        for w in words:
            bounds = np.append(0, np.cumsum(w.counts()))
            self.items += [(ids[w.low + r], w.hash[bounds[r]:bounds[r + 1]]) for r in range(w.high - w.low)
                           if bounds[r + 1] - bounds[r] >= max(min_words, 1)]
        self.seeds: list[tuple[int, int]] = []  # item and first word of each segment
        segments = []
        for k, (_, text) in enumerate(self.items):
            pieces = -(-len(text) // SEGMENT)
            cuts = [len(text) * p // pieces for p in range(pieces + 1)]
            self.seeds += [(k, low) for low in cuts[:-1]]
            segments += [text[low:high] for low, high in zip(cuts, cuts[1:], strict=False)]
        self.sizes = sorted({len(t) for t in segments})
        self.places = {s: sampled_places(s) for s in self.sizes}
        # which sizes a word belongs to: up to 64 classes of neighbouring sizes, a bit each
        self.classes = [list(c) for c in np.array_split(self.sizes, min(len(self.sizes), 64))] if self.sizes else []
        of = {int(size): k for k, c in enumerate(self.classes) for size in c}
        flat = np.concatenate(segments) if segments else np.zeros(0, U64)
        bits = np.concatenate([np.full(len(t), 1 << of[len(t)], U64) for t in segments]) if segments else flat
        order = np.argsort(flat, kind="stable")
        self.vocabulary, at = np.unique(flat[order], return_index=True)
        self.bits = np.bitwise_or.reduceat(bits[order], at) if len(at) else bits
        # how often a segment has the word at most
        self.most = np.ones(len(self.vocabulary), np.int64)
        for text in segments:
            own, often = np.unique(text, return_counts=True)
            at = np.searchsorted(self.vocabulary, own)
            self.most[at] = np.maximum(self.most[at], often)
        # a first cheap test of words: 16 bits of the hash
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.vocabulary >> U64(48)).astype(np.int64)] = True
        size = np.array([len(t) for t in segments], np.int64)
        start = np.append(0, np.cumsum(size))[:-1].astype(np.int64)
        self.walks = np.array([walks_of(k) if k in self.places else 0 for k in range(SEGMENT + 1)])
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        for walk in range(int(self.walks.max())):
            own = np.flatnonzero(self.walks[size] > walk)
            keys = table_keys(flat, start[own], size[own], (start + size)[own], walk, self.places)
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys.append((keys.reshape(-1)[order], np.repeat(own, TABLES)[order]))

    def classes_of(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits of the size classes whose segments have the word; the same only where the word has
        come up more often within the last ``NEAR`` words than in any segment."""
        out, again = np.zeros(len(tokens), U64), np.zeros(len(tokens), U64)
        at = np.flatnonzero(self.seen[(tokens >> U64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.vocabulary, tokens[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[place] == tokens[at]
        at, place = at[hit], place[hit]
        out[at] = self.bits[place]
        order = np.argsort(place, kind="stable")
        here, word = at[order], place[order]
        before = np.arange(len(here)) - self.most[word]
        back = np.maximum(before, 0)
        flood = (before >= 0) & (word[back] == word) & (here - here[back] <= NEAR)
        again[here[flood]] = out[here[flood]]
        return out, again

    def windows(self, tokens: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the windows that pass the count filter."""
        bits, again = self.classes_of(tokens)
        n = len(tokens)
        total, floods = np.zeros(n + 1 + max(self.sizes), np.int32), np.zeros(n + 1, np.int32)
        starts, sizes = [], []
        for k, sizes_here in enumerate(self.classes):
            np.cumsum((bits >> U64(k)).astype(np.uint8) & 1, dtype=np.int32, out=total[1:n + 1])
            total[n + 1:] = total[n]
            counted = False
            for size in map(int, sizes_here):
                least = size - allowed_edits(size, self.percent)
                # the whole window may reach into the next text: checked again up to the text's end
                good = np.flatnonzero(total[size:size + n] - total[:n] >= least)
                end = np.minimum(good + size, stop[good])
                held = total[end] - total[good]
                if (held >= least).any() and size > NEAR:
                    if not counted:
                        np.cumsum((again >> U64(k)).astype(np.uint8) & 1, dtype=np.int32, out=floods[1:])
                        counted = True
                    # from NEAR words after the start on, a repeat too many matches nothing
                    held -= np.maximum(floods[end] - floods[np.minimum(good + NEAR, end)], 0)
                good = good[held >= least]
                starts.append(good)
                sizes.append(np.full(len(good), size))
        return np.concatenate(starts), np.concatenate(sizes)

    def candidates(self, tokens: np.ndarray, stop: np.ndarray) -> set[tuple[int, int]]:
        """(segment, start) of the windows that share a table key with a segment."""
        out: set[tuple[int, int]] = set()
        starts, sizes = self.windows(tokens, stop)
        order = np.argsort(starts, kind="stable")  # neighbours together: few words under a chunk of windows
        starts, sizes = starts[order], sizes[order]
        for low in range(0, len(starts), CHUNK):
            start, size = starts[low:low + CHUNK], sizes[low:low + CHUNK]
            # only the words under these windows are embedded
            under = np.zeros(len(tokens) + 1, np.int32)
            np.add.at(under, start, 1)
            np.add.at(under, np.minimum(start + size, stop[start]), -1)
            used = np.cumsum(under[:-1]) > 0
            place = np.append(0, np.cumsum(used))
            part, begin, limit = tokens[used], place[start], place[np.minimum(start + size, stop[start])]
            for walk, (known, owner) in enumerate(self.keys):
                own = self.walks[size] > walk
                if not own.all():
                    start, size, begin, limit = start[own], size[own], begin[own], limit[own]
                if not len(start):
                    break
                keys = table_keys(part, begin, size, limit, walk, self.places)
                at = np.searchsorted(known, keys)
                for row, table in np.argwhere(known[np.minimum(at, len(known) - 1)] == keys):
                    k, key = at[row, table], keys[row, table]
                    while k < len(known) and known[k] == key:
                        out.add((int(owner[k]), int(start[row])))
                        k += 1
        return out

    def find(self, words: Words) -> list[tuple[int, object, int, int, int, int]]:
        """(row, item id, start word, end word, edits, item words) of every text row and item found."""
        bounds = np.append(0, np.cumsum(words.counts()))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        if len(words.hash) == 0 or not self.items:
            return []
        # (row, item, place of the item's first word if there are no edits before the segment)
        found = sorted({(int(words.row[start]), self.seeds[k][0], start - self.seeds[k][1])
                        for k, start in self.candidates(words.hash, bounds[words.row + 1])})
        i = 0
        while i < len(found):
            row, item, start = found[i]
            text = self.items[item][1]
            edits = allowed_edits(len(text), self.percent)
            last = start  # windows that overlap are verified together
            while i + 1 < len(found) and found[i + 1][:2] == (row, item) and found[i + 1][2] <= last + edits + 1:
                i += 1
                last = found[i][2]
            i += 1
            # a window may begin beside its segment's run, as far as the edits of a segment go
            beside = allowed_edits(min(len(text), SEGMENT), self.percent)
            low = max(start - edits - beside, bounds[row])
            high = min(last + len(text) + edits + beside, bounds[row + 1])
            cost, a, b = best_run(text, words.hash[low:high])
            if cost <= edits:
                new = (cost, int(low + a - bounds[row]), int(low + b - bounds[row]))
                best[row, item] = min(best.get((row, item), new), new)
        return [(row, self.items[item][0], a, b, cost, len(self.items[item][1])) for (row, item), (cost, a, b) in sorted(best.items())]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", percent: int = SIMILARITY_PERCENT,
               min_words: int = MIN_WORDS) -> DataFrame:
    """``id_col``, ``item_id_col``, start_word, end_word, edits, item_words, similarity of every
    benchmark item that a text holds."""
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).where(F.col("_text").isNotNull())
    rows = _rows(items, item_id_col, item_text_col)

    def search(shared) -> DataFrame:
        return texts.mapInArrow(_finder(shared, percent, min_words, id_col, item_id_col),
                                f"`{id_col}` {kinds[0]}, `{item_id_col}` {kinds[1]}, start_word long, end_word long, edits long, item_words long")

    out = search(_shared(rows)) if _is_one_block(rows) else _block_after_block(rows, search)
    return out.withColumn("similarity", F.lit(1.0) - F.col("edits") / F.col("item_words"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", percent: int = SIMILARITY_PERCENT,
                      min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    rows = _rows(items, item_id_col, item_text_col)
    if _is_one_block(rows):
        return docs.mapInArrow(_cleaner(_shared(rows), percent, min_words, docs.columns.index(text_col)), docs.schema)
    # whether a text holds an item is a matter of the text alone, so its digest names it
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    key = unused("_held", docs, items)
    texts = docs.select(digest.alias(key), F.col(text_col).alias("_text"))
    held = find_items(texts, items, key, "_text", item_id_col, item_text_col, percent, min_words).select(key).distinct()
    return docs.join(held, digest == F.col(key), "left_anti")


def _rows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())


def _is_one_block(rows: DataFrame) -> bool:
    count, words = rows.agg(F.count(F.lit(1)), F.sum(word_count(F.col("t")))).first()
    return count <= BLOCK_ITEMS and (words or 0) <= BLOCK_WORDS


def _shared(block: DataFrame):
    held = block.select("i", "t").collect()
    return small_batches(block.sparkSession).sparkContext.broadcast(([r["i"] for r in held], [r["t"] for r in held]))


def _block_after_block(rows: DataFrame, search: Callable[..., DataFrame]) -> DataFrame:
    """``search`` over blocks of the items, each written before the next is read. Items are dealt
    to buckets of about ``BLOCK_ITEMS`` by a hash of their place, copies too; a bucket is cut by words."""
    spark = rows.sparkSession
    buckets = -(-rows.count() // BLOCK_ITEMS)
    placed = rows.withColumn("place", F.monotonically_increasing_id())
    dealt = placed.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    before = Window.partitionBy("bucket").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    words = F.coalesce(F.sum(word_count(F.col("t"))).over(before), F.lit(0))
    numbered = written(dealt.withColumn("cut", F.floor(words / BLOCK_WORDS)), "benchmark")
    path = scratch_path(spark, "decontamination")
    for k, (bucket, cut) in enumerate(numbered.select("bucket", "cut").distinct().orderBy("bucket", "cut").collect()):
        shared = _shared(numbered.where((F.col("bucket") == bucket) & (F.col("cut") == cut)))
        found = search(shared)
        found.write.parquet(f"{path}/block={k}")
        shared.destroy()
    remove(spark, numbered)
    return spark.read.schema(found.schema).parquet(*[f"{path}/block={j}" for j in range(k + 1)])


def _cleaner(shared, percent: int, min_words: int, place: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, percent, min_words)
        for batch in batches:
            clean_rows = np.ones(batch.num_rows, bool)
            for words in words_of(batch.column(place)):
                for found in items.find(words):
                    clean_rows[words.low + found[0]] = False
            yield batch.filter(pa.array(clean_rows))
    return clean


def _finder(shared, percent: int, min_words: int, id_col: str, item_id_col: str):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value, percent, min_words)
        for batch in batches:
            for words in words_of(batch.column(1)):
                found = items.find(words)
                if found:
                    ids = batch.column(0).take(pa.array([words.low + f[0] for f in found]))
                    columns = [pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4, 5)]
                    yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found]), *columns],
                                                     names=[id_col, item_id_col, "start_word", "end_word", "edits", "item_words"])
    return find

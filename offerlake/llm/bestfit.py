"""Operator 12: best-fit decreasing packing of token sequences.

Tokens. Texts are cut into pre-tokens with array operations over their code points, and a
pre-token's ids come from the tokenizer library's merges, once per distinct pre-token that a
worker has not seen. What a character is (letter, number, white space, other, and its lower case)
is asked of the library once per character; texts with characters that may act on
their neighbours (marks, jamo, one with a longer lower case) or with a special string go to
the library whole. Pre-tokens are told apart by a 64-bit hash.

Packing. Best-fit decreasing only looks at lengths, and lengths are at most the capacity: the
driver takes the histogram (at most ``CAPACITY`` rows, whatever the input), goes through the
lengths from the longest, and finds the tightest open bin by a segment tree over remaining
capacities. Equal pieces go into equal bins in one move, so the moves are bounded by the
capacity too (about ten thousand), and they are broadcast. Each piece has a gapless
number among the pieces of its length, counted in hashed cells of about ``CELL_ROWS`` rows; the move
that covers the number gives its bin and its place.

Defined results
    A null or empty text has the end id only. Texts longer than the capacity are cut there,
    the end id counted; others are never cut. Repeated rows, and rows that share an
    id or have a null one, are documents of their own. Special strings inside texts count as
    the library's default has them. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.llm.common import written
from offerlake.llm.hashing import U64, mix, powers
from offerlake.llm.tokens import byte_alphabet

CAPACITY, END_ID = 4096, 1
#: Pieces numbered by one task at a time, about.
CELL_ROWS = 1_000
#: Characters cut at once, and distinct pre-tokens that a worker remembers; emptied when full.
PIECE, MEMO_SIZE = 1 << 20, 1_000_000

SPACE, LETTER, NUMBER, OTHER, WHOLE, UNKNOWN = range(6)
JAMO = ((0x1100, 0x1200), (0xA960, 0xA980), (0xD7B0, 0xD800))
#: Fixed value: what the pre-token pattern keeps with an apostrophe that stands alone.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Coder:
    """Token ids of texts; one per worker."""

    def __init__(self, path: str, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.stand_in = {b: c for c, b in byte_alphabet().items() if b != 10}  # the model's character of each byte
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.value = np.zeros(0x110000, U64)
        self.end_id = end_id
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.full(1, self.end_id, np.uint32), 1

    def learn(self, chars: np.ndarray) -> None:
        """Kind, lower case and hash value of characters, asked of the library."""
        normal, cut = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in chars.tolist():
            char = chr(c)
            if unicodedata.category(char) in ("Cn", "Cs", "Mn", "Mc", "Me") or char == "Σ" or any(a <= c < b for a, b in JAMO):
                self.kind[c] = WHOLE
                continue
            low = normal(f"x{char}x")[1:-1]
            if len(low) != 1 or normal(f"x{low}x")[1:-1] != low:
                self.kind[c] = WHOLE
                continue
            pieces = [len(cut(f"{side}{low}{low}{side}")) for side in "a1!"]
            # together with letters, each alone, together with others, or nowhere
            self.kind[c] = {(1, 3, 3): LETTER, (4, 4, 4): NUMBER, (3, 3, 1): OTHER, (2, 2, 2): SPACE}.get(
                (pieces[0], pieces[1], pieces[2]), WHOLE)
            self.lower[c], self.value[c] = ord(low), mix(np.array([ord(low) + 1], U64))[0]

    def merged(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Ids of lower-cased pre-tokens, by the merges of the library, one after the other, and how many each has."""
        merge, flat, bounds = self.tokenizer.model.tokenize, [], [0]
        for word in "\n".join(words).encode().decode("latin-1").translate(self.stand_in).split("\n"):
            flat += [t.id for t in merge(word)]
            bounds.append(len(flat))
        return flat, bounds

    def _append(self, flat: list[int], bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of runs of ids, put behind those remembered."""
        stop = self.used + len(flat)
        if stop > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(stop, 2 * len(self.flat)) - len(self.flat), np.uint32)])
        self.flat[self.used:stop] = flat
        at, self.used = self.used + np.array(bounds, np.int64), stop
        return at[:-1], np.diff(at)

    def _cuts(self, points: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the pre-tokens; the last character is white space."""
        change = np.empty(len(kind) + 1, bool)
        change[0] = change[-1] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
        single, some = kind == NUMBER, kind != SPACE
        first, last = (change[:-1] | single) & some, (change[1:] | single) & some
        alone = np.flatnonzero(first & last & (points == 39))
        alone = alone[kind[alone + 1] == LETTER]
        if len(alone):
            low = self.lower[points]
            length = np.zeros(len(alone), np.int64)
            for c in CONTRACTIONS:
                fits = np.ones(len(alone), bool)
                for k, char in enumerate(c, 1):
                    after = np.minimum(alone + k, len(kind) - 1)
                    fits &= (low[after] == ord(char)) & (kind[after] == LETTER)
                length[fits] = len(c)
            alone, length = alone[length > 0], length[length > 0]
            last[alone], first[alone + 1] = False, False
            rest = ~last[alone + length]
            last[alone + length] = True
            first[(alone + length + 1)[rest]] = True
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def _hashes(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points) + 1, U64)
        out = np.empty(len(start), U64)
        for low in range(0, max(len(points), 1), PIECE):  # powers are held for one piece; a longer run goes by its own
            a, b = np.searchsorted(start, [low, low + PIECE])
            if a == b:
                continue
            stop = int(end[b - 1])
            part = self.value[points[low:stop]] * powers(stop - low, False)
            np.cumsum(part, out=total[low + 1:stop + 1])
            total[low] = 0
            s, e = start[a:b], end[a:b]
            out[a:b] = (total[e] - total[s]) * powers(stop - low + 1, True)[s - low]
        return mix(out + (end - start).astype(U64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with its end id, and the bounds of the texts in them."""
        if len(self.keys) > MEMO_SIZE:
            self.forget()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        if len(new := np.unique(points[kind == UNKNOWN])):
            self.learn(new)
            kind = self.kind[points]
        begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(begin, np.flatnonzero(kind == WHOLE), "right") - 1] = True
        for s in self.special:
            if s in joined:
                whole |= [s in t for t in texts]
        for i in np.flatnonzero(whole):
            kind[begin[i]:begin[i + 1]] = SPACE
        start, end = self._cuts(points, kind)
        distinct, example, which = np.unique(self._hashes(points, start, end), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        fresh = np.ones(len(distinct), bool)
        inside = place < len(self.keys)
        fresh[inside] = self.keys[place[inside]] != distinct[inside]
        if fresh.any():
            low = self.lower[points].tobytes().decode("utf-32-le")
            words = zip(start[example[fresh]].tolist(), end[example[fresh]].tolist(), strict=True)
            at, size = self._append(*self.merged([low[a:b] for a, b in words]))
            where = place[fresh]
            self.keys = np.insert(self.keys, where, distinct[fresh])
            self.at, self.size = np.insert(self.at, where, at), np.insert(self.size, where, size)
            place = np.searchsorted(self.keys, distinct)
        at, size = self.at[place][which], self.size[place][which]
        ends = np.searchsorted(start, begin[1:])
        odd = np.flatnonzero(whole)
        used = self.used
        coded = [self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in odd]
        odd_at, odd_size = self._append([x for ids in coded for x in ids], np.concatenate([[0], np.cumsum([len(ids) for ids in coded])]))
        # behind the words of each text come its ids if it went whole, then its end id
        turn = np.argsort(np.concatenate([2 * odd, 2 * np.arange(len(texts)) + 1]), kind="stable")
        here = np.concatenate([ends[odd], ends])[turn]
        at = np.insert(at, here, np.concatenate([odd_at, np.zeros(len(texts), np.int64)])[turn])
        size = np.insert(size, here, np.concatenate([odd_size, np.ones(len(texts), np.int64)])[turn])
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(at - before[:-1], size) + np.arange(before[-1])]
        self.used = used  # ids of whole texts are not remembered
        last = ends + np.arange(1, len(texts) + 1) + np.cumsum(whole)
        return ids, np.concatenate([[0], before[last]])


@lru_cache(maxsize=1)
def coder(path: str, end_id: int) -> Coder:
    """The coder of a worker, with what it has learnt in earlier tasks."""
    return Coder(path, end_id)


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
              capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """pid, ``id_col``, piece, start, length, ids_crc32 and ids (little-endian unsigned 32-bit) of every piece, written once."""
    path = path or tokenizer_path()
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    names = [id_col, "piece", "start", "length", "ids_crc32", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(path, end_id).encode
        for batch in batches:
            texts, low, held = batch.column(1), 0, 0
            sizes = np.diff(_offsets(texts))
            for i, size in enumerate(sizes.tolist()):
                held += size
                if held >= PIECE or i + 1 == len(sizes):
                    ids, bounds = encode([t or "" for t in texts.slice(low, i + 1 - low).to_pylist()])
                    yield _pieces(batch.column(0).slice(low, i + 1 - low), ids, bounds, capacity, names)
                    low, held = i + 1, 0

    kind = rows.schema[id_col].dataType.simpleString()
    pieces = rows.mapInArrow(cut, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return written(pieces.withColumn("pid", F.monotonically_increasing_id()), "bestfit")


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[
        texts.offset:texts.offset + len(texts) + 1]


def _pieces(doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray, capacity: int, names: list[str]) -> pa.RecordBatch:
    counts = -(-np.diff(bounds) // capacity)
    doc = np.repeat(np.arange(len(counts)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = piece * capacity
    length = np.minimum(capacity, np.diff(bounds)[doc] - start)
    data, low = memoryview(ids.astype("<u4").tobytes()), (bounds[doc] + start) * 4
    blobs = [data[a:b] for a, b in zip(low.tolist(), (low + length * 4).tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
         pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array([bytes(b) for b in blobs], pa.binary())], names=names)


class CapacityTree:
    """Segment tree over remaining capacities 0 to ``capacity``: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, remaining: int, some: bool) -> None:
        at = self.leaves + remaining
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        """Smallest capacity of at least ``need`` that is there."""
        at = self.leaves + need
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit_decreasing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Moves (length, first number, pieces a bin, first bin, offset) of best-fit decreasing.

    The pieces of a length from ``first number`` on go in turn into ``first bin`` (as many as
    ``pieces a bin``, from ``offset`` on), the bin after it, and so on, until the next move of that length.
    """
    tree, open_bins, moves, bins = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, count: int) -> None:
        if count and remaining:
            open_bins.setdefault(remaining, []).append((first, count))
            tree.mark(remaining, True)

    for length in sorted(histogram, reverse=True):
        number, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[remaining].pop()
                if not open_bins[remaining]:
                    tree.mark(remaining, False)
            each = remaining // length  # the bin just used is the tightest until it is too small
            full = min(count, left // each)
            if full:
                moves.append((length, number, each, first, capacity - remaining))
                put(remaining - each * length, first, full)
                number, left = number + full * each, left - full * each
            if full < count and left:  # fewer than a bin takes
                moves.append((length, number, each, first + full, capacity - remaining))
                put(remaining - left * length, first + full, 1)
                number, left, full = number + left, 0, full + 1
            put(remaining, first + full, count - full)
    return moves


def pack_best_fit(pieces: DataFrame, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``pieces`` (pid, length, ...) without ids, with sequence_id and offset (its place in the sequence)."""
    spark = pieces.sparkSession
    histogram = written(pieces.groupBy(F.col("length").alias("_length")).agg(F.count(F.lit(1)).alias("_n")), "bestfit")
    moves = best_fit_decreasing({r["_length"]: r["_n"] for r in histogram.collect()}, capacity)  # at most ``capacity`` lengths
    order = sorted(moves)
    table = np.array(order, np.int64).reshape(len(order), 5)
    shared = spark.sparkContext.broadcast(((table[:, 0] << 44) + table[:, 1], table))
    slim = pieces.drop("ids").join(F.broadcast(histogram), F.col("length") == F.col("_length")).withColumn(
        "_cell", F.pmod(F.xxhash64("pid"), F.ceil(F.col("_n") / cell_rows))).drop("_length", "_n")
    sizes = written(slim.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")), "bestfit")
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("length").alias("_l"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = slim.withColumn("_in", F.row_number().over(Window.partitionBy("length", "_cell").orderBy("pid")) - 1)
    ranked = numbered.join(offsets, (F.col("length") == F.col("_l")) & (F.col("_cell") == F.col("_c"))).withColumn(
        "_number", (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in", "_cell", "_l", "_c")
    at, length_at = ranked.columns.index("_number"), ranked.columns.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, moved = shared.value
        for batch in batches:
            number, length = batch.column(at).to_numpy(), batch.column(length_at).to_numpy()
            move = moved[np.searchsorted(keys, (length << 44) + number, "right") - 1]
            bin_, inside = np.divmod(number - move[:, 1], move[:, 2])
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != at] + [pa.array(move[:, 3] + bin_), pa.array(move[:, 4] + inside * length)],
                names=[n for n in batch.schema.names if n != "_number"] + ["sequence_id", "offset"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_number")
    return ranked.mapInArrow(place, f"{out}, sequence_id long, offset long")


def sequences(pieces: DataFrame, packed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens and ids (little-endian unsigned 32-bit) of every packed sequence; a group is one sequence."""
    whole = packed.select("pid", "sequence_id", "offset").join(pieces.select(F.col("pid").alias("_pid"), "ids"), F.col("pid") == F.col("_pid"))
    parts = whole.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return parts.select("sequence_id", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), ids.alias("ids"))

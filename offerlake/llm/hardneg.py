"""Operator 11: hard negatives by Four-Russians scoring on bit planes.

A vector becomes integers, floor(256 * x), and these become bit planes: plane k holds bit k
(two's complement) of every component, packed eight dimensions to a byte. For a group of
eight dimensions an anchor has a table of its 256 subset sums, so a plane of a candidate is
scored by one lookup a byte, and the planes are put together by shifts and additions, the
top one with a minus. That gives full inner products in exact integers.

Anchors go in blocks of about ``ANCHOR_BLOCK``, one block at a time on the driver and
broadcast (its tables are built in the tasks, for ``TOGETHER`` anchors at a time). A block
meets all packed candidates twice: the first pass finds its positives, the second, with
their scores, the best negatives of each range. Tasks hold candidates in order of their id,
keep the first few of each list and return nothing else; Spark merges the lists of the tasks.

Defined results
    Rows without an id, with a null label or vector, or with a null or non-finite component
    take no part, nor do rows with a component so large that an inner product might not fit
    a long (|floor(256 * x)| >= sqrt(2^62 / dimensions); 2^20 for x at 64 dimensions). Rows that agree in
    id, label and integers count once. Rows that share an id but differ otherwise are rows
    of their own; a row is no other row to itself. Vectors meet vectors of their own
    dimension only; zero and empty vectors take part. Anchors without a positive, and positives without
    a negative, give no rows; nor does an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.llm.common import scratch_path, written

ANCHOR_BLOCK = 8192
#: Anchors whose tables are held at once, and candidates scored against them at once.
TOGETHER, ROWS = 256, 512
#: Candidates of a task, about.
TASK_ROWS = 1 << 16

PACKED = "id long, label long, dim int, bits int, planes binary"
LOWEST = np.iinfo(np.int64).min


def to_planes(v: np.ndarray, bits: int) -> np.ndarray:
    """Bit planes (rows x bits x bytes) of integers (rows x dimensions)."""
    shifted = (v[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    return np.packbits(shifted.astype(np.uint8), axis=2, bitorder="little")


def from_planes(planes: np.ndarray, dim: int) -> np.ndarray:
    """The integers that :func:`to_planes` packed."""
    weight = np.left_shift(np.int64(1), np.arange(planes.shape[1]))
    weight[-1] *= -1
    bit = np.unpackbits(planes, axis=2, count=dim, bitorder="little")
    return np.einsum("nkd,k->nd", bit.astype(np.int64), weight)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) to ``PACKED``; a row has as few planes as its integers need."""
    for batch in batches:
        ids, labels, lists = batch.column(0), batch.column(1), batch.column(2)
        sizes = np.diff(lists.offsets.to_numpy())
        flat, first = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            step = max(1, (1 << 22) // max(1, 64 * int(dim)))
            for low in range(0, len(rows), step):
                part = rows[low:low + step]
                v = np.floor(256 * flat[first[part][:, None] + np.arange(dim)]).astype(np.int64)
                widest = np.maximum(v, ~v).max(axis=1, initial=0)
                need = np.frexp(widest.astype(np.float64))[1] + 1  # bit length and the sign
                for bits in np.unique(need):
                    own = np.flatnonzero(need == bits)
                    blobs = [p.tobytes() for p in to_planes(v[own], int(bits))]
                    at = pa.array(part[own])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), labels.take(at), pa.array(np.full(len(own), dim), pa.int32()),
                         pa.array(np.full(len(own), bits), pa.int32()), pa.array(blobs, pa.binary())],
                        names=["id", "label", "dim", "bits", "planes"])


class Rows(NamedTuple):
    """Packed rows of one dimension."""

    id: np.ndarray
    label: np.ndarray
    mark: np.ndarray
    planes: np.ndarray  # rows x bits x bytes; rows with fewer bits have their sign repeated


def _unpacked(columns: dict[str, list], dim: int, chosen: np.ndarray) -> Rows:
    bits = np.array(columns["bits"])[chosen]
    top, width = int(bits.max()), -(-dim // 8)
    planes = np.empty((len(chosen), top, width), np.uint8)
    for b in np.unique(bits):
        own = np.flatnonzero(bits == b)
        blob = b"".join(columns["planes"][chosen[i]] for i in own)
        planes[own, :b] = np.frombuffer(blob, np.uint8).reshape(len(own), b, width)
        planes[own, b:] = planes[own, b - 1:b]
    return Rows(*(np.array(columns[c], np.int64)[chosen] for c in ("id", "label", "mark")), planes)


def subset_sums(v: np.ndarray) -> np.ndarray:
    """Tables (groups x 256 x anchors): sums of every subset of eight components of each anchor."""
    groups = -(-v.shape[1] // 8)
    padded = np.zeros((len(v), groups * 8), np.int64)
    padded[:, :v.shape[1]] = v
    bound = np.abs(padded).sum(axis=1).max(initial=0)
    kind = next(t for t in (np.int16, np.int32, np.int64) if bound <= np.iinfo(t).max)
    out = np.zeros((groups, 256, len(v)), kind)
    for g in range(groups):
        for j in range(8):
            out[g, 1 << j:2 << j] = out[g, :1 << j] + padded[:, g * 8 + j]
    return out


def score(planes: np.ndarray, tables: np.ndarray, bound: int) -> np.ndarray:
    """Inner products (candidates x anchors); ``bound`` is the largest of any anchor's sum of magnitudes."""
    rows, bits, groups = planes.shape
    total = np.zeros((rows, tables.shape[2]), np.int32 if bound << bits < 1 << 31 else np.int64)
    for k in range(bits - 1, -1, -1):
        total <<= 1
        if not groups:
            continue
        plane = tables[0].take(planes[:, k, 0], axis=0)
        for g in range(1, groups):
            plane += tables[g].take(planes[:, k, g], axis=0)
        if k == bits - 1:
            total -= plane
        else:
            total += plane
    return total


class Lists:
    """The first ``k`` (score, then id) of every list. Offers come in order of their id, so a
    later one must score higher than ``floor`` once its list is full."""

    def __init__(self, lists: int, k: int):
        self.k, self.floor = k, np.full(lists, LOWEST)
        self.at = self.score = self.id = np.zeros(0, np.int64)

    def offer(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        at, score, ids = np.r_[self.at, at], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        keep = rank < self.k
        self.at, self.score, self.id, last = at[keep], score[keep], ids[keep], rank[keep] == self.k - 1
        self.floor[self.at[last]] = self.score[last]


class Block(NamedTuple):
    """Anchors of one dimension, ``slots`` their numbers in the block, with their vectors."""

    slots: np.ndarray
    id: np.ndarray
    label: np.ndarray
    mark: np.ndarray
    vectors: np.ndarray


def _columns(batch: pa.RecordBatch) -> dict[str, list]:
    return {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}


def _by_dimension(columns: dict[str, list]) -> Iterator[tuple[int, Rows, np.ndarray]]:
    dims = np.array(columns["dim"])
    for dim in np.unique(dims):
        chosen = np.flatnonzero(dims == dim)
        yield int(dim), _unpacked(columns, int(dim), chosen), chosen


def _blocks(columns: dict[str, list]) -> dict[int, list[Block]]:
    """The anchors of a block by dimension, in parts of at most ``TOGETHER``, each of neighbouring labels."""
    out: dict[int, list[Block]] = {}
    for dim, rows, chosen in _by_dimension(columns):
        vectors = from_planes(rows.planes, dim)
        order = np.argsort(rows.label, kind="stable")
        for low in range(0, len(order), TOGETHER):
            part = order[low:low + TOGETHER]
            out.setdefault(dim, []).append(Block(chosen[part], rows.id[part], rows.label[part], rows.mark[part], vectors[part]))
    return out


def _scored(rows: Rows, block: Block, columns: np.ndarray | slice) -> Iterator[tuple[slice, np.ndarray]]:
    """Scores of all rows against some anchors of a block, ``ROWS`` rows at a time."""
    vectors = block.vectors[columns]
    tables, bound = subset_sums(vectors), int(np.abs(vectors).sum(axis=1).max(initial=0))
    for low in range(0, len(rows.id), ROWS):
        yield slice(low, low + ROWS), score(rows.planes[low:low + ROWS], tables, bound)


def _flush(kept: list[tuple[Block, int, Lists]]) -> Iterator[pa.RecordBatch]:
    for block, n, found in kept:
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.slots[found.at], pa.int32()), pa.array(block.id[found.at]), pa.array(np.full(len(found.at), n), pa.int32()),
             pa.array(found.id), pa.array(found.score)], names=["slot", "anchor_id", "n", "id", "score"])


def _positives(shared, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _blocks(shared.value)
        kept = {dim: [Lists(len(b.id), k) for b in blocks] for dim, blocks in parts.items()}
        for batch in batches:
            for dim, rows, _ in _by_dimension(_columns(batch)):
                by_label = np.argsort(rows.label, kind="stable")
                sorted_labels = rows.label[by_label]
                for block, found in zip(parts.get(dim, ()), kept.get(dim, ()), strict=True):
                    for label in np.unique(block.label):
                        a, b = np.searchsorted(sorted_labels, [label, label + 1])
                        own, columns = by_label[a:b], np.flatnonzero(block.label == label)
                        same = Rows(rows.id[own], rows.label[own], rows.mark[own], rows.planes[own])
                        for cut, scores in _scored(same, block, columns):
                            r, c = np.nonzero(scores > found.floor[columns])
                            r_all, c_all = r + cut.start, columns[c]
                            other = (same.id[r_all] != block.id[c_all]) | (same.mark[r_all] != block.mark[c_all])
                            r, c, r_all, c_all = r[other], c[other], r_all[other], c_all[other]
                            found.offer(c_all, scores[r, c].astype(np.int64), same.id[r_all])
        yield from _flush([(b, 0, found) for dim, blocks in parts.items() for b, found in zip(blocks, kept[dim], strict=True)])

    return search


def _negatives(shared, k: int, positives: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, least, most = shared.value
        parts = _blocks(columns)
        kept = {dim: [[Lists(len(b.id), k) for _ in range(positives)] for b in blocks] for dim, blocks in parts.items()}
        for batch in batches:
            for dim, rows, _ in _by_dimension(_columns(batch)):
                for block, lists in zip(parts.get(dim, ()), kept.get(dim, ()), strict=True):
                    for cut, scores in _scored(rows, block, slice(None)):
                        differ = rows.label[cut][:, None] != block.label
                        for i, found in enumerate(lists):
                            above = np.maximum(found.floor, least[block.slots, i] - 1)
                            r, c = np.nonzero((scores > above) & (scores <= most[block.slots, i]) & differ)
                            found.offer(c, scores[r, c].astype(np.int64), rows.id[cut][r])
        yield from _flush([(b, i + 1, found) for dim, blocks in parts.items()
                           for b, lists in zip(blocks, kept[dim], strict=True) for i, found in enumerate(lists)])

    return search


def score_range(positive: np.ndarray, low_percent: int, high_percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and most integer n with low_percent * positive <= 100 * n <= high_percent * positive."""
    whole, rest = positive // 100, positive % 100  # no product of a large score
    least = whole * low_percent - (-rest * low_percent) // 100
    return least, whole * high_percent + rest * high_percent // 100


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by
    ``every``) and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    that score between ``low_percent`` and ``high_percent`` of the positive's score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and label is not null")
    bound = F.sqrt(F.lit(2.0 ** 62) / F.greatest(F.size("v"), F.lit(1)))
    fits = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & (F.abs(x * 256) < bound - 1))
    packed = written(rows.where(fits).mapInArrow(_pack, PACKED), "hardneg")
    tasks = max(spark.sparkContext.defaultParallelism, -(-packed.count() // TASK_ROWS))
    held = written(packed.dropDuplicates(["id", "label", "dim", "planes"]).withColumn("mark", F.xxhash64("label", "planes")), "hardneg")
    candidates = held.repartition(tasks, "id", "mark").sortWithinPartitions("id")
    anchors = written(held.where(F.col("id") % every == 0).withColumn(
        "_place", F.pmod(F.xxhash64("id", "mark", F.lit(1)), F.lit(1 << 30))), "hardneg")
    blocks = max(1, -(-anchors.count() * 5 // (4 * anchor_block)))  # hashed blocks come out a little uneven
    kinds, done = "slot int, anchor_id long, n int, id long, score long", scratch_path(spark, "hardneg")
    per_anchor = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    per_pair = Window.partitionBy("slot", "n").orderBy(F.desc("score"), "id")
    for b in range(blocks):
        mine = anchors.where(F.pmod("_place", F.lit(blocks)) == b).drop("_place").toArrow().to_pydict()
        slots = len(mine["id"])
        first = spark.sparkContext.broadcast(mine)  # about ``anchor_block`` packed rows
        near = candidates.mapInArrow(_positives(first, positives), kinds).withColumn("n", F.row_number().over(per_anchor))
        chosen = written(near.where(F.col("n") <= positives), "hardneg")
        least, most = np.zeros((slots, positives), np.int64), np.full((slots, positives), LOWEST)
        slot, n, scores = (c.to_numpy() for c in chosen.select("slot", "n", "score").toArrow().columns)  # ``positives`` an anchor
        least[slot, n - 1], most[slot, n - 1] = score_range(scores, low_percent, high_percent)
        second = spark.sparkContext.broadcast((mine, least, most))
        found = candidates.mapInArrow(_negatives(second, negatives, positives), kinds).withColumn("rank", F.row_number().over(per_pair))
        own = chosen.select(F.col("slot").alias("_slot"), F.col("n").alias("_n"), F.col("id").alias("positive_id"),
                            F.col("score").alias("positive_score"))
        pairs = found.where(F.col("rank") <= negatives).join(own, (F.col("slot") == F.col("_slot")) & (F.col("n") == F.col("_n")))
        pairs.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                     F.col("score").alias("negative_score")).write.mode("append").parquet(done)
        first.destroy()
        second.destroy()
    return spark.read.parquet(done)


def oracle() -> str:
    return """
    WITH rows AS (
        SELECT *, row_number() OVER () AS row FROM (
            SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
    scored AS (
        SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, c.v) END::BIGINT AS score
        FROM rows a JOIN rows c ON len(a.v) = len(c.v) AND a.row <> c.row
        WHERE a.vec_id % 50 = 0),
    positives AS (
        SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS n
        FROM scored WHERE same QUALIFY n <= 5),
    ranked AS (
        SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
               row_number() OVER (PARTITION BY p.row, p.n ORDER BY s.score DESC, s.vec_id) AS rank
        FROM positives p JOIN scored s ON s.row = p.row AND NOT s.same
         AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM ranked WHERE rank <= 3"""

"""Operator 10: near-duplicates by SuperMinHash, banding, verification and union-find.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes) and a
   SuperMinHash signature: an element's ranks are one random permutation plus a
   fraction, so the ranks of different positions are correlated and their variance is
   lower; layer j of the permutation only matters to texts with a rank above j, which
   stops early (long texts end after the first layer).
2. Texts with equal sets collapse to the smallest id (a partial aggregate).
3. Bands of the signature put the others into buckets. In each bucket all are verified
   against its smallest id on full sets; the pairs are split over several tasks.
4. Components of the verified links. A bucket that still holds several components is
   compared within itself. Jaccard distance is a metric, so a text at distance d from
   the bucket's smallest id can only link with texts between d - t and d + t; cells of
   width t leave only equal and neighbouring cells to compare, in blocks of bounded
   size, and each block returns a spanning forest of its links, never all pairs. A cell
   that is one component, as the first is by the smallest id, is not compared with
   itself but only with a neighbour that holds another one, so the bulk of a large group of copies never
   meets itself. A cell of n texts in several components is compared within itself, n * n / 256 sets.

Links are confirmed on full sets in exact integers. A pair is missed only if no band of
its signatures agrees: at a similarity of 0.85 with 30 bands of 5 that is 3e-8, at 0.8
it is 7e-6.

Defined results
    A null or empty text, or one of white space only, has an empty set and is linked with
    nothing. A text of fewer words than the shingle has its whole sequence as one. Ids are integers. Rows
    that share an id count as one document with the links of all its texts; a row with a
    null id is linked with nothing, its component is null and it is kept. Repeated rows give repeated
    result rows. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import remove, unused, written
from offerlake.llm.graph import components
from offerlake.llm.hashing import U64, long_array, mix, shingles, words_of

BANDS, BAND_ROWS = 30, 5
#: Texts in a block of step 4; a task holds two blocks.
BLOCK = 256
#: Texts verified against one bucket's smallest id by one task.
STAR = 128

_ODD = U64(0x9E3779B97F4A7C15)


def superminhash(elements: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Signatures (rows x size) of sets that lie one after the other in ``elements``.

    A rank is j * 2^32 plus a 32-bit fraction, where the element's permutation has the
    position at its j-th place. Rows of empty sets stay at the largest integer.
    """
    rows = len(bounds) - 1
    out = np.full(rows * size, np.iinfo(np.uint64).max, U64)
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    draw = mix(elements + _ODD)
    first = ((draw & U64(0xFFFFFFFF)) * U64(size) >> U64(32)).astype(np.int64)
    np.minimum.at(out, owner * size + first, draw >> U64(32))
    out = out.reshape(rows, size)
    open_rows = np.flatnonzero((out.max(axis=1) >= U64(1 << 32)) & (np.diff(bounds) > 0))
    start = 0
    while start < len(open_rows):  # rows that need more layers, a bounded number of elements at a time
        sizes = np.diff(bounds)[open_rows[start:]]
        stop = start + max(1, int(np.searchsorted(np.cumsum(sizes), (1 << 22) // size, "right")))
        part = open_rows[start:stop]
        picked = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in part])
        _layers(out, part, np.repeat(np.arange(len(part)), np.diff(bounds)[part]), elements[picked], first[picked])
        start = stop
    return out


def _layers(out: np.ndarray, rows: np.ndarray, owner: np.ndarray, elements: np.ndarray, first: np.ndarray) -> None:
    """Layers 1, 2, ... of the permutations (Fisher-Yates) until no rank can sink further."""
    size = out.shape[1]
    order = np.tile(np.arange(size, dtype=np.int16), (len(elements), 1))
    at = np.arange(len(elements))
    order[at, first] = 0  # place 0 and the drawn place were swapped; place 0 is not read again
    flat = out[rows].reshape(-1)
    for j in range(1, size):
        draw = mix(elements + np.full(1, j + 1, U64) * _ODD)
        k = j + ((draw & U64(0xFFFFFFFF)) * U64(size - j) >> U64(32)).astype(np.int64)
        position = order[at, k].astype(np.int64)
        order[at, k] = order[at, j]
        np.minimum.at(flat, owner * size + position, (U64(j) << U64(32)) + (draw >> U64(32)))
        going = flat.reshape(len(rows), size).max(axis=1) >= U64((j + 1) << 32)
        if not going.all():
            out[rows[~going]] = flat.reshape(len(rows), size)[~going]
            if not going.any():
                return
            keep = going[owner]
            flat = flat.reshape(len(rows), size)[going].reshape(-1)
            owner = (np.cumsum(going) - 1)[owner[keep]]
            rows, elements, order = rows[going], elements[keep], order[keep]
            at = np.arange(len(elements))
    out[rows] = flat.reshape(len(rows), size)


def band_keys(signatures: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    cut = mix(signatures.reshape(len(signatures), bands, band_rows) + _ODD)
    places = mix(np.arange(1, bands * band_rows + 1, dtype=U64)).reshape(bands, band_rows) | U64(1)
    return mix((cut * places).sum(axis=2, dtype=U64))


def _signed(docs: DataFrame, bands: int, band_rows: int) -> DataFrame:
    """id, n_shingles, set digest (d1, d2) and band keys of every row; keys are null for empty sets."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                elements, bounds = shingles(words)
                ends = np.concatenate([[0], np.cumsum(mix(elements + U64(1)), dtype=U64)]).astype(U64)
                other = np.concatenate([[0], np.cumsum(mix(elements + U64(2)), dtype=U64)]).astype(U64)
                sizes = np.diff(bounds)
                keys = band_keys(superminhash(elements, bounds, bands * band_rows), bands, band_rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), long_array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.low, words.high - words.low), pa.array(sizes, pa.int64()),
                     long_array(ends[bounds[1:]] - ends[bounds[:-1]]), long_array(other[bounds[1:]] - other[bounds[:-1]]),
                     lists], names=["id", "n_shingles", "d1", "d2", "keys"])

    return docs.mapInArrow(sign, "id long, n_shingles long, d1 long, d2 long, keys array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id and sorted shingle hashes, as bytes, of every row."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in words_of(batch.column(1)):
                elements, bounds = shingles(words)
                blobs = [elements[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(words.low, words.high - words.low), pa.array(blobs, pa.binary())], names=["id", "elements"])

    return docs.mapInArrow(gather, "id long, elements binary")


def _hashes(blob) -> np.ndarray:
    return np.frombuffer(blob, U64)


def _star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, part, id, elements), the rep itself first: intersection and sizes against the rep."""
    current, bases = None, []
    for batch in batches:
        out = {"a": [], "b": [], "common": [], "total": []}
        for at_row, (rep, part, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            own = _hashes(batch.column(3)[at_row].as_buffer())  # no copy
            if current != (rep, part):
                current, bases = (rep, part), []
            if i == rep:
                bases.append(own.copy())  # outlives the batch; more than one only if the id is repeated
                continue
            for base in bases:
                at = np.minimum(np.searchsorted(base, own), len(base) - 1)
                common = int((base[at] == own).sum())
                for k, v in zip(out, (rep, i, common, len(base) + len(own) - common), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block, from a 0/1 matrix of the shingles that more than one set has."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    out, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for low in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [low, low + width])
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[a:b], column[a:b] - low] = 1
        out += matrix @ matrix.T
    return out


def _forest(percent: int):
    """For applyInPandas: links inside one block pair, at most one per text, between different components."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        label = rows["component"].to_numpy().copy()
        links = []
        if len(np.unique(label)) > 1:
            sets = [_hashes(b) for b in rows["elements"]]
            common, size = _common(sets), np.array([len(s) for s in sets])
            near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
            for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                if label[i] != label[j]:
                    links.append((rows["id"][i], rows["id"][j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return link


def _rest(buckets: DataFrame, stars: DataFrame, firsts: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Step 4: links between the components that share a bucket, as spanning forests of block pairs.

    ``buckets`` (key, id, rep), ``stars`` (a, b, common, total), ``firsts`` (id, component).
    """
    labelled = buckets.join(firsts.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i"), "left").select(
        "key", "id", "rep", F.coalesce("component", "id").alias("component"))
    # one bucket of those with the same texts is enough
    mixed = labelled.groupBy("key", "rep").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("mark"))
    mixed = mixed.where("n > 2 and low <> high").groupBy("n", "rep", "mark").agg(F.min("key").alias("_key"))
    members = labelled.join(mixed.select("_key"), F.col("key") == F.col("_key")).drop("_key")
    scored = members.join(stars, (F.col("rep") == F.col("a")) & (F.col("id") == F.col("b")), "left").where("id <> rep")
    # cell c holds the distances from c * (100 - percent) / 100 on, in exact integers
    width = 100 - percent
    cell = F.expr(f"cast(((total - common) * 100) div (total * {width}) as int)")
    scored = scored.select("key", "id", "component", cell.alias("cell"))
    parts = scored.groupBy("key", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).alias("parts"), F.min("component").alias("low"), F.max("component").alias("high"))
    around = parts.select(F.col("key").alias("_k"), F.explode(F.array(F.col("cell") - 1, F.col("cell"))).alias("lower"), "cell", "parts", "low", "high")
    # a pair of neighbouring cells, or a cell with itself, is needed if it holds two components
    pairs = around.groupBy("_k", "lower").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                              F.max(F.when(F.col("cell") == F.col("lower"), F.col("parts"))).alias("mine"),
                                              F.max((F.col("cell") == F.col("lower")) & (F.col("low") != F.col("high"))).alias("mixed"),
                                              F.max(F.when(F.col("cell") == F.col("lower") + 1, F.col("parts"))).alias("next"))
    pairs = written(pairs.where("low <> high and mine is not null").select(
        "_k", "lower", "mine", F.coalesce("next", F.lit(0)).alias("next"), "mixed"))
    # texts of cell c go into slots with its own blocks, if it holds several components, and with those of the neighbours
    hashed = F.xxhash64("id", "key")
    here = scored.join(pairs, (F.col("key") == F.col("_k")) & (F.col("cell") == F.col("lower"))).withColumn("_p", F.pmod(hashed, "mine").cast("int"))
    one = here.select("key", "lower", F.explode(F.sequence(
        F.when(F.col("mixed"), F.lit(0)).otherwise(F.col("mine").cast("int")), (F.col("mine") + F.col("next") - 1).cast("int"))).alias("q"),
                      F.col("_p").alias("p"), "id", "component")
    above = scored.join(pairs, (F.col("key") == F.col("_k")) & (F.col("cell") == F.col("lower") + 1)).withColumn(
        "_p", (F.col("mine") + F.pmod(hashed, "next")).cast("int"))
    two = above.select("key", "lower", F.explode(F.sequence(F.lit(0), (F.col("mine") - 1).cast("int"))).alias("q"),
                       F.col("_p").alias("p"), "id", "component")
    slots = one.unionByName(two).select("key", "lower", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "id", "component")
    filled = slots.join(sets.withColumnRenamed("id", "_s"), F.col("id") == F.col("_s")).select(
        "key", "lower", "x", "y", "id", "component", "elements")
    return filled.groupBy("key", "lower", "x", "y").applyInPandas(_forest(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, band_rows: int = BAND_ROWS, block: int = BLOCK) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept of every row: documents are linked when
    100 * intersection >= ``percent`` * union of their shingle sets."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(_signed(texts, bands, band_rows))
    known = signed.where("id is not null and n_shingles > 0")
    equal = known.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.first("keys").alias("keys"))
    # small tables of group facts are written, so that joins with them can split a large group over tasks
    many = written(equal.where("rep <> last").select(F.col("d1").alias("_1"), F.col("d2").alias("_2"), F.col("n_shingles").alias("_n"), "rep"))
    copies = known.select("id", "d1", "d2", "n_shingles").join(
        many,
        (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")) & (F.col("n_shingles") == F.col("_n"))).where(
        "id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    keyed = equal.select(F.explode("keys").alias("key"), F.col("rep").alias("id"))
    heads = written(keyed.groupBy("key").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").select(
        F.col("key").alias("_key"), "rep"))
    buckets = written(keyed.join(heads, F.col("key") == F.col("_key")).select("key", "id", "rep"))
    wanted = buckets.select("id").distinct()
    sets = written(_sets(texts.join(wanted.withColumnRenamed("id", "_w"), F.col("id") == F.col("_w"), "left_semi")).where(
        F.octet_length("elements") > 0))
    # verified against each bucket's smallest id, a bounded number of texts to a task
    pairs = written(buckets.where("id <> rep").select("rep", "id").distinct())
    loads = written(pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts")).withColumnRenamed("rep", "_r"))
    spread = pairs.join(loads, F.col("rep") == F.col("_r")).select(
        "rep", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id").unionByName(
        loads.select(F.col("_r").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("_r").alias("id")))
    filled = spread.join(sets.withColumnRenamed("id", "_s"), F.col("id") == F.col("_s")).select("rep", "part", "id", "elements")
    ordered = filled.repartition("rep", "part").sortWithinPartitions("rep", "part", F.col("id") != F.col("rep"))
    stars = written(ordered.mapInArrow(_star, "a long, b long, common long, total long").groupBy("a", "b").agg(
        F.max(F.struct((F.col("common") / F.col("total")).alias("r"), "common", "total")).alias("s")).select("a", "b", "s.common", "s.total"))
    near = stars.where(F.col("common") * 100 >= F.col("total") * percent).select("a", "b")
    firsts = written(components(near))
    more = _rest(buckets, stars, firsts, sets, percent, block)
    links = written(firsts.select(F.col("component").alias("a"), F.col("id").alias("b")).where("a <> b").unionByName(more).unionByName(copies))
    for done in (many, heads, buckets, sets, pairs, loads, stars, firsts):
        remove(docs.sparkSession, done)
    labels = components(links).withColumnRenamed("id", "_id")
    return signed.join(labels, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each group of near-duplicates: that with the
    smallest id. Of rows that share an id the one whose text has the smallest SHA-256 stays (no text first; of equal
    texts any one); rows with a null id all stay."""
    labels = near_duplicates(docs, percent, id_col, text_col)
    key = unused("_kept", docs)
    kept = labels.where("kept").select(F.col(id_col).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    # ids that are there once, nearly all, need no second look at their rows
    often = written(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(key)).agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    same = F.col(id_col).cast("long") == F.col(key)
    stay = docs.join(kept, same, "left_semi")
    row, order = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.sha2(F.col(text_col).cast("binary"), 256), F.lit(""))
    repeated = stay.join(often, same, "left_semi").groupBy(F.col(id_col).alias(key)).agg(F.min_by(row, order).alias("row")).select("row.*")
    return stay.join(often, same, "left_anti").unionByName(repeated).unionByName(docs.where(F.col(id_col).isNull()))

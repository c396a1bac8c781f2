"""Operator 6: vector bin packing of documents into shards.

Bytes, tokens (words) and rows are balanced jointly. Equal texts form a group; a
group goes to one shard unless it is larger than ``1 / split`` of a shard in some
dimension, when it is cut by a hash of the id into pieces of about that size. Groups
smaller than ``1 / cells`` of a shard are folded by the hash of their text into
``shards * cells`` cells, so that the driver sees a bounded number of items
(``shards * (2 * cells + 4 * split)`` at most) whatever the input. It places them from large
to small, each where the dot product of its vector with the residual capacity is
highest among the shards that have room for it, or, when none has, where the fullest
dimension stays lowest. At the end items are swapped between the fullest and the
emptiest shard while that brings their bytes closer.

Defined results
    law ``bytes``: the sizes (UTF-8 bytes plus 16) of the shards come out near equal.
    A null text counts as an empty one and is grouped with it. ``slot`` numbers the
    rows of a shard without gaps from 0, by item and id; repeated rows get slots of
    their own. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import gapless_rank, text_bytes, word_count, written

ROW_BYTES = 16


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item vector (rows of ``items``): dot product with the residual capacity."""
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    vectors = items / capacity
    residual, out = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -vectors.sum(axis=1), -vectors.max(axis=1))):
        v = vectors[i]
        room = (residual >= v).all(axis=1)
        if room.any():
            best = np.where(room, residual @ v, -np.inf).argmax()
        else:
            best = (v - residual).max(axis=1).argmin()
        out[i] = best
        residual[best] -= v
    return even_out(vectors[:, 0], out, shards)


def even_out(sizes: np.ndarray, placed: np.ndarray, shards: int, rounds: int = 4000) -> np.ndarray:
    """Swap items (or move one) between the fullest and the emptiest shard while that narrows their gap."""
    loads = np.bincount(placed, sizes, shards)
    for _ in range(rounds):
        top, low = loads.argmax(), loads.argmin()
        gap = loads[top] - loads[low]
        mine, theirs = np.flatnonzero(placed == top), np.flatnonzero(placed == low)
        theirs = np.append(theirs[np.argsort(sizes[theirs], kind="stable")], -1)  # -1: nothing comes back
        held = np.append(sizes[theirs[:-1]], 0.0)
        order = np.argsort(held, kind="stable")
        at = np.searchsorted(held[order], sizes[mine] - gap / 2)
        pairs = [(i, order[min(max(a + d, 0), len(order) - 1)]) for i, a in enumerate(at) for d in (-1, 0)]
        left = [abs(gap - 2 * (sizes[mine[i]] - held[j])) for i, j in pairs]
        if not left or min(left) > gap * 0.999 or gap < 1e-6:
            break
        i, j = pairs[int(np.argmin(left))]
        moved = sizes[mine[i]] - held[j]
        placed[mine[i]] = low
        if theirs[j] >= 0:
            placed[theirs[j]] = top
        loads[top] -= moved
        loads[low] += moved
    return placed


def pack_shards(docs: DataFrame, shards: int = 40, cells: int = 256, split: int = 4,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard of every row."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    rows = written(docs.select(F.col(id_col).alias("_id"), (text_bytes(F.col(text_col)) + ROW_BYTES).alias("size"),
                               word_count(F.col(text_col)).alias("_tokens"), F.crc32(text.cast("binary")).alias("text_crc32"),
                               F.xxhash64(text).alias("_hash")), "shards")
    sums = [F.sum("size").alias("bytes"), F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    count = shards * cells
    groups = rows.groupBy("_hash").agg(*sums)
    share = F.greatest(F.col("bytes") * float(shards) / float(total["bytes"] or 1),
                       F.col("rows") * float(shards) / float(total["rows"] or 1))
    # a group of more than 1 / cells of a shard in bytes or rows: at most 2 * shards * cells of them
    large = groups.where(share * cells > 1).select(
        F.col("_hash").alias("_large"), F.least(F.col("rows"), F.ceil(share * split)).alias("_pieces"))
    large = spark.createDataFrame(large.collect(), "_large long, _pieces long")
    unit = F.when(F.col("_pieces").isNull(), F.concat(F.lit("c"), F.pmod("_hash", F.lit(count)))).otherwise(
        F.concat(F.lit("g"), F.col("_hash"), F.lit("/"), F.pmod(F.xxhash64("_id"), "_pieces")))
    keyed = rows.join(F.broadcast(large), rows["_hash"] == large["_large"], "left").withColumn("_unit", unit).drop(
        "_large", "_pieces")
    units = keyed.groupBy("_unit").agg(*sums).orderBy("_unit").collect()  # bounded, see above
    vectors = np.array([[u["bytes"], u["tokens"], u["rows"]] for u in units], float).reshape(-1, 3)
    placed = list(zip([u["_unit"] for u in units], place(vectors, shards).tolist(), strict=True))
    where = spark.createDataFrame(placed, "_placed string, shard int")
    located = keyed.join(F.broadcast(where), F.col("_unit") == F.col("_placed")).drop("_placed")
    ranked = gapless_rank(located, ["shard"], "_unit", ["_id", "text_crc32"], "slot")
    return ranked.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))

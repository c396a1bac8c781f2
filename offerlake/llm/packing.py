"""Operator 3: optimal length buckets and token-budget batches.

The histogram of all lengths (a bin per length below 2^12, 2^11 bins per doubling
beyond, so a bounded number of bins) goes to the driver. Dynamic programming over the
bins chooses at most ``buckets`` boundaries with the least padding in total. Every text
joins the bucket of the smallest boundary that holds it. A batch of a bucket has as many
rows as fit ``budget`` tokens when each is padded to the boundary; rows fill the batches
of their bucket without gaps.

Defined results
    A text's length is its words plus one end token, so null and empty texts have length
    1. With ``length_col`` it is that column's number (real tokens, as ``tokens.token_counts``
    gives them) plus one end token, null and negative counting as 0, and no text is read. A text longer than the budget is a batch by itself, whole. Rows of a bucket are
    ordered by a hash slice, then id and length; rows that agree in all are
    interchangeable. Repeated rows are packed as often as they occur. An empty table
    gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import gapless_rank, word_count, written

BUCKETS, BUDGET = 16, 16_384
#: Rows that are numbered together in one task, about.
SLICE_ROWS = 50_000


def boundaries(count: np.ndarray, longest: np.ndarray, total: np.ndarray, buckets: int) -> tuple[list[int], int]:
    """Bucket boundaries with the least padding, and that padding. Bins ascend; ``longest`` is
    each bin's largest length, ``total`` its sum of lengths."""
    n = len(count)
    if n == 0:
        return [], 0
    rows = np.append(0, np.cumsum(count)).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    chosen = []
    for _ in range(min(buckets, n)):
        following, source = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + float(longest[j - 1]) * (rows[j] - rows[:j])
            i = int(cost.argmin())
            if cost[i] < following[j]:
                following[j], source[j] = cost[i], i
        best = following
        chosen.append(source)
    out, j = [], n
    for source in reversed(chosen):
        if source[j] >= 0:
            out.append(int(longest[j - 1]))
            j = int(source[j])
    return out[::-1], int(best[n]) - int(total.sum())


def bin_of(length: Column) -> Column:
    """Lower end of the histogram bin: the leading 12 binary digits of the length."""
    drop = F.greatest(F.length(F.bin(length)) - 12, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", length, drop), drop)


def pack_batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id",
                 text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``id_col``, n_tokens, bucket, bucket_length, batch_id, slot, padding of every row."""
    held = F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)) if length_col else word_count(F.col(text_col))
    rows = written(docs.select(F.col(id_col).alias("_id"), (held + 1).cast("long").alias("n_tokens")), "packing")
    bins = rows.groupBy(bin_of(F.col("n_tokens")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("top"), F.sum("n_tokens").alias("sum")).orderBy("bin").collect()
    count, top, total = (np.array([b[k] for b in bins], np.int64) for k in ("n", "top", "sum"))
    ends, _ = boundaries(count, top, total, buckets)
    capacity = [max(1, budget // e) for e in ends]
    held = [int(count[(top <= e) & (top > low)].sum()) for e, low in zip(ends, [0, *ends], strict=False)]
    first = np.append(0, np.cumsum([-(-h // c) for h, c in zip(held, capacity, strict=True)])).tolist()
    number = lambda values: F.array(*[F.lit(int(v)).cast("long") for v in values] or [F.lit(0).cast("long")])
    bucket = sum([(F.col("n_tokens") > e).cast("int") for e in ends], F.lit(0))
    slices = max(64, -(-int(count.sum()) // SLICE_ROWS))
    keyed = rows.withColumn("bucket", bucket.cast("int")).withColumn(
        "_slice", F.pmod(F.xxhash64("_id", "n_tokens"), F.lit(slices)).cast("int"))
    ranked = gapless_rank(keyed, ["bucket"], "_slice", ["_id", "n_tokens"], "_rank")
    at = lambda values: F.element_at(number(values), F.col("bucket") + 1)
    return ranked.select(
        F.col("_id").alias(id_col), "n_tokens", "bucket", at(ends).alias("bucket_length"),
        (at(first) + F.floor(F.col("_rank") / at(capacity))).cast("long").alias("batch_id"),
        (F.col("_rank") % at(capacity)).cast("long").alias("slot"), (at(ends) - F.col("n_tokens")).alias("padding"))

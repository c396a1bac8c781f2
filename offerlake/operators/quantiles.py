"""Exact quantiles and ranks without gathering a group into one task.

Spark's ``percentile`` keeps a value->count map per group and merges it in a
single task; for a global median over billions of distinct salaries that map
does not fit, and a window over a whole group sorts the group in one task. Here
ranks are found in two levels, at every size in the same way:

1. pre-aggregate ``(group, value) -> n`` (partial aggregation before the shuffle);
2. every row falls into a *bucket*, a fixed monotone function of its value (256
   buckets per doubling of a number, the leading digits of a hash), so the bucket
   of a row does not depend on sampling, partition bounds or the other rows;
3. a small table of bucket totals per group (its rows are bounded by the range of
   the values, not by the data) has running sums: the offset of each bucket;
4. rows are numbered inside (group, bucket), so a hot group is spread over many
   tasks, and the offset is added.

Quantiles only join the buckets that hold a wanted rank. Interpolation is numpy's
default ("linear"), which is also DuckDB ``quantile_cont`` / ``median`` and pandas
``quantile``. NULLs are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS_PER_DOUBLING = 256


def _joined(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; the facts' copies of the keys are dropped."""
    renamed = facts.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in facts.columns])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def _qname(p: float) -> str:
    s = f"{p * 100:g}".replace(".", "_")
    return f"q{s}"


def number_bucket(v: Column) -> Column:
    """Monotone integer bucket of a number: about 0.3 % wide, the same everywhere."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) + 1.0) * BUCKETS_PER_DOUBLING)).cast("long")


def _offsets(bucketed: DataFrame, by: list[str], weight: Column) -> DataFrame:
    """(by..., _b): weight of the bucket (``_bn``), of all before it (``_off``) and of the group (``_tot``)."""
    totals = bucketed.groupBy(*by, "_b").agg(F.sum(weight).alias("_bn"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumns({"_off": F.coalesce(F.sum("_bn").over(before), F.lit(0)),
                               "_tot": F.sum("_bn").over(group)})


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float],
                    by: list[str] | tuple = (), names: list[str] | None = None,
                    weight: str | None = None) -> DataFrame:
    """One row per group of ``by``: ``names[i]`` = quantile ``probs[i]`` of ``value``,
    plus ``_count`` (non-null rows). ``weight`` is an optional row multiplicity."""
    by = list(by)
    names = list(names) if names else [_qname(p) for p in probs]
    vcol = F.col(value) if isinstance(value, str) else value
    base = df.select(*[F.col(b) for b in by], vcol.cast("double").alias("_v"),
                     (F.col(weight).cast("long") if weight else F.lit(1).cast("long")).alias("_w"))
    counts = base.where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.sum("_w").alias("_n")) \
        .withColumn("_b", number_bucket(F.col("_v")))

    ranks = []       # wanted 0-based ranks: the two around each quantile
    for p in probs:
        lo = F.floor((F.col("_tot") - 1) * F.lit(float(p)))
        ranks += [lo, F.least(lo + 1, F.col("_tot") - 1)]
    holds = reduce(lambda a, b: a | b, [(F.col("_off") <= r) & (r < F.col("_off") + F.col("_bn")) for r in ranks])
    wanted = _offsets(counts, by, F.col("_n")).where(holds)

    keys = [*by, "_b"]
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _joined(counts, wanted, keys).withColumn("_end", F.col("_off") + F.sum("_n").over(inside))   # ranks [_end - _n, _end)
    at = [F.max(F.when((F.col("_end") - F.col("_n") <= r) & (r < F.col("_end")), F.col("_v"))).alias(f"_r{i}")
          for i, r in enumerate(ranks)]
    grouped = placed.groupBy(*by).agg(F.max("_tot").alias("_count"), *at)
    outs = []
    for i, (p, n) in enumerate(zip(probs, names)):
        h = (F.col("_count") - 1) * F.lit(float(p))
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        outs.append((low + (h - F.floor(h)) * (high - low)).alias(n))
    out = grouped.select(*by, *outs, "_count")
    return out if by else out.where(F.col("_count").isNotNull())


def median_by(df: DataFrame, value: str, by: list[str] | tuple = (), name: str = "median",
              weight: str | None = None) -> DataFrame:
    return exact_quantiles(df, value, [0.5], by, [name], weight=weight)


def rank_within(df: DataFrame, by: list[str] | tuple, order: str, digits: int = 4) -> DataFrame:
    """Adds ``_rank`` (0-based position by ``order`` inside its ``by`` group) and
    ``_group_n``. ``order`` is a hash in hex, unique within a group; its first ``digits``
    digits are the bucket, so each group is dealt over 16^digits even buckets and no
    row can get lost between the rows and the table of bucket sizes. Without groups that
    table is bounded and goes to the rows, which are shuffled once."""
    by = list(by)
    bucketed = df.withColumn("_b", F.substring(order, 1, digits))
    sizes = _offsets(bucketed, by, F.lit(1).cast("long"))
    sizes = sizes if by else F.broadcast(sizes)
    keys = [*by, "_b"]
    local = bucketed.withColumn("_lr", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return _joined(local, sizes, keys).select(
        *df.columns, (F.col("_off") + F.col("_lr")).alias("_rank"), F.col("_tot").alias("_group_n"))


def first_within(df: DataFrame, by: list[str], order: str, share: float, out: str, digits: int = 4) -> DataFrame:
    """Adds ``out``: 1 for the first round(share * n) rows of each of the few ``by`` groups in the order of the hash
    ``order``, else 0; the same rows as by ``rank_within``. The sizes of the buckets decide for all buckets but the one
    that the bound falls into, so only the rows of that bucket are numbered and shuffled."""
    bucketed = df.withColumn("_b", F.coalesce(F.substring(order, 1, digits), F.lit("")))
    wanted = F.round(F.col("_tot") * share)
    bound = _offsets(bucketed, by, F.lit(1).cast("long")).withColumn("_wanted", wanted).where(
        (F.col("_off") < F.col("_wanted")) & (F.col("_wanted") <= F.col("_off") + F.col("_bn"))).select(
        *[F.col(k).alias(f"_k_{k}") for k in by], F.col("_b").alias("_last"), (F.col("_wanted") - F.col("_off")).alias("_left"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by])
    rows = bucketed.join(F.broadcast(bound), on, "left")   # a row per group; none where no row is wanted
    split = F.coalesce(F.col("_b") == F.col("_last"), F.lit(False))
    clear = rows.where(~split).withColumn(out, F.coalesce((F.col("_b") < F.col("_last")).cast("int"), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    last = rows.where(split).withColumn(out, (number <= F.col("_left")).cast("int"))
    return clear.unionByName(last).select(*df.columns, out)


def count_below(points: DataFrame, market: DataFrame, value: str) -> DataFrame:
    """(v, below): for every distinct ``points.v`` the number of non-null ``market`` values
    strictly below it. Points enter the table of market counts as rows of weight zero that
    come before equal values; no point meets a market row."""
    mk = market.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")) \
        .agg(F.count(F.lit(1)).alias("n")).withColumn("_side", F.lit(1))
    pv = points.where(F.col("v").isNotNull()).select(F.col("v").cast("double").alias("v")).distinct() \
        .withColumn("n", F.lit(0).cast("long")).withColumn("_side", F.lit(0))
    both = mk.unionByName(pv).withColumn("_b", number_bucket(F.col("v")))
    sizes = _offsets(both, [], F.col("n")).select(F.col("_b").alias("_k"), "_off")
    inside = Window.partitionBy("_b").orderBy("v", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = both.withColumn("_cum", F.sum("n").over(inside)).where(F.col("_side") == 0)
    return local.join(sizes, F.col("_b") == F.col("_k")).select("v", (F.col("_off") + F.col("_cum")).alias("below"))

"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm.common import remove, written


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """(id, component) for every id of ``links(a, b)``: the smallest id that it reaches.

    Each step points every id, or every smaller neighbour, to the smallest id around
    it; both are a partial minimum per id and a join on the id. Steps are written to
    the shared folder, and they end when the links no longer change.
    """
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(limit):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join deals both sides anew and a large star can be split over tasks
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a").select(F.col("a").alias("k"), "m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("k"), "left").select(
            F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        tops = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(tops, F.col("a") == F.col("k")).select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        following = written(small.where("a <> b").distinct())
        # a sum of hashes tells whether the set of links has changed
        now = tuple(following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        for done in (edges, low):
            remove(edges.sparkSession, done)
        edges = following
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled after {limit} steps")
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ids.unionByName(roots)

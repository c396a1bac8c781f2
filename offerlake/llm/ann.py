"""Operator 7: nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors collapse to one. The distinct ones are dealt by a hash into shards of about
``SHARD_ROWS``; each shard grows its graph in one task: starting from random edges, a
beam search for every vector proposes neighbours, and pruning keeps a neighbour only if no
kept one is nearer to it by the factor ``alpha`` than the vector itself is (first 1, then
relaxed). The index is a table with a row per shard. Queries go in blocks of
``QUERY_BLOCK``, one at a time: a block is on the driver and broadcast, each shard answers it by beam
search from its entry point, the answers are scored again in double precision on the
original vectors, and the best of them are written before the next block is read.
Every query searches every shard, so the work grows with queries times shards.

Defined results
    Null and zero vectors and those with null or non-finite components take no part, nor
    does a row without an id. Vectors meet only vectors of their own dimension. Every copy
    of a vector is a candidate of its own: of equal vectors the smallest ids come first, and
    a query leaves out its own row only. Rows that agree in id and vector count once; rows that share an id
    but not the vector are candidates, and queries with five answers, each. An empty table gives
    no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.llm.common import scratch_path, written

SHARD_ROWS = 4096
QUERY_BLOCK = 8192
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Vectors that search the graph in step.
TOGETHER = 256


def beam_search(unit: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, distances) of each query's ``beam`` nearest found, nearest first; -1 where there are fewer."""
    n, rows = len(unit), np.arange(len(queries))[:, None]
    ids = np.full((len(queries), beam), -1)
    far = np.full((len(queries), beam), np.inf, np.float32)
    ids[:, 0], far[:, 0] = entry, 1 - queries @ unit[entry]
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, [entry, n]] = True
    open_ = np.zeros((len(queries), beam), bool)
    open_[:, 0] = True
    active = np.arange(len(queries))
    while len(active):
        at = np.where(open_[active], far[active], np.inf).argmin(axis=1)
        open_[active, at] = False
        near = graph[ids[active, at]]
        fresh = ~seen[active[:, None], near]
        seen[active[:, None], near] = True
        distance = 1 - np.einsum("qrd,qd->qr", unit[np.minimum(near, n - 1)], queries[active])
        distance = np.where(fresh, distance, np.inf).astype(np.float32)
        all_far = np.concatenate([far[active], distance], axis=1)
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
        all_open = np.concatenate([open_[active], fresh], axis=1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        pick = rows[:len(active)], order
        far[active], ids[active], open_[active] = all_far[pick], all_ids[pick], all_open[pick]
        active = active[open_[active].any(axis=1)]
    return ids, far


def prune(unit: np.ndarray, own: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours (padded with the number of vectors) that robust pruning keeps, per row of candidates (-1: none)."""
    n = len(unit)
    order = np.sort(candidates, axis=1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    order[order == own[:, None]] = -1
    vectors = unit[np.maximum(order, 0)]
    distance = np.where(order >= 0, 1 - np.einsum("qcd,qd->qc", vectors, unit[own]), np.inf)
    sort = np.argsort(distance, axis=1, kind="stable")
    rows = np.arange(len(own))
    order, distance, vectors = (np.take_along_axis(order, sort, 1), np.take_along_axis(distance, sort, 1),
                                vectors[rows[:, None], sort])
    left = np.isfinite(distance)
    out = np.full((len(own), degree), n)
    for k in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        first = left.argmax(axis=1)
        out[some, k] = order[rows, first][some]
        between = 1 - np.einsum("qcd,qd->qc", vectors, vectors[rows, first])
        left &= ~(alpha * between < distance)
        left[rows, first] = False
    return out


def build(unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Graph (rows x degree, padded with the number of rows) and entry point."""
    n = len(unit)
    entry = int((unit @ unit.mean(axis=0)).argmax())
    draw = np.random.default_rng(n)
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        full[np.arange(n), np.arange(n)] = n
        return np.concatenate([full, np.full((n, max(0, degree - n)), n)], axis=1)[:, :max(degree, n)], entry
    graph = draw.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = n
    for factor in (1.0, alpha):
        order = draw.permutation(n)
        for low in range(0, n, TOGETHER):
            own = order[low:low + TOGETHER]
            found, _ = beam_search(unit, graph, entry, unit[own], beam)
            mine = np.where(graph[own] < n, graph[own], -1)
            graph[own] = prune(unit, own, np.concatenate([found, mine], axis=1), factor, degree)
            # edges back; a vector with too many neighbours is pruned again
            to, back = graph[own].reshape(-1), np.repeat(own, degree)
            back, to = back[to < n], to[to < n]
            sort = np.argsort(to, kind="stable")
            back, to = back[sort], to[sort]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            extra = np.full((len(targets), int(count.max())), -1)
            extra[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            for a in range(0, len(targets), TOGETHER):
                t = targets[a:a + TOGETHER]
                mine = np.where(graph[t] < n, graph[t], -1)
                graph[t] = prune(unit, t, np.concatenate([mine, extra[a:a + TOGETHER]], axis=1), factor, degree)
    return graph, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow of squares
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)).astype(np.float32)


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: its vectors, graph and entry point as one row."""
    rows = rows.sort_values(["first", "uid"])
    vectors = np.stack(rows["embedding"]).astype(np.float64)
    graph, entry = build(_unit(vectors))
    return pd.DataFrame([(len(vectors[0]), *(rows[c].to_numpy(np.int64).tobytes() for c in ("uid", "first")), vectors.tobytes(),
                          graph.astype(np.int32).tobytes(), entry)], columns=["dim", "uids", "firsts", "vectors", "graph", "entry"])


def _searcher(shared, keep: int, beam: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, questions = shared.value
        for batch in batches:
            for shard in batch.to_pylist():
                own = np.flatnonzero([len(q) == shard["dim"] for q in questions])
                if not len(own):
                    continue
                vectors = np.frombuffer(shard["vectors"]).reshape(-1, shard["dim"])
                uids, firsts = (np.frombuffer(shard[c], np.int64) for c in ("uids", "firsts"))
                graph = np.frombuffer(shard["graph"], np.int32).reshape(len(uids), -1)
                unit, length = _unit(vectors), np.linalg.norm(vectors, axis=1)
                for low in range(0, len(own), TOGETHER):
                    part = own[low:low + TOGETHER]
                    queries = np.array([questions[i] for i in part])
                    found, _ = beam_search(unit, graph, shard["entry"], _unit(queries), beam)
                    row, place = np.nonzero(found >= 0)
                    ids = found[row, place]
                    score = np.einsum("nd,nd->n", vectors[ids], queries[row]) / (length[ids] * np.linalg.norm(queries, axis=1)[row])
                    order = np.lexsort((firsts[ids], -score, row))
                    row, ids, score = row[order], ids[order], score[order]
                    rank = np.arange(len(row)) - np.searchsorted(row, row)
                    best = rank < keep
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(asked[part][row[best]]), pa.array(uids[ids[best]]), pa.array(firsts[ids[best]]), pa.array(score[best])],
                        names=["asked", "uid", "first", "score"])

    return search


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(
        "embedding", lambda x: x != 0)
    rows = rows.where("id is not null").where(fine).withColumn("mark", F.xxhash64("embedding"))
    rows = written(rows.dropDuplicates(["id", "mark", "embedding"]), "ann")
    # of equal vectors the k + 1 smallest ids can be among the k nearest of some query
    smallest = rows.withColumn("n", F.row_number().over(Window.partitionBy("mark", "embedding").orderBy("id"))).where(F.col("n") <= k + 1)
    # the numbers of the vectors are fixed by being written
    distinct = written(smallest.groupBy("mark", "embedding").agg(F.min("id").alias("first"), F.collect_list("id").alias("ids")).withColumn(
        "uid", F.monotonically_increasing_id()), "ann")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.select("uid", "first", "embedding", F.size("embedding").alias("_dim"), F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    # a task for every shard or two: shards are small in bytes, and would be put together otherwise
    index = written(dealt.repartition(2 * shards, "_dim", "shard").groupBy("_dim", "shard").applyInPandas(
        lambda g: _index(g), "dim int, uids binary, firsts binary, vectors binary, graph binary, entry int"), "ann")
    asked = written(rows.where(F.col("id") % every == 0).select("id", "mark", "embedding").join(
        distinct.select(F.col("mark").alias("_m"), F.col("embedding").alias("_e"), "uid"),
        (F.col("mark") == F.col("_m")) & (F.col("embedding") == F.col("_e"))).select("id", "uid"), "ann")
    wanted = written(distinct.join(asked.select(F.col("uid").alias("_u")).distinct(), F.col("uid") == F.col("_u"), "left_semi").select(
        "uid", "embedding", F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(1 << 30)).alias("place")), "ann")
    blocks = max(1, -(-wanted.count() * 5 // (4 * query_block)))  # hashed blocks come out a little uneven
    per_asked, answered = Window.partitionBy("asked").orderBy(F.desc("score"), "first", "uid"), scratch_path(spark, "ann")
    for b in range(blocks):
        held = wanted.where(F.pmod("place", F.lit(blocks)) == b).select("uid", "embedding").collect()
        shared = spark.sparkContext.broadcast((np.array([r["uid"] for r in held], np.int64), [list(r["embedding"]) for r in held]))
        answers = index.mapInArrow(_searcher(shared, k + 1, max(beam, k + 1)), "asked long, uid long, first long, score double")
        answers.withColumn("n", F.row_number().over(per_asked)).where(F.col("n") <= k + 1).select("asked", "uid", "score").write.mode(
            "append").parquet(answered)
        shared.destroy()
    copies = spark.read.parquet(answered).join(
        distinct.select(F.col("uid").alias("_u"), F.explode("ids").alias("vec_id")), F.col("uid") == F.col("_u")).select(
        F.col("asked").alias("_a"), "uid", "vec_id", "score")
    # k + 1 of all copies per asked vector suffice for every query that asks with it
    top = Window.partitionBy("_a").orderBy(F.desc("score"), "vec_id", "uid")
    best = written(copies.withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1).groupBy("_a").agg(
        F.sort_array(F.collect_list(F.struct("n", "vec_id", "score", "uid"))).alias("near")), "ann")
    others = F.slice(F.filter("near", lambda x: (x["vec_id"] != F.col("query_id")) | (x["uid"] != F.col("uid"))), 1, k)
    found = asked.select(F.col("id").alias("query_id"), "uid").join(best, F.col("uid") == F.col("_a"))
    return found.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))

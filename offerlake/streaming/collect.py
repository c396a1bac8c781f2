"""The collection loop as a stream and event-time de-duplication.

``collect_to_target`` reads offer records file by file and keeps a record the first time its
fingerprint is seen, in this run or in earlier ones. Every micro-batch is written under its
own number before the next one starts, so the seen-set is the table of what was collected: a batch
that is run again after a failure overwrites its own rows and reads only those of the batches before it, and no
offer is doubled or lost. Rows get a running number, by batch and fingerprint; at ``target`` the run ends, and
each time another ``snapshot_every`` rows are full, the rows up to there are written as a snapshot.
Counters per keyword are written with each batch: rows seen, collected, and met before.

``dedup_events`` keeps one row per key in event time: the state holds a key until the
watermark has passed it by the delay, and rows behind the watermark are dropped and counted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.operators.quantiles import rank_within
from offerlake.session import materialize, scratch_root


class Collected(NamedTuple):
    """Folders of a run: collected rows (with ``n`` and ``batch``), counters and snapshots."""

    folder: str

    @property
    def rows(self) -> str:
        return f"{self.folder}/rows"

    @property
    def counters(self) -> str:
        return f"{self.folder}/counters"

    def snapshot(self, n: int) -> str:
        return f"{self.folder}/snapshots/progress_{n}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _before(spark: SparkSession, path: str, batch: int) -> DataFrame | None:
    """Rows that the batches before ``batch`` wrote."""
    return spark.read.parquet(path).where(F.col("batch") < batch) if exists(spark, path) else None


def collect_batch(rows: DataFrame, batch: int, out: Collected, key: str, keyword: str, target: int,
                  snapshot_every: int = 100, seen: DataFrame | None = None) -> int:
    """Take one micro-batch in; returns how many rows the run has then."""
    spark = rows.sparkSession
    held = _before(spark, out.rows, batch)
    have = held.count() if held is not None else 0
    if have >= target:
        return have
    fresh = rows.dropDuplicates([key])
    for known in (held, seen):
        if known is not None:
            fresh = fresh.join(known.select(F.col(key).alias("_seen")), F.col(key) == F.col("_seen"), "left_anti")
    fresh = materialize(rank_within(fresh, [], key).withColumn("n", F.col("_rank") + F.lit(have + 1)).drop("_rank", "_group_n"))
    kept = fresh.where(F.col("n") <= target)
    kept.write.mode("overwrite").parquet(f"{out.rows}/batch={batch}")
    counted = rows.groupBy(keyword).agg(F.count(F.lit(1)).alias("seen"))
    taken = fresh.groupBy(F.col(keyword).alias("_k")).agg(F.count(F.lit(1)).alias("_new"), F.sum((F.col("n") <= target).cast("long")).alias("_kept"))
    counters = counted.join(taken, F.col(keyword).eqNullSafe(F.col("_k")), "left").select(
        keyword, "seen", F.coalesce("_kept", F.lit(0)).alias("collected"), (F.col("seen") - F.coalesce("_new", F.lit(0))).alias("duplicates"))
    counters.write.mode("overwrite").parquet(f"{out.counters}/batch={batch}")
    total = have + spark.read.parquet(f"{out.rows}/batch={batch}").count()
    full = total // snapshot_every * snapshot_every
    if full > have // snapshot_every * snapshot_every:
        spark.read.parquet(out.rows).where(F.col("n") <= full).drop("batch").write.mode("overwrite").parquet(out.snapshot(full))
    return total


def collect_to_target(stream: DataFrame, out: Collected, key: str, keyword: str, target: int, snapshot_every: int = 100,
                      seen: DataFrame | None = None, after_batch: Callable[[int], None] | None = None) -> Collected:
    """Run the loop over what is there now, up to ``target`` rows; run again, it goes on where it stopped.
    ``seen`` has the fingerprints of earlier runs; ``after_batch`` is called with the number of each batch taken in."""
    state = {"total": 0}

    def take(rows: DataFrame, batch: int) -> None:
        state["total"] = collect_batch(rows, batch, out, key, keyword, target, snapshot_every, seen)
        if after_batch is not None:
            after_batch(batch)

    query = (stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{out.folder}/checkpoint")
             .trigger(availableNow=True).start())
    while not query.awaitTermination(1):
        if state["total"] >= target:
            query.stop()
    if query.exception():
        raise query.exception()
    return out


def collected_rows(spark: SparkSession, out: Collected) -> DataFrame:
    return spark.read.parquet(out.rows).drop("batch")


def counters(spark: SparkSession, out: Collected, keyword: str, batch: int | None = None) -> DataFrame:
    """Seen, collected and duplicates per keyword after ``batch`` (by default the last one)."""
    table = spark.read.parquet(out.counters)
    table = table if batch is None else table.where(F.col("batch") <= batch)
    return table.groupBy(keyword).agg(*[F.sum(c).alias(c) for c in ("seen", "collected", "duplicates")])


def dedup_events(stream: DataFrame, key: list[str], event_time: str, delay: str, folder: str) -> tuple[DataFrame, int]:
    """R1 in event time: (rows kept, rows that came too late). The state is bounded by ``delay``."""
    spark = stream.sparkSession
    if dict(stream.dtypes)[event_time] == "timestamp_ntz":  # watermarks need TIMESTAMP
        stream = stream.withColumn(event_time, F.col(event_time).cast("timestamp"))
    once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    query = (once.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start(f"{folder}/rows"))
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    late = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    return spark.read.parquet(f"{folder}/rows"), late


def read_files(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The Parquet files of ``folder`` as a stream, oldest first, ``files`` to a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(folder)


#: Rows of a file that ``write_in_turn`` leaves.
FILE_ROWS = 250_000


def write_in_turn(df: DataFrame, turn: str, folder: str, rows: int = FILE_ROWS) -> int:
    """Files as a collector leaves them behind, in the order of the small column ``turn``: for every value of it as many
    as the largest one needs, at about ``rows`` rows each. Returns that number: a micro-batch of so many files is one
    turn, so a turn with fewer is filled up with empty ones. ``df`` is computed once, and dealt out by turn as it is written."""
    spark = df.sparkSession
    held = f"{scratch_root(spark)}/turns/{uuid.uuid4().hex}"
    df.withColumn("_turn", F.col(turn)).drop(turn).write.partitionBy("_turn").parquet(held)
    dealt = spark.read.parquet(held)
    turns = dealt.where(F.col("_turn").isNotNull()).groupBy("_turn").count().orderBy("_turn").collect()  # a row per turn
    files = max([1, *(-(-n // rows) for _, n in turns)])
    for value, _ in turns:
        path, part = f"{folder}/turn={value}", dealt.where(F.col("_turn") == value).drop("_turn")
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.parquet(path)
        for _ in range(files - len(spark.read.parquet(path).inputFiles())):
            part.limit(0).coalesce(1).write.mode("append").parquet(path)
    return files

"""The collection loop: restarts, target, snapshots, earlier runs, counters after each batch; event time."""

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from offerlake.streaming import collect as CO
from offerlake.streaming.dedup import collect_offers, offer_records
from tests.conftest import SF_SMALL

SCHEMA = "id long, source string, fingerprint string"


def arrivals(n=60, files=5):
    """Rows per file: repeats inside a file, across files, null sources."""
    return [[(f * n + i, ("a", "b", None)[i % 3], f"{(f * 17 + i) % 90:04x}" + "0" * 28) for i in range(n)] for f in range(files)]


@pytest.fixture
def incoming(spark, tmp_path):
    rows = [(*r, f) for f, batch in enumerate(arrivals()) for r in batch]
    df = spark.createDataFrame(rows, SCHEMA + ", turn int")
    CO.write_in_turn(df, "turn", str(tmp_path / "in"))
    return lambda: CO.read_files(spark, str(tmp_path / "in"), df.drop("turn").schema)


def expected(target, seen=()):
    """(rows as (fingerprint, n), counters per source after each batch), plainly."""
    known, rows, count, after = set(seen), [], Counter(), []
    for batch in arrivals():
        if len(rows) >= target:
            break
        new = sorted({r[2] for r in batch} - known)
        first = {}
        for r in batch:
            first.setdefault(r[2], r[1])
        for fp in new:
            known.add(fp)
            if len(rows) < target:
                rows.append((fp, len(rows) + 1))
        after.append((len(batch), len(new), len(rows)))
    return rows, after


@pytest.mark.parametrize("target", [1000, 75, 60, 1])
def test_rows_and_target(spark, incoming, tmp_path, target):
    out = CO.collect_to_target(incoming(), CO.Collected(str(tmp_path / "out")), "fingerprint", "source", target, snapshot_every=25)
    rows, _ = expected(target)
    assert sorted((r.fingerprint, r.n) for r in CO.collected_rows(spark, out).collect()) == sorted(rows)
    last = len(rows) // 25 * 25
    assert not last or sorted(r.n for r in spark.read.parquet(out.snapshot(last)).collect()) == list(range(1, last + 1))


def test_counters_after_every_batch(spark, incoming, tmp_path):
    out = CO.collect_to_target(incoming(), CO.Collected(str(tmp_path / "out")), "fingerprint", "source", 1000)
    _, after = expected(1000)
    total = Counter()
    for batch, (size, new, have) in enumerate(after):
        found = CO.counters(spark, out, "source", batch).collect()
        total.update({"seen": size, "duplicates": size - new})
        assert sum(r.seen for r in found) == total["seen"] and sum(r.duplicates for r in found) == total["duplicates"]
        assert sum(r.collected for r in found) == have and {r.source for r in found} == {"a", "b", None}


@pytest.mark.parametrize("stop", [0, 1, 2])
def test_a_run_that_fails_goes_on(spark, incoming, tmp_path, stop):
    """The failure comes after the batch is written but before the stream knows: it is run again."""
    out = CO.Collected(str(tmp_path / "out"))

    def fail(batch):
        if batch == stop:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        CO.collect_to_target(incoming(), out, "fingerprint", "source", 80, after_batch=fail)
    CO.collect_to_target(incoming(), out, "fingerprint", "source", 80)
    rows, _ = expected(80)
    assert sorted((r.fingerprint, r.n) for r in CO.collected_rows(spark, out).collect()) == sorted(rows)


def test_offers_of_earlier_runs_are_known(spark, incoming, tmp_path):
    old = [f"{i:04x}" + "0" * 28 for i in range(0, 90, 2)]
    seen = spark.createDataFrame([(x,) for x in old], "fingerprint string")
    out = CO.collect_to_target(incoming(), CO.Collected(str(tmp_path / "out")), "fingerprint", "source", 1000, seen=seen)
    rows, _ = expected(1000, old)
    assert sorted((r.fingerprint, r.n) for r in CO.collected_rows(spark, out).collect()) == sorted(rows)


def test_event_time_state_is_bounded(spark, tmp_path):
    """Keys leave the state once the watermark has passed them; late rows are counted."""
    rows = [(i, f"2024-01-{1 + i // 10:02d} {i % 10:02d}:00:00", i // 10) for i in range(100)] + [(3, "2024-01-01 03:00:00", 1), (4, "2024-01-01 04:00:00", 7)]
    df = spark.createDataFrame(rows, "id long, t string, turn int").select("id", F.col("t").cast("timestamp").alias("ts"), "turn")
    CO.write_in_turn(df, "turn", str(tmp_path / "in"))
    kept, late = CO.dedup_events(CO.read_files(spark, str(tmp_path / "in"), df.drop("turn").schema), ["id"], "ts", "2 days", str(tmp_path / "out"))
    assert sorted(r.id for r in kept.collect()) == list(range(100)) and late == 1


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_may_be_one_file_or_a_folder_of_files(spark, tmp_path, files):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    if files == 1:
        shutil.copy(f"{SF_SMALL}/documents.parquet", tmp_path / "documents.parquet")
    else:
        docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(3).write.parquet(str(tmp_path / "others.parquet"))  # another table beside it
    found = collect_offers(spark, str(tmp_path), "documents", offer_records, "fingerprint")
    want = {r.fingerprint for r in offer_records(docs).select("fingerprint").collect()}
    assert sorted(r.fingerprint for r in found.collect()) == sorted(want)


def test_a_turn_may_come_in_several_files(spark, tmp_path):
    """Turns of 60 rows in files of at most some 20; the last turn has one row, and empty files beside it."""
    rows = [(*r, f) for f, batch in enumerate(arrivals()) for r in batch] + [(999, "a", "f" * 32, 5)]
    df = spark.createDataFrame(rows, SCHEMA + ", turn int").repartition(4)
    files = CO.write_in_turn(df, "turn", str(tmp_path / "in"), rows=20)
    assert files == 3
    for turn in range(6):
        sizes = [spark.read.parquet(str(f)).count() for f in (tmp_path / "in" / f"turn={turn}").glob("*.parquet")]
        assert len(sizes) == 3 and max(sizes) <= 25 and sum(sizes) == (60 if turn < 5 else 1)
    out = CO.collect_to_target(CO.read_files(spark, str(tmp_path / "in"), df.drop("turn").schema, files), CO.Collected(str(tmp_path / "out")),
                               "fingerprint", "source", 75)
    assert sorted((r.fingerprint, r.n) for r in CO.collected_rows(spark, out).collect()) == sorted(expected(75)[0])
    assert spark.read.parquet(out.counters).select("batch").distinct().count() == len(expected(75)[1])


def test_what_comes_in_is_computed_once(spark, tmp_path):
    """Not once per turn, and not by one task: the rows pass the accumulator one time each."""
    passed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    df = spark.range(600, numPartitions=4).selectExpr("id", "id % 6 AS turn")
    CO.write_in_turn(df.mapInArrow(count, df.schema), "turn", str(tmp_path / "in"))
    assert passed.value == 600

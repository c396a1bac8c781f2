import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerlake.llm import archive, packing, sharding

PAGES = "page_id long, url string, html string, payload string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    texts = ["<p>ä</p>", "", None, "x\r\n\r\ny", "<p>ä</p>", "z" * 300_000, "", "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "<p>ä</p>", "\u0000nul\n"]
    rows = [(i * 3, None if i == 4 else f"http://a.b/{i}\n?q", t, "p", "d") for i, t in enumerate(texts)]
    rows += [rows[8], (None, "u", "<p>ä</p>", "p", "d"), (None, None, "only null ids", "p", "d")]
    return spark.createDataFrame(rows, PAGES)


def expected(rows, least):
    top = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= least and r.page_id is not None:
            top[body] = max(top.get(body, -1), r.page_id)
    out = []
    for r in rows:
        body = (r.html or "").encode()
        first = top.get(body)
        revisit = first is not None and first != r.page_id
        out.append((r.page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
                    "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 9])
def test_archive_columns(spark, pages, least):
    got = sorted((tuple(r) for r in archive.archive_pages(pages, min_bytes=least).collect()), key=str)
    assert got == expected(pages.collect(), least)


def test_archive_round_trip(spark, pages, tmp_path):
    records = archive.make_records(pages)
    archive.store(records, str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads"))
    assert payloads.count() == payloads.select("digest").distinct().count() == len({(r.html or "") for r in pages.collect()})
    read = archive.load(spark, str(tmp_path / "a"))
    end = b"\r\n\r\n"
    whole = lambda r: bytes(r.header) + (bytes(r.payload) if r.has_payload else b"") + end
    assert sorted(whole(r) for r in records.collect()) == sorted(bytes(r.record) for r in read.collect())
    archive.write_warc(read, str(tmp_path / "w"))
    back = archive.read_warc(spark, str(tmp_path / "w")).collect()
    pair = lambda r: (bytes(r.header), None if r.payload is None else bytes(r.payload))
    assert sorted(map(pair, back), key=str) == sorted(map(pair, read.collect()), key=str)


def test_archive_notices_a_changed_payload(spark, pages, tmp_path):
    archive.store(archive.make_records(pages), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/payloads")).withColumn("payload", F.concat("payload", F.lit(b"!")))
    bad.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="differs from its digest"):
        archive.load(spark, str(tmp_path / "b")).collect()


def test_archive_notices_a_changed_header(spark, pages, tmp_path):
    archive.store(archive.make_records(pages), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a/headers")).withColumn("header", F.regexp_replace(F.col("header").cast("string"), "1970", "1971").cast("binary"))
    bad.write.parquet(str(tmp_path / "b/headers"))
    spark.read.parquet(str(tmp_path / "a/payloads")).write.parquet(str(tmp_path / "b/payloads"))
    with pytest.raises(Exception, match="record differs from its digest"):
        archive.load(spark, str(tmp_path / "b")).collect()


def test_archive_columns_come_from_the_records(spark, pages):
    plan = archive.archive_pages(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "html" not in plan


def test_archive_of_no_pages(spark, pages):
    assert archive.archive_pages(pages.limit(0)).collect() == []


def test_shards(spark, docs):
    rows = sharding.pack_shards(docs, shards=5, cells=32).collect()
    source = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in source)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_even_and_keep_groups_together(spark):
    rng = np.random.default_rng(4)
    texts = ["w " * int(n) for n in rng.lognormal(4, 1, 1500).astype(int)] + ["copy of all " * 5] * 900
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.pack_shards(df, shards=8).collect()
    load, count = Counter(), Counter()
    for r in rows:
        load[r.shard] += r["size"]
        count[r.shard] += 1
    assert max(load.values()) < 1.01 * min(load.values()) and max(count.values()) < 1.5 * min(count.values())
    homes = defaultdict(set)
    for r in rows:
        homes[texts[r.doc_id]].add(r.shard)
    assert all(len(h) == 1 for t, h in homes.items() if not t.startswith("copy")) and len(homes["copy of all " * 5]) > 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sharding.pack_shards(df.repartition(7), shards=8).collect()))


def test_placing_follows_the_largest_dot_product():
    items = np.array([[4.0, 1, 1], [1, 4, 1], [1, 1, 4], [4, 1, 1], [1, 4, 1], [1, 1, 4]])
    placed = sharding.place(items, 2)
    loads = [items[placed == s].sum(axis=0).tolist() for s in (0, 1)]
    assert loads == [[6, 6, 6], [6, 6, 6]]


def test_shards_of_no_rows(no_docs):
    assert sharding.pack_shards(no_docs).collect() == []


def brute_padding(lengths, buckets):
    values = sorted(set(lengths))
    best = {0: 0}
    for _ in range(buckets):
        new = dict(best)
        for j in range(1, len(values) + 1):
            for i in range(j):
                if i in best:
                    cost = best[i] + sum(values[j - 1] - x for x in lengths if (values[i - 1] if i else -1) < x <= values[j - 1])
                    new[j] = min(new.get(j, cost), cost)
        best = new
    return best[len(values)]


@pytest.mark.parametrize("buckets", [1, 2, 4, 30])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    lengths = rng.lognormal(2.5, 0.8, 120).astype(int).tolist()
    values, count = np.unique(lengths, return_counts=True)
    ends, padding = packing.boundaries(count, values, values * count, buckets)
    assert padding == brute_padding(lengths, buckets) and ends[-1] == max(lengths) and len(ends) <= buckets
    assert padding == sum(min(e for e in ends if e >= x) - x for x in lengths)


def test_batches(spark, docs):
    rows = packing.pack_batches(docs, buckets=5, budget=200).collect()
    source = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((r.doc_id, len((r.text or "").split()) + 1) for r in source)
    batches = defaultdict(list)
    for r in rows:
        batches[r.batch_id].append(r)
    ends = sorted({(r.bucket, r.bucket_length) for r in rows})
    assert [e[0] for e in ends] == list(range(len(ends))) and sorted(batches) == list(range(len(batches)))
    total = 0
    for held in batches.values():
        assert len({r.bucket for r in held}) == 1
        assert sorted(r.slot for r in held) == list(range(len(held)))
        assert len(held) * held[0].bucket_length <= 200 or len(held) == 1
        total += sum(r.padding for r in held)
        assert all(0 <= r.padding == r.bucket_length - r.n_tokens for r in held)
    for bucket, length in ends:  # only the last batch of a bucket has room
        sizes = [len(h) for h in batches.values() if h[0].bucket == bucket]
        assert sum(s < max(1, 200 // length) for s in sizes) <= 1
    assert total == brute_padding([r.n_tokens for r in rows], 5)


def test_batches_of_given_lengths(spark):
    from offerlake.llm import tokens
    docs = spark.createDataFrame([(i, "文字" * (20 + i)) for i in range(12)] + [(12, None), (13, "one two")], "doc_id long, text string")
    counted = tokens.token_counts(docs)
    real = {r.doc_id: r.n_tokens for r in counted.collect()}
    rows = packing.pack_batches(counted, buckets=3, budget=200, length_col="n_tokens").collect()
    assert {r.doc_id: r.n_tokens - 1 for r in rows} == real and real[0] > 2
    held = Counter(r.batch_id for r in rows)
    assert all(held[r.batch_id] * r.bucket_length <= 200 or held[r.batch_id] == 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, -5), (3, 4)], "doc_id long, size int")
    assert {r.doc_id: r.n_tokens for r in packing.pack_batches(odd, length_col="size").collect()} == {1: 1, 2: 1, 3: 5}


def test_bins_hold_what_they_say(spark):
    df = spark.createDataFrame([(n,) for n in (1, 5, 4095, 4096, 4097, 8191, 8192, 8195, 8196, 1 << 40)], "n long")
    got = {r.n: r.b for r in df.select("n", packing.bin_of(F.col("n")).alias("b")).collect()}
    assert got == {1: 1, 5: 5, 4095: 4095, 4096: 4096, 4097: 4096, 8191: 8190, 8192: 8192, 8195: 8192, 8196: 8196, 1 << 40: 1 << 40}


def test_batches_of_no_rows(no_docs):
    assert packing.pack_batches(no_docs).collect() == []

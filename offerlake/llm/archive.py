"""Operator 5: content-addressed archive of WARC records.

An archive is a folder with two tables. ``payloads`` holds each different payload
once under its SHA-256; ``headers`` holds, per record, the exact bytes before the
payload (WARC and HTTP headers), the digest it points to and whether the payload
belongs to the record. A join on the digest gives the original records back byte for
byte; every payload is hashed again on reading and a mismatch stops the job.
``write_warc`` and ``read_warc`` exchange the records with plain ``.warc`` files.

Defined results
    A null payload counts as empty. Of records with equal payloads of at least
    ``min_bytes`` bytes the one with the largest id is the response, the others are
    revisits of it; smaller payloads are responses each. Rows that repeat the largest
    id of their payload are responses too. A null id never wins over another; where
    all ids of a payload are null, all are responses. A null url leaves out the target
    header; control characters in urls are percent-coded. An empty table gives an
    empty archive. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import scratch_path, written

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Records in one .warc file at most; a file is read whole by one task.
RECORDS_PER_FILE = 4096


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: each 5 hex digits are 4 base32 digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def make_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                 min_bytes: int = 0) -> DataFrame:
    """record_id, header (binary), digest, has_payload, payload (binary), record_digest."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "_bytes": F.octet_length("payload").cast("long"),
                             "_sha1": base32_sha1(F.col("payload"))})
    # the responses of repeated payloads, found without moving a payload; a table of its own, so that the
    # join with it can split the copies of one payload over tasks
    first = written(rows.where(F.col("_bytes") >= min_bytes).groupBy("digest").agg(
        F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(
        F.col("digest").alias("_of"), "_first"), "archive")
    rows = rows.join(first, F.col("digest") == F.col("_of"), "left").drop("_of")
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    safe = F.col("_url")
    for code in (*range(32), 127):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("_bytes").cast("string"), F.lit(END))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("_id"))), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.when(F.col("_url").isNotNull(), line("WARC-Target-URI", safe)).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("_first"))), line(
            "WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("_bytes"))).cast("string")),
        F.lit("\r\n"), http)
    made = rows.select(F.col("_id").alias("record_id"), header.cast("binary").alias("header"), "digest",
                       (~revisit).alias("has_payload"), "payload")
    return made.withColumn("record_digest", F.sha2(whole_record(F.when(F.col("has_payload"), F.col("payload"))), 256))


def whole_record(payload: Column) -> Column:
    """Bytes of a record: ``header``, the payload unless null, and the end."""
    return F.concat("header", F.coalesce(payload, F.lit(b"")), F.lit(END.encode()))


def store(records: DataFrame, path: str) -> None:
    """Write the archive: exact headers per record, each different payload once."""
    records.select("record_id", "header", "digest", "has_payload", "record_digest").write.parquet(f"{path}/headers")
    payloads = records.where("has_payload").select("digest", "payload").dropDuplicates(["digest"])
    payloads.write.option("compression", "zstd").parquet(f"{path}/payloads")


def load(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id, header, payload (null for revisits), record (whole bytes), digest."""
    headers = spark.read.parquet(f"{path}/headers")
    found = F.sha2("payload", 256)
    payloads = spark.read.parquet(f"{path}/payloads").select(
        F.col("digest").alias("_key"),
        F.when(found == F.col("digest"), F.col("payload")).otherwise(
            F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("digest")))).alias("payload"))
    own = headers.where("has_payload").join(payloads, F.col("digest") == F.col("_key"), "left").select(
        "record_id", "header", "digest", "record_digest", F.coalesce("payload", F.raise_error(F.lit("payload missing"))).alias("payload"))
    rest = headers.where(~F.col("has_payload")).select(
        "record_id", "header", "digest", "record_digest", F.lit(None).cast("binary").alias("payload"))
    both = own.unionByName(rest).withColumn("record", whole_record(F.col("payload")))
    checked = F.when(F.sha2("record", 256) == F.col("record_digest"), F.col("record")).otherwise(
        F.raise_error(F.concat(F.lit("record differs from its digest: "), F.col("record_digest"))))
    return both.withColumn("record", checked).drop("record_digest")


def header_field(header: Column, name: str) -> Column:
    """Value of a WARC header line, or null."""
    value = F.regexp_extract(header.cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(value != "", value)


def write_warc(records: DataFrame, path: str) -> None:
    """Plain .warc files of the ``record`` column, a bounded number of records to a file."""
    (records.select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", "\u0000").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """header (WARC and HTTP headers) and payload of every record in .warc files."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data, at, heads, bodies = data.as_py(), 0, [], []
                while at < len(data):
                    if data[at] in b"\x00\r\n":
                        at += 1
                        continue
                    split = data.index(b"\r\n\r\n", at) + 4
                    fields = dict(x.split(b": ", 1) for x in data[at:split].split(b"\r\n") if b": " in x)
                    end = split + int(fields[b"Content-Length"])
                    block = data.find(b"\r\n\r\n", split, end) + 4 if b"application/http" in fields.get(b"Content-Type", b"") else split
                    heads.append(data[at:max(block, split)])
                    bodies.append(None if fields.get(b"WARC-Type") == b"revisit" else data[max(block, split):end])
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())],
                                                 names=["header", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, "header binary, payload binary")


def archive_pages(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archive of ``pages``, read it back, and return per record page_id,
    payload_bytes, payload_digest, record_type, refers_to, all taken from what was read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    store(make_records(pages, min_bytes=min_bytes), path)
    read = load(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    # a record is its WARC header, the HTTP header and the block, each ended by an empty line
    parts = read.select("digest", F.split(F.col("record").cast("string"), END, 3).alias("part")).select(
        "digest", F.concat(F.col("part")[0], F.lit("\r\n")).alias("head"), F.col("part")[2].cast("binary").alias("block"))
    body = F.substring("block", 1, F.octet_length("block") - len(END))
    # what is needed of the records, so that the join with the payloads runs once
    fields = written(parts.select(
        number(header_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        header_field(F.col("head"), "WARC-Type").alias("record_type"),
        number(header_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        "digest", (F.octet_length("block") - len(END)).cast("long").alias("_bytes"), base32_sha1(body).alias("_sha1")), "archive")
    own = fields.where(F.col("record_type") == "response")
    # a revisit has the size and digest of the payload that its response keeps
    kept = written(own.select(F.col("digest").alias("_key"), F.col("_bytes").alias("_b"), F.col("_sha1").alias("_s")).dropDuplicates(
        ["_key"]), "archive")  # a table of its own, so that the join can split the revisits of one payload
    rest = fields.where(F.col("record_type") == "revisit").drop("_bytes", "_sha1").join(
        kept, F.col("digest") == F.col("_key"), "left").select(
        "page_id", F.col("_b").alias("payload_bytes"), F.col("_s").alias("payload_digest"), "record_type", "refers_to")
    return own.select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("_sha1").alias("payload_digest"),
                      "record_type", "refers_to").unionByName(rest)


def oracle(min_bytes: int = 0) -> str:
    """DuckDB SQL of the query, straight from the contract."""
    digit = lambda i: f"substr('{BASE32}', ((('0x' || substr(h, {1 + 5 * (i // 4)}, 5))::INTEGER >> {15 - 5 * (i % 4)}) & 31) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS h FROM p),
w AS (SELECT body, max(page_id) AS top FROM d WHERE payload_bytes >= {min_bytes} GROUP BY body)
SELECT d.page_id, payload_bytes, {' || '.join(digit(i) for i in range(32))} AS payload_digest,
       CASE WHEN top IS NULL OR top = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN top <> d.page_id THEN top END AS refers_to
FROM d LEFT JOIN w ON d.body = w.body"""

"""WARC archives with a chunked record table.

Writing: each page is a record. A payload of more than ``CHUNK`` characters is
streamed as rows (record, chunk number) that each carry the SHA-1 of all bytes
so far, and every chunk becomes one segment of the record (WARC segmentation:
a response and its continuations), so no task holds more than a chunk besides
the cell it came from. Records are written by Spark's text writer: a
lost executor's files are written again, and any file system Spark knows will do.

Reading: Spark's text reader splits archives at the version line that starts
every record. A payload holding that line is cut inside it when written, so a
split never falls into a payload. Each segment's length is checked; the segments
of a record are brought together by record, sorted within the partition, and
their digest is carried from row to row and compared with the recorded one.

Of records with equal payloads of at least ``min_revisit`` bytes, that with the
smallest page_id is a response, the others are revisits of it without payload.
Rows with the same page_id and payload share a role. A null page_id is larger
than any other; a null html is the empty payload, a null url the empty string.
Common payloads are looked up with a salted join, as a third of all pages may
be the same.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmotif.session import scratch, ship

CHUNK = 262_144
SALTS = 32
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
CHUNKS = "record_id long, page_id long, url string, kind string, refers_to long, bytes long, digest string, chunk int, last boolean, so_far string, data string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def cuts(text: str, chunk: int) -> Iterator[str]:
    """The text in runs of ``chunk`` characters at most, none of which holds the version line; at least one run."""
    start = 0
    while True:
        end = min(start + chunk, len(text))
        mark = text.find(VERSION, start, end)
        if mark >= 0:
            end = mark + 4
        yield text[start:end]
        start = end
        if start >= len(text):
            return


def chunk_rows(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of rows (page_id, url, html, first): payloads of responses, none for revisits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in CHUNKS.split(", "))])
        for batch in batches:
            rows, size = [], 0
            columns = [batch.column(c) for c in ("record_id", "page_id", "url", "first", "html")]
            for k in range(batch.num_rows):
                record_id, page_id, url, first, html = (c[k].as_py() for c in columns)
                html = html or ""
                revisit = first is not None and first != page_id
                n, total = 0, hashlib.sha1()
                for part in cuts(html, 1 << 20):
                    data = part.encode()
                    n += len(data)
                    total.update(data)
                head = (record_id, page_id, url or "", "revisit" if revisit else "response", first if revisit else None, n, base32(total.digest()))
                done, so_far = 0, hashlib.sha1()
                for number, part in enumerate([""] if revisit else cuts(html, chunk)):
                    so_far.update(part.encode())
                    done += len(part)
                    rows.append((*head, number, revisit or done == len(html), base32(so_far.digest()), part))
                    size += len(part)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows, size = [], 0
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return pages.mapInArrow(run, CHUNKS)


def render(chunks: DataFrame) -> DataFrame:
    """One string per WARC record, without the final blank lines: a response, a revisit or a continuation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data, many = r["data"], not (r["last"] and r["chunk"] == 0)
                lines = [
                    f"WARC-Type: {r['kind'] if r['chunk'] == 0 else 'continuation'}",
                    f"WARC-Record-ID: <urn:record:{r['record_id']}:{r['chunk']}>",
                    f"WARC-Target-URI: {quote(r['url'], safe='!#$%&()*+,/:;=?@[]~')}",
                    "Content-Type: text/html; charset=utf-8",
                    f"Content-Length: {len(data.encode())}",
                    f"WARC-Payload-Digest: sha1:{r['digest']}",
                    f"X-Payload-Length: {r['bytes']}",
                    f"X-Running-Digest: sha1:{r['so_far']}",
                ]
                if r["page_id"] is not None:
                    lines.append(f"X-Page-ID: {r['page_id']}")
                if r["refers_to"] is not None:
                    lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{r['refers_to']}>"]
                if many:
                    lines += [f"WARC-Segment-Number: {r['chunk'] + 1}", f"WARC-Segment-Origin-ID: <urn:record:{r['record_id']}:0>"]
                    if r["last"]:
                        lines.append(f"WARC-Segment-Total-Length: {r['bytes']}")
                out.append(VERSION + "\r\n".join(lines) + END + data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return chunks.mapInArrow(run, "value string")


def write(pages: DataFrame, path: str, min_revisit: int = 0, chunk: int = CHUNK) -> None:
    """Write a record per row of ``pages`` (page_id, url, html) as gzipped archives below ``path``."""
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("_sha1", F.sha1(F.col("html").cast("binary")))
    same = rows.where(F.octet_length("html") >= min_revisit).groupBy("_sha1").agg(F.count("*").alias("_n"), F.min("page_id").alias("first"))
    same = same.where("_n > 1").select("_sha1", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    found = salted.join(same, ["_sha1", "_salt"], "left").select(F.monotonically_increasing_id().alias("record_id"), "page_id", "url", "html", "first")
    render(chunk_rows(found, chunk)).write.option("lineSep", END).option("compression", "gzip").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record in the archives, checked."""
    ship(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("value").to_pylist():
                if not value:
                    continue
                head, _, data = value.partition(END)
                fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
                data = data[: -len(END)] if data.endswith(END) else data
                if len(data.encode()) != int(fields["Content-Length"]):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                record, number = fields["WARC-Record-ID"].strip("<>").split(":")[2:]
                refers = fields.get("WARC-Refers-To")
                segmented = "WARC-Segment-Number" in fields
                so_far = fields["X-Running-Digest"][5:]
                if not segmented and base32(hashlib.sha1(data.encode()).digest()) != so_far:
                    raise ValueError(f"digest of record {record} differs")
                page = fields.get("X-Page-ID")
                out.append((int(record), int(number), None if page is None else int(page), fields["WARC-Type"], int(refers.strip("<>").split(":")[2]) if refers else None, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"][5:], so_far, "WARC-Segment-Total-Length" in fields, data if segmented else None))
            columns = list(zip(*out)) or [[]] * 10
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["record", "number", "page_id", "kind", "refers_to", "bytes", "digest", "so_far", "last", "data"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, expected, head = hashlib.sha1(), 0, 0, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["data"] is None:
                    if r["kind"] == "response" and r["so_far"] != r["digest"]:
                        raise ValueError(f"digest of record {r['record']} differs")
                    out.append((r["page_id"], r["bytes"], r["digest"], r["kind"], r["refers_to"]))
                    continue
                if r["number"] == 0:
                    total, n, expected, head = hashlib.sha1(), 0, 0, r
                data = r["data"].encode()
                total.update(data)
                n += len(data)
                if r["number"] != expected or base32(total.digest()) != r["so_far"]:
                    raise ValueError(f"segment {r['number']} of record {r['record']} is missing or damaged")
                expected += 1
                if r["last"]:
                    if base32(total.digest()) != r["digest"] or n != r["bytes"]:
                        raise ValueError(f"digest of record {r['record']} differs")
                    out.append((head["page_id"], n, base32(total.digest()), head["kind"], head["refers_to"]))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    records = spark.read.schema("value string").option("lineSep", VERSION).text(path)
    parsed = records.mapInArrow(parse, "record long, number int, page_id long, kind string, refers_to long, bytes long, digest string, so_far string, last boolean, data string")
    return parsed.repartition("record").sortWithinPartitions("record", "number").mapInArrow(finish, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """One row per page, read back from archives in the shared folder."""
    path = scratch(spark)
    write(pages, path)
    return read(spark, path)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM p JOIN f USING (h)
"""

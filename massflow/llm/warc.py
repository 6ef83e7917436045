"""WARC archives of a pages table, with repeated payloads as revisit records.

Headers only (id, digest, length) are shuffled by payload digest; the greatest
id of each digest is the response and the others become revisits of it.  The
archives are written through Spark's text writer: a WARC record ends with two
line ends, which is the writer's line separator, so a part file *is* a valid
sequence of records, on any file system Spark can write to and under its commit
protocol.  They are read back whole, file by file, by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massflow.llm.frames import cut, work_path

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ID = "urn:massflow:page:"
#: Payload bytes that one archive file is planned for, and that it holds at most if all its payloads are the longest.
FILE_BYTES, MOST_BYTES = 32 << 20, 1 << 30


def b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, hex, refers_to) of the pages whose payload a later id repeats."""
    heads = pages.select(F.col("page_id").cast("long").alias("page_id"), _hex().alias("hex"), _size().alias("n")).where(F.col("page_id").isNotNull() & (F.col("n") >= min_bytes))
    last = cut(heads.groupBy("hex").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least")).where("least < refers_to").drop("least"))
    return heads.join(last, "hex").where("page_id < refers_to").select("page_id", "hex", "refers_to").distinct()


def _hex():
    return F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))


def _size():
    return F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")


def _record(page_id, url, html, digest, refers_to, date) -> str:
    body = html or ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body.encode())}\r\n\r\n"
    block = http if refers_to is not None else http + body
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <{ID}{page_id}:{digest[:12]}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{b32(digest)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}:{digest[:12]}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(head) + "\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Write a record for every row of pages under path, dated ``date`` or the time of this call.

    A null html is an empty payload, a null url leaves out the target.  A row
    with a null page_id is a response that nothing refers to.  Rows that repeat
    the greatest id of a payload are responses all.  A record id is the page_id
    with the beginning of its payload's digest, so pages that share an id differ
    in it unless they share the payload, too.  Columns other than page_id, url
    and html are not archived.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = revisits(pages, min_bytes)
    size, longest = pages.agg(F.avg(_size()), F.max(_size())).first()
    per_file = min(20_000, int(FILE_BYTES / max(size or 1, 400)), MOST_BYTES // max(longest or 1, 400))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _hex().alias("hex")).join(again, ["page_id", "hex"], "left").select("page_id", "url", "html", "hex", "refers_to")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_record(*x, date) for x in zip(*(c.to_pylist() for c in b.columns))], pa.string())], ["value"])

    out = rows.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, per_file))
    out.mode("overwrite").text(path)


def parse(content: bytes):
    """(headers, block) of each record of an archive file, gzipped or plain."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        stop = content.index(b"\r\n\r\n", at)
        first, *lines = content[at:stop].split(b"\r\n")
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        head = {k.decode(): v.strip().decode() for k, v in (line.split(b":", 1) for line in lines)}
        end = stop + 4 + int(head["Content-Length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end at {end}")
        yield head, content[stop + 4 : end]
        at = end + 4


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def number(ref):
        tail = ref.strip("<>").removeprefix(ID).partition(":")[0] if ref else "None"
        return None if tail == "None" else int(tail)

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for head, block in parse(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    rows.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], number(head.get("WARC-Refers-To")), payload))
                cols = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + with_payload]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and return their records' digest.

    One row per row of pages: repeated rows are a record each, and of rows that
    tie as the greatest id of a payload all are responses.  An empty table gives
    an empty result.  Other columns are not archived, whatever their names.
    """
    path = work_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM m
"""

"""WARC archives: writing pages as segmented records, and segment reassembly.

A page becomes a response record (HTTP head and payload in chunked transfer framing), or a revisit of the page with the same
payload and the smallest id. Blocks above ``SEGMENT`` bytes are cut into a first segment and continuation records. Archives
are written by Spark's writer, gzip-compressed, with a bounded number of bounded records to a file, so a file fits a task.

Reading parses every file, decodes whole records at once, and brings only segments together: grouped by origin identifier,
ordered by segment number, checked against the total length, joined, and freed of their chunked framing.

Defined results: null html is an empty payload; a null url is written as an empty target; of payloads of ``least`` bytes or
more that occur more than once, the rows with the smallest page_id are responses; rows without id are responses where no row
with an id has their payload, and else revisits. Repeated rows stay repeated. Segments that are missing, doubled unequally or
of another total length give a capture that is not complete, with null payload.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, new_path

#: Bytes of a block in one record, of a chunk in the framing, and records in a file.
SEGMENT, CHUNK, RECORDS = 32_768, 8192, 1000
DATE = "2020-01-01T00:00:00Z"
CRLF = b"\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD = "record_id string, kind string, page_id long, refers_to long, digest string, payload_length long, origin_id string, segment long, total long, block binary"
CAPTURE = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, complete boolean, payload binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%X\r\n%b\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of chunked framing, with extensions and trailers left out; None if the framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != CRLF:
            return None
        parts.append(body[at : at + size])
        at += size + 2


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _id(page_id: int | None, sha: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{sha}')}>"


def _clean(value: str | None) -> str:
    """Header values hold no line ends."""
    return (value or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _record(block: bytes, **fields: object) -> bytes:
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block


def page_records(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, each without the two line ends that follow it."""
    sha = digest(payload)
    name = _id(page_id, sha)
    common = {"WARC-Date": DATE, "WARC-Target-URI": _clean(url), "WARC-Payload-Digest": f"sha1:{sha}", "X-Page-ID": page_id}
    if revisit:
        head = HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record(head, **{"WARC-Type": "revisit", "WARC-Record-ID": name, **common, "WARC-Profile": profile, "WARC-Refers-To": _id(first, sha), "X-Refers-To-Page": first, "Content-Type": "application/http;msgtype=response"})
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    several = len(block) > segment
    yield _record(block[:segment], **{"WARC-Type": "response", "WARC-Record-ID": name, **common, "WARC-Segment-Number": 1 if several else None, "Content-Type": "application/http;msgtype=response"})
    starts = range(segment, len(block), segment)
    for number, at in enumerate(starts, 2):
        total = len(block) if number == len(starts) + 1 else None
        yield _record(block[at : at + segment], **{"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}/{number}')}>", "WARC-Date": DATE, "WARC-Segment-Origin-ID": name, "WARC-Segment-Number": number, "WARC-Segment-Total-Length": total})


def write_archives(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, records: int = RECORDS) -> None:
    """Write a record for every page to WARC files in a folder."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    # The smallest id by payload is aggregated before the shuffle; the join meets one row for each payload, so a payload that
    # a third of the pages share is only skewed on the side that Spark can split.
    first = rows.where(F.length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"))
    rows = rows.join(first, "sha", "left").select("page_id", "url", "payload", "first")

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                some = batch.slice(i, 200).to_pylist()
                out = [x for r in some for x in page_records(r["page_id"], r["url"], r["payload"], r["first"], r["first"] is not None and r["first"] != r["page_id"], segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    text = rows.mapInArrow(records_of, "value binary").select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record."""
    at = 0
    while at < len(data):
        end = data.find(CRLF + CRLF, at)
        if end < 0:
            raise ValueError("a WARC header has no end")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("a WARC block is cut short")
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size
        while data[at : at + 2] == CRLF:
            at += 2


def inflated(data: bytes) -> bytes:
    """Plain bytes of one gzip member or several in a row."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder."""

    def number(fields: dict[str, str], name: str) -> int | None:
        return int(fields[name]) if fields.get(name) else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in RECORD.split(", ")])
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for f, block in parse(inflated(content.as_py())):
                    sha = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    length = None
                    if f.get("warc-type") == "revisit":
                        head = dict(line.lower().split(b":", 1) for line in block.split(CRLF) if b":" in line)
                        length = int(head[b"content-length"]) if b"content-length" in head else None
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), number(f, "x-page-id"), number(f, "x-refers-to-page"), sha, length, f.get("warc-segment-origin-id"), number(f, "warc-segment-number"), number(f, "warc-segment-total-length"), block))
                    if len(rows) == 200:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                        rows = []
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parsed, RECORD)


def _capture(page_id: int | None, block: bytes | None, sha: str | None) -> tuple:
    """A response from its whole block: the payload counts only if it has the digest that the record states."""
    payload = None
    if block is not None:
        head, _, body = block.partition(CRLF + CRLF)
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        if payload is not None and sha and digest(payload) != sha:
            payload = None
    return page_id, "response", None, sha if payload is None else digest(payload), None if payload is None else len(payload), payload is not None, payload


def _captures(rows: list[tuple]) -> pa.Table:
    types = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in CAPTURE.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], types[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def join_segments(segments: list[dict]) -> list[tuple]:
    """The captures (one for each copy of the first segment) of the segments of one origin."""
    firsts = [s for s in segments if s["kind"] == "response"]
    by_number: dict[int, set[bytes]] = {}
    for s in segments:
        by_number.setdefault(s["segment"], set()).add(s["block"])
    totals = {s["total"] for s in segments if s["total"] is not None}
    whole = None
    if sorted(by_number) == list(range(1, len(by_number) + 1)) and all(len(x) == 1 for x in by_number.values()) and len(totals) == 1:
        block = b"".join(next(iter(by_number[n])) for n in sorted(by_number))
        whole = block if len(block) == totals.pop() else None
    return [_capture(f["page_id"], whole, f["digest"]) for f in firsts] or [(None, "continuation", None, None, None, False, None)]


def reassemble(records: DataFrame) -> DataFrame:
    """One capture for each response or revisit; segments are brought together by the record they continue."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(i, 200).to_pylist():
                    out.append(_capture(r["page_id"], r["block"], r["digest"]) if r["kind"] == "response" else (r["page_id"], "revisit", r["refers_to"], r["digest"], r["payload_length"], True, None))
                yield from _captures(out).to_batches()

    segmented = F.col("segment").isNotNull()
    parts = records.where(segmented).withColumn("origin", F.coalesce("origin_id", "record_id"))
    joined = parts.groupBy("origin").applyInArrow(lambda t: _captures(join_segments(t.to_pylist())), CAPTURE)
    return records.where(~segmented & F.col("kind").isin("response", "revisit")).mapInArrow(whole, CAPTURE).unionByName(joined)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(load(spark, sf_dir, "pages"), path)
    captures = reassemble(read_records(spark, path))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, CAST(1 + 5 * g AS INTEGER), 5) AS INTEGER) >> CAST(k AS INTEGER)) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to
FROM s""",
}
QUERIES = {"op9_warc": op9_warc}

"""WARC archives with an index written first and coalesced range reads after.

Each page becomes one record, a gzip member of its own. Of pages with equal
payloads the one with the largest id is a response; the others are revisits that
name it and hold no payload. Pages with fewer than ``least_bytes`` are always
responses. The index has one row per record (file, offset, length, url, digest);
readers select index rows, sort them by place and fetch near ones in one read.

Results: a null payload is the empty payload; null ids are smaller than all
others; rows that share the largest id of their payload are each a response;
null urls are left out of the record; an empty table gives an empty index. Other
columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm.blobs import BlobWriter, RangeReader, coalesced, read_tasks
from provenir.llm.words import bounded_batches, slices
from provenir.session import cut, scratch_path

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, record_type string, file string, offset long, length long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {_line(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if refers_to is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the archives into the shared scratch folder; returns their index, itself written."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("key", F.sha2("payload", 256))
    shared = rows.filter(F.length("payload") >= least_bytes).groupBy("key").agg(
        F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    owners = cut(shared.filter("copies > 1").select("key", "owner"), "warc-owners")
    marked = rows.join(owners.withColumn("shared", F.lit(True)), "key", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("shared") & ~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner").cast("string")).alias("refers_to"))
    folder = scratch_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, schema = BlobWriter(folder, ".warc.gz"), None
        for batch in slices(batches, "payload"):
            out = []
            for r in batch.to_pylist():
                digest = _digest(r["payload"])
                data = _record(r["page_id"], r["url"], r["payload"], digest, r["refers_to"], date)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                file, offset, length = writer.put(pack.compress(data) + pack.flush())
                out.append((r["page_id"], r["url"], digest, "response" if r["refers_to"] is None else "revisit", file, offset, length))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [c.split()[0] for c in INDEX.split(", ")]
            schema = schema or pa.schema(list(zip(names, kinds, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], schema=schema)
        writer.close()

    bounded_batches(spark)
    return cut(marked.mapInArrow(run, INDEX), "warc-index")


def parse_record(data: bytes) -> dict:
    """One uncompressed record as the columns of ``RECORDS``; a response's digest is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    own = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    to = fields.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
    if fields["WARC-Type"] == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"record of page {own} is damaged")
    return {"page_id": int(own) if own else None, "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": int(to) if to else None,
            "payload": payload if fields["WARC-Type"] == "response" else None}


def read_records(selected: DataFrame, columns: tuple[str, ...] = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")) -> DataFrame:
    """The records of the selected index rows, each read from its archive.

    Rows are dealt out by place, so that a task reads forward through few files.
    """
    kinds = dict(c.split() for c in RECORDS.split(", "))
    schema = pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kinds[c]]) for c in columns])
    tasks = read_tasks(selected.agg(F.sum("length")).first()[0])
    placed = selected.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            ranges = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            done = 0
            for file, start, end, count in coalesced(ranges):
                data, out = reader.get(file, start, end - start, 0), []
                for _, offset, length in ranges[done : done + count]:
                    out.append(parse_record(zlib.decompress(data[offset - start : offset - start + length], 31)))
                done += count
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in out], schema=schema)
        reader.close()

    return placed.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns))

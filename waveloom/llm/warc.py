"""WARC archives: written with an index, read back by coalesced byte ranges.

Each task writes its own archive, one gzip member a record, and returns an index row (file, offset, length, url, digest,
page_id) for each record; Spark commits the index atomically and only it names the archives that count, so a task that
runs twice leaves at most an unreferenced file. Reading starts from the index: the records that are wanted are sorted by
place, neighbouring ranges are fetched by one read, and every payload's digest is verified.

Of records with equal payloads the one with the largest page_id is the response and holds the payload; the others are
revisits that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "file string, offset long, length long, url string, digest string, page_id long"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:waveloom:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    digits = (record or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def header_value(text: str) -> str:
    """A URL as one header line holds it: control characters and spaces are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and block of one record; raises if its length disagrees."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(headers["Content-Length"])
    if lines[0] != VERSION or len(rest) != size + 4:
        raise ValueError("a record is damaged")
    return headers, rest[:size]


def page_record(page_id: int | None, url: str | None, payload: bytes, head_id: int | None, head_url: str | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = {"WARC-Record-ID": record_id(page_id), "WARC-Date": date, "WARC-Target-URI": header_value(url or ""), "WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "Content-Type": "application/http; msgtype=response"}
    if not revisit:
        return record("response", headers, http + payload)
    # The payload is elsewhere; its length is kept in a header of our own.
    headers |= {"WARC-Refers-To": record_id(head_id), "WARC-Refers-To-Target-URI": header_value(head_url or ""), "WARC-Profile": REVISIT_PROFILE, "X-Payload-Length": str(len(payload))}
    return record("revisit", headers, http)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", roll_bytes: int = 256 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives in ``folder``; returns the index.

    Null html is an empty payload, a null url an empty one. Equal payloads of fewer than ``min_revisit_bytes`` are all
    responses. Rows that repeat a page_id are written each; those with the largest page_id are all responses. Rows
    without page_id are revisits if an equal payload has one, else responses. Other columns are ignored.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("key", F.sha2("payload", 256))
    # One head for each payload, whatever the number of its copies. Written, so that the join shuffles both sides and can
    # split a partition that the html of a very common payload fills.
    heads = common.staged(keyed.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("head")), "payload-heads")
    joined = keyed.join(heads, "key").select("page_id", "url", "payload", F.col("head.page_id").alias("head_id"), F.col("head.url").alias("head_url"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.opened(folder)
        part, sink, name, at = TaskContext.get().partitionId(), None, "", 0
        for batch in common.text_slices(batches, "payload"):
            rows, chunks = [], []
            for page_id, url, payload, head_id, head_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None or at >= roll_bytes:
                    if sink is not None:
                        sink.write(b"".join(chunks))
                        chunks.clear()
                        sink.close()
                    fs.create_dir(root, recursive=True)
                    name = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    sink = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = gzip.compress(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"software: waveloom\r\nformat: WARC File Format 1.1\r\n"), 3, mtime=0)
                    chunks.append(info)
                    at = len(info)
                revisit = head_id is not None and page_id != head_id and len(payload) >= min_revisit_bytes
                data = gzip.compress(page_record(page_id, url, payload, head_id, head_url, revisit, date), 3, mtime=0)
                chunks.append(data)
                rows.append((name, at, len(data), url, payload_digest(payload), page_id))
                at += len(data)
            sink.write(b"".join(chunks))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["file", "offset", "length", "url", "digest", "page_id"])
        if sink is not None:
            sink.close()

    return common.staged(joined.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def ranges(offsets: list[int], lengths: list[int], gap: int, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of sorted records that one read fetches: at most ``gap`` bytes apart, ``most`` bytes in all or one record."""
    i = 0
    while i < len(offsets):
        j = i + 1
        while j < len(offsets) and offsets[j] - (offsets[j - 1] + lengths[j - 1]) <= gap and offsets[j] + lengths[j] - offsets[i] <= most:
            j += 1
        yield i, j
        i = j


def read_records(selected: DataFrame, folder: str, with_payload: bool = True, gap: int = 64 << 10, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Read the records that ``selected``, rows of an index, names: each as often as it is named, none for an empty table.
    A revisit has no payload here, but its length and digest; a null page_id comes back as null. Other columns are ignored.
    Archives are dealt to tasks by their bytes, not by the few bytes that the index has of them."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = common.opened(folder)
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            lo = 0
            while lo < len(files):
                hi = lo
                while hi < len(files) and files[hi] == files[lo]:
                    hi += 1
                with fs.open_input_file(f"{root}/{files[lo]}") as source:
                    for i, j in ranges(offsets[lo:hi], lengths[lo:hi], gap, chunk_bytes):
                        i, j = i + lo, j + lo
                        data = source.read_at(offsets[j - 1] + lengths[j - 1] - offsets[i], offsets[i])
                        rows = []
                        for k in range(i, j):
                            at = offsets[k] - offsets[i]
                            headers, block = parse(zlib.decompress(data[at : at + lengths[k]], 31))
                            kind, digest, refers, payload = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:"), None, None
                            if kind == "response":
                                payload = block.partition(b"\r\n\r\n")[2]
                                size = len(payload)
                                if payload_digest(payload) != digest:
                                    raise ValueError("a payload is damaged")
                            else:
                                refers, size = page_of(headers["WARC-Refers-To"]), int(headers["X-Payload-Length"])
                            rows.append((page_of(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind, refers, payload if with_payload else None))
                        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
                lo = hi

    size = selected.agg(F.sum("length")).first()[0] or 0
    tasks = common.tasks_for(selected.sparkSession, size, 4 * chunk_bytes)
    placed = selected.select("file", "offset", "length", F.expr(f"offset div {chunk_bytes}").alias("chunk")).repartition(tasks, "file", "chunk").sortWithinPartitions("file", "offset")
    return placed.select("file", "offset", "length").mapInArrow(read, RECORD_SCHEMA)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page into archives, and every record back."""
    folder = common.new_folder(spark, "warc")
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
     h AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS head FROM p),
     d AS (SELECT *, list_transform(range(0, 8), lambda g: ('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5))::BIGINT) AS words FROM h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((words[(i // 4) + 1] >> (15 - 5 * (i % 4))::INT) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM d
"""

"""WARC archives: writing with duplicate payloads as revisits, and a splittable reader.

Records are gzip members, so an archive can be cut anywhere: a reading task scans its byte range for the gzip magic, takes a place
for a member's start only if decoding there yields a WARC header, and owns the records that start inside its range, reading past
the end of the range as far as the last one needs. Files are reached through pyarrow's file systems, by the URI of the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a range: from 1 MB for small archives to 128 MB, aiming at a few ranges per core.
LEAST_RANGE, MOST_RANGE = 1 << 20, 128 << 20
#: Bytes read at once.
CHUNK = 1 << 20
LEVEL = 4
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADER_END = re.compile(rb"\r?\n\r?\n")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:docloom:page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    n = (record or "").strip("<>").rpartition(":")[2]
    return int(n) if re.fullmatch(r"-?\d+", n) else None


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One gzip member: a response with its payload, or a revisit without one that keeps length and digest of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {datetime(2024, 1, 1, tzinfo=timezone.utc):%Y-%m-%dT%H:%M:%SZ}", *([f"WARC-Target-URI: {uri}"] if uri is not None else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict | None:
    """Headers and block of one decoded record; None if it is no complete WARC record."""
    end = HEADER_END.search(raw)
    if not raw.startswith(b"WARC/") or not end:
        return None
    headers = {}
    for line in raw[: end.start()].decode("utf-8", "replace").splitlines()[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not size.isdigit() or len(raw) < end.end() + int(size):
        return None
    return {"headers": headers, "block": raw[end.end() : end.end() + int(size)]}


def read_range(file, size: int, start: int, end: int) -> Iterator[dict]:
    """Records of the members that start in [start, end), in order."""
    buffer, base = b"", start  # buffer holds the file from base on

    def need(upto: int) -> None:
        nonlocal buffer
        while base + len(buffer) < min(upto, size):
            file.seek(base + len(buffer))
            got = file.read(max(CHUNK, min(upto, size) - base - len(buffer)))
            if not got:
                return
            buffer += got

    at = start
    while at < min(end, size):
        need(at + CHUNK)
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = max(at + 1, base + len(buffer) - 2)
            buffer, base = buffer[at - base :], at
            if base + len(buffer) >= size:
                return
            continue
        at = base + found
        if at >= end:
            return
        record, used = _member_at(at, need, lambda a, b: buffer[a - base : b - base], size)
        if record is None:
            at += 1
            continue
        yield record
        at += used
        buffer, base = buffer[at - base :], at


def _member_at(at: int, need, view, size: int):
    """(record, bytes used) of the member at a place; (None, 0) if there is none whose header and length hold."""
    unpack = zlib.decompressobj(31)
    out: list[bytes] = []
    pos, step = at, 1 << 12
    try:
        while not unpack.eof and pos < size:
            need(pos + step)
            part = view(pos, pos + step)
            if not part:
                return None, 0
            out.append(unpack.decompress(part))
            pos += len(part)
            if pos - at <= 1 << 12 and not b"".join(out).startswith(b"WARC/") and sum(map(len, out)) >= 5:
                return None, 0
            step = min(step * 4, CHUNK)
    except zlib.error:
        return None, 0
    if not unpack.eof:
        return None, 0
    record = parse(b"".join(out))
    return (record, pos - len(unpack.unused_data) - at) if record else (None, 0)


def _located(uri: str):
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def first_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(sha, first): for each payload of at least so many bytes that occurs more than once, its SHA-1 and the smallest page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    digests = pages.where(F.octet_length(payload) >= least_bytes).select(F.sha1(payload.cast("binary")).alias("sha"), "page_id")
    return digests.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")


def write(pages: DataFrame, uri: str, least_bytes: int = 0) -> list[tuple[str, int, int]]:
    """Write a record per row of pages (page_id, url, html) below uri; (file, bytes, records) of each archive.

    Each task writes a file of its own name and only files of tasks that succeeded are returned, so lost or repeated tasks do no
    harm. Null html is an empty payload. Of equal payloads the smallest page_id is the response (repeated rows of that page_id all
    are); a null page_id revisits the others, or is a response where no other row has the payload.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
            F.coalesce(F.col("html"), F.lit("")).alias("html"))
    copies = first_copies(rows, least_bytes).hint("shuffle_hash")
    joined = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(copies, "sha", "left")
    _located(uri)[0].create_dir(_located(uri)[1], recursive=True)

    def store(batches):
        system, folder = _located(uri)
        path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
        size = records = 0
        out = None
        for b in batches:
            for page_id, url, page, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                if out is None:
                    out = system.open_output_stream(path, compression=None)
                data = member(page_id, url, page.encode("utf-8", "surrogatepass"), first, first is not None and page_id != first)
                out.write(data)
                size += len(data)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([size]), pa.array([records])], ["file", "bytes", "records"])

    done = joined.select("page_id", "url", "html", "first").mapInArrow(store, "file string, bytes long, records long").collect()  # a row per task
    return sorted((f"{uri.rstrip('/')}/{r[0]}", r[1], r[2]) for r in done)


def read(spark: SparkSession, files: list[tuple], range_bytes: int | None = None) -> DataFrame:
    """All records of the archives: file, record_id, record_type, uri, payload_digest, refers_to, http_length, block (binary).

    files: (file, bytes, ...). Each range of range_bytes is a task of its own; nothing but sizes is known beforehand. A member that
    does not decode is passed over: compare the number of records with that written, as `round_trip` does.
    """
    total = sum(n for _, n, *_ in files)
    cores = max(1, spark.sparkContext.defaultParallelism)
    step = range_bytes or max(LEAST_RANGE, min(MOST_RANGE, total // (4 * cores)))
    ranges = [(f, n, a, min(a + step, n)) for f, n, *_ in files for a in range(0, n, step)]
    schema = "file string, size long, start long, stop long"
    table = spark.createDataFrame(ranges or [], schema).repartition(max(1, min(len(ranges), 4096)), "file", "start")

    def run(batches):
        for b in batches:
            for path, size, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                system, inner = _located(path)
                with system.open_input_file(inner) as file:
                    held, weight = [], 0
                    for record in read_range(file, size, start, stop):
                        held.append((path, record))
                        weight += len(record["block"])
                        if len(held) >= 500 or weight > 16 << 20:
                            yield _records(held)
                            held, weight = [], 0
                    yield _records(held)

    return table.mapInArrow(run, RECORDS)


RECORDS = "file string, record_id string, record_type string, uri string, payload_digest string, refers_to string, http_length long, block binary"


def _records(held: list[tuple[str, dict]]) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(8)]
    for path, r in held:
        h = r["headers"]
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", r["block"][: max(0, r["block"].find(b"\r\n\r\n"))])
        row = (path, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-payload-digest"), h.get("warc-refers-to"),
                int(length[1]) if length else None, r["block"])
        for column, v in zip(out, row):
            column.append(v)
    types = [pa.string()] * 6 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [x.split(" ")[0] for x in RECORDS.split(", ")])


def digest(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record; a response's are taken from its payload."""

    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for rid, kind, told, refers, length, block in zip(*(c.to_pylist() for c in b.columns)):
                payload = block.partition(b"\r\n\r\n")[2]
                sha = base32_sha1(payload) if kind == "response" else (told or "").rpartition(":")[2]
                if kind == "response" and told and told != f"sha1:{sha}":
                    raise ValueError(f"{rid}: the payload does not match its digest")
                row = (page_of(rid), len(payload) if kind == "response" else length, sha, kind, page_of(refers) if refers else None)
                for column, v in zip(out, row):
                    column.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    columns = records.select("record_id", "record_type", "payload_digest", "refers_to", "http_length", "block")
    return columns.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder, read them back and digest them: a row per page.

    The digests are stored and counted: an error is raised if a record that was written was not read.
    """
    spark = pages.sparkSession
    uri = common.new_path(spark, "warc")
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    files = write(pages, uri)
    return complete(common.store(digest(read(spark, files)), "digests"), files)


def complete(records: DataFrame, files: list[tuple[str, int, int]]) -> DataFrame:
    """The records read from archives, if they are as many as were written into them."""
    found, written = records.count(), sum(n for *_, n in files)
    if found != written:
        raise ValueError(f"{written} records were written and {found} read")
    return records

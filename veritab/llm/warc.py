"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Files hold one gzip member per record (WARC/1.1). Of records with equal payloads of at least
revisit_from bytes, the one with the smallest page_id is the response and the others revisit it,
with the payload's digest and length but no payload. Which page is first is found by an aggregate
over (digest, page_id) alone; no task sees all pages of a digest, and the payloads are dealt once,
when the pages that revisit are marked.

The reader checks every record: the member's own checks, the version line, Content-Length and the
block and payload digests. Where a check fails, it searches from the next byte for a gzip member
or, in uncompressed files, a version line that starts a record passing all checks, goes on there,
and logs the byte gap as quarantined. Good records behind the damage are not lost. A member may hold
several records; what fails between them is quarantined as the whole member's bytes.

Defined results: null html is an empty payload; null page_ids are written as such and are never
the smallest unless alone; rows that share the smallest page_id of a digest are all responses, each
with a record id of its own;
an empty table writes no file; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files
from ._common import checkpoint, partitions, scratch, table

FILE_BYTES = 8 << 20
LEVEL = 4
#: The time stamped on records: fixed, so that a task that runs again writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
MEMBER = re.compile(rb"\x1f\x8b\x08")
VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_HEAD_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _HEAD_END + block + _HEAD_END


def record_id(name: str, sha1: str, turn: int = 0) -> str:
    """The id of a page's record; turn: the rows before it with the same page_id and payload."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{name}:{sha1}' + f':{turn}' * (turn > 0))}>"


def page_record(page_id: int | None, url: str | None, html: str | None, sha1: str, first: int | None, is_first: bool, turn: int = 0) -> bytes:
    """The record of a page; sha1: its payload's digest in base32."""
    payload = (html or "").encode()
    name = "null" if page_id is None else str(page_id)
    target = re.sub(r"[\x00-\x20\x7f]+", "%20", url or f"page:{name}")
    headers = {"WARC-Record-ID": record_id(name, sha1, turn), "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{sha1}", "X-Page-ID": name, "X-Payload-Length": str(len(payload))}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if is_first:
        block = http + f"Content-Length: {len(payload)}".encode() + _HEAD_END + payload
        return record("response", headers | {"WARC-Block-Digest": f"sha1:{digest(block)}"}, block)
    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(str(first), sha1), "X-Refers-To-Page": str(first)}
    block = http + b"\r\n"
    return record("revisit", headers | {"WARC-Block-Digest": f"sha1:{digest(block)}"}, block)


def member(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


def _parsed(data: bytes, at: int = 0) -> tuple[dict, int] | None:
    """The record at a place and the place behind it; None if a check fails."""
    if not VERSION.match(data, at) or (head := data.find(_HEAD_END, at)) < 0:
        return None
    lines = data[at:head].decode("utf-8", "replace").split("\r\n")
    headers = {k.lower(): v.strip() for k, sep, v in (x.partition(":") for x in lines[1:]) if sep}
    size = headers.get("content-length", "")
    if not size.isdigit():
        return None
    start = head + 4
    end = start + int(size)
    if data[end : end + 4] != _HEAD_END:
        return None
    block = data[start:end]
    payload = block.partition(_HEAD_END)[2]
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        if name == "warc-payload-digest" and headers.get("warc-type") != "response":
            continue
        if headers.get(name, "").startswith("sha1:") and headers[name][5:] != digest(part):
            return None
    return headers | {"payload": payload}, end + 4


def _records(data: bytes) -> tuple[list[dict], bool]:
    """The records in a member's bytes that pass the checks, and whether nothing else is there."""
    found, at, whole = [], 0, True
    while at < len(data):
        if got := _parsed(data, at):
            found.append(got[0])
            at = got[1]
        else:
            whole = False
            behind = VERSION.search(data, at + 1)
            at = behind.start() if behind else len(data)
    return found, whole


def salvage(data: bytes) -> tuple[list[dict], list[tuple[int, int]]]:
    """All records that pass the checks, and the quarantined gaps as (start, end) in bytes."""
    records: list[dict] = []
    gaps: list[tuple[int, int]] = []
    view, at, bad = memoryview(data), 0, -1
    while at < len(data):
        found, end, whole = [], at, True
        if MEMBER.match(data, at):
            unpacker = zlib.decompressobj(wbits=31)
            try:  # a member at a time, fed in steps so that the rest of the file isn't copied
                out, feed = bytearray(), at
                while not unpacker.eof and feed < len(data):
                    out += unpacker.decompress(view[feed : feed + (1 << 16)])
                    feed += 1 << 16
                if unpacker.eof:
                    end = min(feed, len(data)) - len(unpacker.unused_data)
                    found, whole = _records(bytes(out))
            except zlib.error:
                pass
        elif got := _parsed(data, at):
            found, end = [got[0]], got[1]
        if found:
            if bad >= 0:
                gaps.append((bad, at))
                bad = -1
            if not whole:
                gaps.append((at, end))
            records += found
            at = end
        else:
            bad = at if bad < 0 else bad
            nexts = [m.start() for p in (MEMBER, VERSION) if (m := p.search(data, at + 1))]
            at = min(nexts, default=len(data))
    if bad >= 0:
        gaps.append((bad, len(data)))
    return records, gaps


def write_warc(pages: DataFrame, folder: str, revisit_from: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes every page; returns the manifest (file, records). Columns read: page_id, url, html."""
    _files.make_dir(folder)
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"))
    marks = pages.where(F.octet_length(F.coalesce("html", F.lit(""))) >= revisit_from).select("page_id", "sha1")
    firsts = marks.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    marks = marks.join(firsts.select("sha1", "first"), "sha1").where(~F.col("page_id").eqNullSafe(F.col("first")))
    marks = marks.distinct().select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "first")
    # one exchange of the payloads, by page and digest
    linked = pages.join(marks.hint("merge"), F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")), "left")
    linked = linked.select("page_id", "url", "html", "sha1", "first", F.col("first").isNull().alias("is_first"))
    schema = pa.schema([("file", pa.string()), ("records", pa.int64())])

    def run(batches):
        part, shard = TaskContext.get().partitionId(), 0
        held: list[bytes] = []

        def flush():
            file = f"{folder}/part-{part:06d}-{shard:06d}.warc.gz"
            _files.write(file, b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [file], "records": [len(held)]}, schema)

        size, last, turn = 0, None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "sha1", "first", "is_first")]
            for row in zip(*cols):
                page_id, url, text, sha1, first, is_first = (x.as_py() for x in row)
                turn = turn + 1 if last == (page_id, sha1) else 0
                last = page_id, sha1
                held.append(member(page_record(page_id, url, text, base64.b32encode(sha1).decode(), first, is_first, turn)))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
        if held:
            yield flush()

    return checkpoint(linked.sortWithinPartitions("page_id", "sha1", "url").mapInArrow(run, "file string, records long"))


def read_warc(manifest: DataFrame, with_payload: bool = False, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records (page_id, payload_bytes, payload_digest, record_type, refers_to, and with
    with_payload also payload), and the log of quarantined gaps (file, start, end). With strict, a
    gap in a file is an error of the records' read."""
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)
    number = lambda x: int(x) if x and x != "None" and x != "null" else None

    def records(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                found, lost = salvage(_files.read(file))
                if strict and lost:
                    raise ValueError(f"{file}: unreadable bytes {lost}")
                rows = []
                for r in found:
                    row = {"page_id": number(r.get("x-page-id")), "payload_bytes": number(r.get("x-payload-length")), "payload_digest": r.get("warc-payload-digest", "").removeprefix("sha1:"), "record_type": r.get("warc-type"), "refers_to": number(r.get("x-refers-to-page"))}
                    if row["record_type"] == "response":
                        row["payload_bytes"] = len(r["payload"])
                    rows.append(row | ({"payload": r["payload"]} if with_payload else {}))
                yield pa.RecordBatch.from_pylist(rows, schema)

    log = pa.schema([("file", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def gaps(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                yield pa.RecordBatch.from_pylist([{"file": file, "start": a, "end": b} for a, b in salvage(_files.read(file))[1]], log)

    files = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return files.mapInArrow(records, ddl), files.mapInArrow(gaps, "file string, start long, end long")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_warc(write_warc(pages, scratch(spark, "warc")), strict=True)[0]


ORACLE = {
    "op5_warc": """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as hex, min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast(((cast(concat('0x', substr(hex, cast(j // 4 * 5 + 1 as int), 5)) as bigint) >> cast(15 - 5 * (j % 4) as int)) & 31) + 1 as int), 1)), '') as payload_digest,
    case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from d
"""
}
QUERIES = {"op5_warc": op5_warc}

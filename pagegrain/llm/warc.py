"""WARC archives with segmented records, written and reassembled.

Writing: one record per page, an HTTP response whose body is sent in chunks.
Of equal payloads of at least ``REVISIT_BYTES`` the one with the largest key is
kept as response and the others become revisits of it. A block longer than
``SEGMENT_BYTES`` is cut: the first segment keeps the record's type and id, the
others are continuation records that name it as their origin, and the last
tells the total length. Each record is a gzip member of its own; a task packs
members into archives of about ``ARCHIVE_BYTES``.

Reading: records whole in themselves are decoded where they are read. Segments
are grouped by origin, ordered by number, checked for gaps and against the
total length, joined, and their chunked framing is decoded. What fails a check
gives a row without payload whose ``problem`` says why.

Keys: null keys are written without one and never are the kept copy unless all
of its keys are null. Rows that repeat the kept key and payload are responses
like it. Null payloads are empty, null URLs leave the header out. Records that
repeat an id are the same record: their segments are told apart once and each
first segment gives one row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm.common import quoted, written

REVISIT_BYTES = 1000
SEGMENT_BYTES = 32 << 10
CHUNK_BYTES = 8 << 10
ARCHIVE_BYTES = 8 << 20
LEVEL = 1
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def record_id(key: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}').urn}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[at : at + size]), payload[at : at + size]) for at in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Decodes chunked framing, extensions and trailers included."""
    parts, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise ValueError("chunk size is cut off")
        size = int(body[at:stop].split(b";")[0], 16)
        at = stop + 2
        if size == 0:
            return b"".join(parts)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        parts.append(body[at : at + size])
        at += size + 2


def header(kind: str, name: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END


def records_of(key: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None, revisit: bool) -> Iterator[bytes]:
    """The record of one page, or its segments."""
    name = record_id(key, digest)
    uri = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    fields = [("WARC-Target-URI", uri), ("WARC-Page-Id", key), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + END
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(keeper, digest)), ("WARC-Refers-To-Page-Id", keeper)]
        yield header("revisit", name, fields, block) + block + END
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked" + END + chunked(payload)
    if len(block) <= SEGMENT_BYTES:
        yield header("response", name, fields, block) + block + END
        return
    cuts = range(0, len(block), SEGMENT_BYTES)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + SEGMENT_BYTES]
        if number == 1:
            yield header("response", name, [*fields, ("WARC-Segment-Number", 1)], part) + part + END
            continue
        own = [("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number)]
        own.append(("WARC-Segment-Total-Length", len(block) if number == len(cuts) else None))
        yield header("continuation", record_id(key, f"{digest}:{number}"), own, part) + part + END


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives, each one row; without the last byte, which the writer adds."""
    held: list[bytes] = []
    size = 0

    def archive() -> pa.RecordBatch:
        # a member under 16 MB ends in the zero byte that is the top of its length
        return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["archive"])

    for batch in batches:
        columns = [batch.column(i) for i in range(6)]
        for i in range(batch.num_rows):
            for record in records_of(*[c[i].as_py() for c in columns]):
                pack = zlib.compressobj(LEVEL, wbits=31)
                member = pack.compress(record) + pack.flush()
                if member[-1]:
                    raise ValueError("a record of 16 MB or more was not segmented")
                held.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    held.clear()
                    size = 0
    if held:
        yield archive()


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Writes the pages as archives under ``path``, a folder that executors share."""
    body = F.coalesce(F.col(quoted(payload)).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(url)).alias("url"), body.alias("payload")).withColumn("digest", F.sha1("payload"))
    kept, _ = written(
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "keeper"),
        "warc-kept",
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("key").eqNullSafe(F.col("keeper"))
    told = rows.join(kept, "digest", "left").select("key", "url", "payload", "digest", "keeper", revisit.alias("revisit"))
    packed = told.mapInArrow(_pack, "archive binary").select(F.col("archive").cast("string"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(blob: bytes) -> Iterator[bytes]:
    """The gzip members of an archive, or a plain archive as it is."""
    if blob[:2] != b"\x1f\x8b":
        yield blob
        return
    view, at = memoryview(blob), 0
    while at < len(blob):
        unpack, parts = zlib.decompressobj(wbits=31), []
        while not unpack.eof and at < len(blob):
            piece = view[at : at + (16 << 10)]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        if not unpack.eof:
            raise ValueError("archive is cut off")
        yield b"".join(parts)


def parsed(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or data[at : at + 5] != b"WARC/":
            if data[at:].strip(b"\r\n\0"):
                raise ValueError("no WARC record where one should begin")
            return
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, start = int(fields["content-length"]), stop + len(END)
        yield fields, data[start : start + size]
        at = start + size + len(END)


def payload_of(kind: str, block: bytes) -> tuple[bytes | None, int | None, str | None]:
    """(payload, its length, problem) of a record's whole block."""
    head, end, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if not end:
        return None, None, "HTTP header is cut off"
    if kind == "revisit":
        return None, int(fields.get(b"content-length", 0)), None
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        try:
            body = unchunked(body)
        except ValueError as error:
            return None, None, str(error)
    return body, len(body), None


def _number(text: str | None) -> int | None:
    return None if text is None else int(text)


def _hex(digest: str | None) -> str | None:
    return base64.b32decode(digest.partition(":")[2]).hex() if digest and digest.startswith("sha1:") else None


HEAD = "key long, uri string, record_type string, refers_to long, digest string"
WHOLE = f"{HEAD}, payload binary, payload_bytes long, problem string"
SEGMENT = f"{HEAD}, origin string, number int, total long, block binary"
#: Payload bytes in a batch that leaves Python.
OUT_BYTES = 4 << 20


def _read(want_segments: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    kinds += [pa.string(), pa.int32(), pa.int64(), pa.binary()] if want_segments else [pa.binary(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for blob in batch.column(0):
                for data in members(blob.as_py()):
                    for fields, block in parsed(data):
                        number = fields.get("warc-segment-number")
                        kind = fields.get("warc-type")
                        if want_segments != (number is not None) or kind not in ("response", "revisit", "continuation"):
                            continue
                        head = (_number(fields.get("warc-page-id")), fields.get("warc-target-uri"), kind, _number(fields.get("warc-refers-to-page-id")), _hex(fields.get("warc-payload-digest")))
                        if want_segments:
                            origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                            rows.append((*head, origin, int(number), _number(fields.get("warc-segment-total-length")), block))
                        else:
                            rows.append((*head, *checked(head, block)))
                        size += len(block)
                        if size >= OUT_BYTES:
                            yield _batch(rows, kinds)
                            rows, size = [], 0
        if rows:
            yield _batch(rows, kinds)

    return run


def _batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[str(i) for i in range(len(kinds))])


def checked(head: tuple, block: bytes) -> tuple[bytes | None, int | None, str | None]:
    payload, size, problem = payload_of(head[2], block)
    if payload is not None and head[4] and hashlib.sha1(payload).hexdigest() != head[4]:
        return None, None, "payload digest differs"
    return payload, size, problem


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (parts sorted by number, copies) to whole records."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string()]
    for batch in batches:
        for parts, copies in zip(batch.column(0), batch.column(1)):
            found = [p["s"] | {"number": p["number"]} for p in parts.as_py()]
            first = found[0]
            head = tuple(first[k] for k in ("key", "uri", "record_type", "refers_to", "digest"))
            block, total = b"".join(p["block"] for p in found), found[-1]["total"]
            if [p["number"] for p in found] != list(range(1, len(found) + 1)):
                rest = (None, None, "a segment is missing")
            elif total is not None and total != len(block) or total is None and len(found) > 1:
                rest = (None, None, "total length differs")
            else:
                rest = checked(head, block)
            yield _batch([(*head, *rest)] * max(1, copies.as_py() or 0), kinds)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from their segments."""
    fields = ["key", "uri", "record_type", "refers_to", "digest", "total", "block"]
    once = segments.groupBy("origin", "number").agg(F.first(F.struct(*fields)).alias("s"), F.count(F.lit(1)).alias("copies"))
    grouped = once.groupBy("origin").agg(F.array_sort(F.collect_list(F.struct("number", "s"))).alias("parts"), F.max(F.when(F.col("number") == 1, F.col("copies"))).alias("copies"))
    return grouped.select("parts", "copies").mapInArrow(_reassemble, WHOLE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(key, uri, record_type, refers_to, digest, payload, payload_bytes,
    problem): one row per record, revisits without payload."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return blobs.mapInArrow(_read(False), WHOLE).unionByName(reassembled(blobs.mapInArrow(_read(True), SEGMENT)))


def oracle() -> str:
    """DuckDB SQL of what the archives must tell of each row of ``pages``."""
    return f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p),
r AS (SELECT *, payload_bytes >= {REVISIT_BYTES} AND keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper AS revisit FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN keeper END AS refers_to FROM r
"""

import gzip
import hashlib
import random

import pytest

from pagegrain.llm import warc
from pagegrain.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string, payload string"


def page(key, html, url="http://a.b/c"):
    return (key, url, html, "own")


def around(spark, rows):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path)
    return path, warc.read_archives(spark, path).collect()


def expected(rows):
    best = {}
    for key, _, html, _ in rows:
        best.setdefault(html or "", []).append(key)
    out = []
    for key, _, html, _ in rows:
        body = (html or "").encode()
        known = [k for k in best[html or ""] if k is not None]
        again = len(body) >= 1000 and len(best[html or ""]) > 1 and known and key != max(known)
        out.append((key, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(known) if again else None))
    return sorted(out, key=str)


def test_round_trip_of_all_kinds(spark):
    rng = random.Random(2)
    big = "".join(rng.choices("abc <p>é日\r\n", k=200_000))
    rows = [page(1, None), page(2, ""), page(3, "x" * 999), page(4, "x" * 999), page(5, "y" * 1000), page(9, "y" * 1000), page(7, "y" * 1000), page(9, "y" * 1000), page(10, big), page(11, big), page(12, big + "z"), page(12, big + "z"), page(None, "n" * 2000), page(None, "y" * 1000), page(13, "WARC/1.1\r\n\r\n\r\n\r\n" * 90, None), page(14, "q", "http://a\r\nb/ü")]
    path, got = around(spark, rows)
    assert all(r.problem is None for r in got)
    digest = lambda r: hashlib.sha1(r.payload).hexdigest() if r.record_type == "response" else r.digest
    assert sorted(((r.key, r.payload_bytes, digest(r), r.record_type, r.refers_to) for r in got), key=str) == expected(rows)
    for content in (bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()):
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\n")


def test_query(spark, sf):
    from pagegrain.llm.queries import op1_warc

    rows = [(r.page_id, r.url, r.html, "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op1_warc(spark, sf).collect()), key=str) == expected(rows)


def test_nothing(spark):
    assert around(spark, [])[1] == []


def segments(spark, html):
    """Segment rows of one long page, as read."""
    path = scratch_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([page(1, html)], SCHEMA), path)
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return blobs.mapInArrow(warc._read(True), warc.SEGMENT)


def test_order_gaps_and_lengths(spark):
    html = "".join(random.Random(1).choices("abcdef", k=150_000))
    rows = segments(spark, html).collect()
    schema = warc.SEGMENT
    assert len(rows) > 3
    again = lambda some: warc.reassembled(spark.createDataFrame(some, schema)).collect()
    assert bytes(again(rows[::-1])[0].payload).decode() == html
    assert again([r for r in rows if r.number != 2])[0].problem == "a segment is missing"
    assert again([r for r in rows if r.total is None])[0].problem == "total length differs"
    changed = [r.asDict() | ({"block": b"0" * len(r.block)} if r.number == 3 else {}) for r in rows]
    assert again(changed)[0].problem is not None
    assert len(again(rows + rows)) == 2


@pytest.mark.parametrize("body, payload", [(b"5\r\nhello\r\n0\r\n\r\n", b"hello"), (b"2;x=1\r\nab\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n", b"ab0123456789"), (b"0\r\n\r\n", b"")])
def test_chunked_framing(body, payload):
    assert warc.unchunked(body) == payload
    assert warc.unchunked(warc.chunked(payload, 3)) == payload


@pytest.mark.parametrize("body", [b"5\r\nhel", b"", b"zz\r\nab\r\n0\r\n\r\n"])
def test_broken_framing(body):
    with pytest.raises(ValueError):
        warc.unchunked(body)

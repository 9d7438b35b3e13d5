"""WARC: exact round trips, segments and chunks against a plain computation."""

import hashlib
import base64

import pytest

from ledgerloom.llm import registry, warc
from ledgerloom.llm.common import new_path
from tests.compare import same

PAGES = "page_id long, url string, html string, payload string, digest string, refers_to long"


def expected(rows):
    out = []
    for i, _, html, *_ in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        kept = max(ids) if ids else None
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == kept else "revisit", None if i == kept else kept))
    return sorted(out, key=str)


def rows():
    long = "".join(chr(97 + i * i % 26) for i in range(40_000)) + "é" * 3000
    texts = [(1, "http://a/ b\r\nx", "<p>é</p>"), (2, None, None), (3, "", ""), (4, "u", long), (9, "u", long), (5, "u", "WARC/1.1\r\nWARC-Type: x\r\n\r\n" * 50), (None, "u", "lone"), (None, "u", long), (7, "u", "same"), (7, "u", "same"), (8, "u", "0\r\n\r\n"), (10, "u", "\r\n\r\n")]
    return [(*t, "clash", "clash", 5) for t in texts]


@pytest.mark.parametrize("segment", [64, 1000, 8192, 1 << 20])
def test_round_trip(spark, segment):
    pages = spark.createDataFrame(rows(), PAGES).repartition(3)
    path = new_path(spark, "test-warc")
    warc.write_archives(pages, path, segment, max(16, segment // 3))
    records = warc.read_archives(spark, path)
    assert records.where("not complete").isEmpty()
    assert sorted(map(tuple, warc.digests(records).collect()), key=str) == expected(rows())


def test_empty(spark):
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.digests(warc.read_archives(spark, path)).count() == 0


def test_foreign_archive(spark, tmp_path):
    """Plain payloads, the version line inside one, a gap, a wrong total, a broken chunk."""
    def record(fields, block):
        return warc._record([("WARC-Date", warc.DATE), *fields], block) + b"\r\n"

    inner = b"x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\n\r\n"
    chunky = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    name = lambda k: ("WARC-Record-ID", f"<urn:{k}>")
    response = ("WARC-Type", "response")
    digest = lambda p: ("WARC-Payload-Digest", f"sha1:{warc.digest32(p)}")
    part = lambda k, of, n, total=None: [("WARC-Type", "continuation"), name(k), ("WARC-Segment-Origin-ID", f"<urn:{of}>"), ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)]
    data = [
        record([("WARC-Type", "warcinfo"), name("info")], b"software: x\r\n"),
        record([response, name("plain"), digest(inner)], head + inner),
        record([response, name("ext"), digest(b"abcdef")], chunky + b"3;a=b\r\nabc\r\n3\r\ndef\r\n0\r\nT: 1\r\n\r\n"),
        record([response, name("broken"), digest(b"abc")], chunky + b"5\r\nabc\r\n0\r\n\r\n"),
        record(part("s3", "seg", 3, len(head) + 6), b"ef"),
        record([response, name("seg"), digest(b"abcdef"), ("WARC-Segment-Number", 1)], head + b"ab"),
        record(part("s2", "seg", 2), b"cd"),
        record([response, name("gap"), digest(b"ab"), ("WARC-Segment-Number", 1)], head + b"a"),
        record(part("g3", "gap", 3, len(head) + 2), b"b"),
        record([response, name("short"), digest(b"ab"), ("WARC-Segment-Number", 1)], head + b"a"),
        record(part("h2", "short", 2, 999), b"b"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(data))
    got = {r["record_id"]: (r["complete"], r["payload"] and bytes(r["payload"])) for r in warc.read_archives(spark, str(tmp_path / "a.warc")).collect()}
    assert got == {
        "<urn:info>": (True, None),
        "<urn:plain>": (True, inner),
        "<urn:ext>": (True, b"abcdef"),
        "<urn:broken>": (False, None),
        "<urn:seg>": (True, b"abcdef"),
        "<urn:gap>": (False, None),
        "<urn:short>": (False, None),
    }


def test_cut_archive(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc._record([("WARC-Type", "response")], b"HTTP/1.1 200 OK\r\n\r\nabc")[:-4])
    with pytest.raises(Exception, match="shorter than its Content-Length"):
        warc.read_archives(spark, str(tmp_path / "a.warc")).collect()


def test_query(spark, sf_dir):
    same(registry.op1_warc(spark, sf_dir), registry.SQL["op1_warc"], sf_dir)

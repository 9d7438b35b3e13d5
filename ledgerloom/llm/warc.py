"""WARC archives: written through Spark's text sink, read back in pieces, segments reassembled, chunked bodies decoded.

A record ends in CR LF CR LF. The sink writes each record without its last CR LF, which is the sink's line separator,
so the files are plain (or gzipped) WARC on any file system that Spark reaches. The reader splits the stream at the
version line; a payload that holds that line itself is put together again by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, staged

MARK = b"WARC/1.1\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing; a chunk border goes through every version line in the payload."""
    cuts = {0, len(payload), *range(0, len(payload), size), *(m.start() + 4 for m in re.finditer(re.escape(MARK), payload))}
    order = sorted(cuts)
    return b"".join(b"%x\r\n%b\r\n" % (b - a, payload[a:b]) for a, b in zip(order, order[1:])) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or cut short. Extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        size = body[at:end].split(b";")[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(parts)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        parts.append(body[at : at + n])
        at += n + 2


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response block; None if it has no header end or broken chunks."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\b", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return MARK + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n"


def records_of(page: dict, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The records of one page, each without its last CR LF: a response in segments, or a revisit."""
    name = f"<{uuid.UUID(bytes=hashlib.md5(b'%d:%d' % (page['row_key'], -1 if page['page_id'] is None else page['page_id'])).digest()).urn}>"
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", page["url"] or "")
    payload = page["payload"] or b""
    common = [("WARC-Date", DATE), ("X-Page-Id", page["page_id"]), ("WARC-Target-URI", url or None), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if page["revisit"]:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Profile", PROFILE), ("X-Refers-To-Page", page["refers_to"]), *common], HTTP + b"\r\n")
        return
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, part in enumerate(parts, 1):
        number = k if len(parts) > 1 else None
        total = len(block) if 1 < len(parts) == k else None
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("WARC-Segment-Number", number)], part)
        else:
            own = f"<{uuid.UUID(bytes=hashlib.md5(f'{name}{k}'.encode()).digest()).urn}>"
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", number), ("WARC-Segment-Total-Length", total)], part)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 8192, chunk_bytes: int = 4096) -> None:
    """Writes one logical record per row of pages (page_id, url, html) as gzipped WARC files under path.

    Of the rows with equal payloads, those with the largest page_id are responses, the others revisits that name it;
    rows without page_id count as smaller than any. A null html is an empty payload. Blocks of over segment_bytes are
    cut into a response and continuation records. Only the digest and page_id are aggregated; pages meet the digests that
    several have, in a broadcast where those are few; where they are many, a payload that a third of the rows share is a
    skewed join key, which adaptive execution splits. Repeated page_ids are records of their own;
    an empty table gives no records; other columns, whatever their names, are not read.
    """
    bound_batches(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"), F.monotonically_increasing_id().alias("row_key"))
    base = base.withColumn("digest", F.unhex(F.sha1("payload")))
    shared = base.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    shared = staged(shared.select(F.col("digest").alias("d"), "refers_to"), "warc-shared")
    revisit = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = base.join(shared, F.col("digest") == F.col("d"), "left").select("page_id", "url", "payload", "row_key", "refers_to", revisit.alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = [r for page in batch.slice(at, 256).to_pylist() for r in records_of(page, segment_bytes, chunk_bytes)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    lines = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


SEGMENTS = "record_id string, type string, page_id long, uri string, refers_to long, digest string, segment int, total long, block binary"


def pieces(batches: Iterator[pa.RecordBatch], segmented: bool) -> Iterator[pa.RecordBatch]:
    """Records from what lies between version lines, in file order: those in segments, or the others."""
    rows: list[dict] = []
    held = b""

    def parsed(piece: bytes) -> dict | None:
        head, found, rest = piece.partition(b"\r\n\r\n")
        f = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")))
        if not found or not f.get("content-length", "").isdigit():
            raise ValueError(f"not a WARC record: {piece[:80]!r}")
        n = int(f["content-length"])
        if len(rest) < n:
            return None
        long = lambda k: int(f[k]) if k in f else None
        return {"record_id": f.get("warc-segment-origin-id", f.get("warc-record-id")), "type": f.get("warc-type"), "page_id": long("x-page-id"), "uri": f.get("warc-target-uri"), "refers_to": long("x-refers-to-page"), "digest": f.get("warc-payload-digest", "").removeprefix("sha1:"), "segment": long("warc-segment-number"), "total": long("warc-segment-total-length"), "block": rest[:n]}

    def flush() -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "segment": pa.int32(), "total": pa.int64(), "block": pa.binary()}
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)
        rows.clear()
        return batch

    for batch in batches:
        for x in batch.column(0):
            piece = x.as_py()
            if not piece and not held:
                continue
            found = parsed(held + MARK + piece if held else piece)
            held = b"" if found else (held + MARK + piece if held else piece)
            if found and (found["segment"] is not None) == segmented:
                rows.append(found)
            if len(rows) >= 256:
                yield flush()
    if held:
        raise ValueError(f"a record is shorter than its Content-Length: {held[:200]!r}")
    if rows:
        yield flush()


READ = "record_id string, type string, page_id long, uri string, refers_to long, digest string, complete boolean, payload binary"


def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Logical records from segments sorted by record_id and segment; one record's segments are held at a time."""
    group: list[dict] = []
    rows: list[dict] = []

    def close() -> None:
        if not group:
            return
        first, total = group[0], group[-1]["total"]
        numbers = [r["segment"] for r in group]
        block = b"".join(r["block"] for r in group)
        whole = first["segment"] is None or numbers == list(range(1, len(group) + 1)) and total == len(block)
        payload = payload_of(block) if whole and first["type"] == "response" else None
        rows.append({k: first[k] for k in ("record_id", "type", "page_id", "uri", "refers_to", "digest")} | {"complete": whole and (first["type"] != "response" or payload is not None and digest32(payload) == first["digest"]), "payload": payload})
        group.clear()

    def flush() -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "complete": pa.bool_(), "payload": pa.binary()}
        names = [x.split()[0] for x in READ.split(", ")]
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds.get(k, pa.string())) for k in names], names)
        rows.clear()
        return batch

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for r in batch.slice(at, 256).to_pylist():
                if group and (r["segment"] is None or r["record_id"] != group[0]["record_id"]):
                    close()
                group.append(r)
            if len(rows) >= 256:
                yield flush()
    close()
    if rows:
        yield flush()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Logical records of the WARC files under path: READ's columns; payload is that of responses.

    Continuation records are grouped by their origin's identifier and put in order of segment number; a gap, a repeat
    or a length other than WARC-Segment-Total-Length gives complete false and a null payload, as do broken chunks; a
    digest other than the header's gives complete false. Files must be gzipped or small enough not to be split if a
    payload may hold the version line. Empty files give no rows; header fields that aren't known are skipped.
    """
    bound_batches(spark)
    lines = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("value").cast("binary").alias("value"))
    whole = lines.mapInArrow(lambda b: pieces(b, False), SEGMENTS).mapInArrow(assembled, READ)
    cut = lines.mapInArrow(lambda b: pieces(b, True), SEGMENTS)
    cut = cut.repartition("record_id").sortWithinPartitions("record_id", "segment").mapInArrow(assembled, READ)
    return whole.unionByName(cut)


def digests(records: DataFrame) -> DataFrame:
    """Per logical record of read_archives(): page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit takes the length of the response whose page_id and digest it names (null if it isn't there). An
    incomplete response has null length and digest.
    """
    narrow = staged(records.select("type", "page_id", "refers_to", "digest", "complete", F.octet_length("payload").cast("long").alias("payload_bytes")), "warc-records")
    whole = F.col("complete")
    ok = narrow.where("type = 'response'").select("page_id", F.when(whole, F.col("payload_bytes")).alias("payload_bytes"), F.when(whole, F.col("digest")).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    sizes = ok.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    again = narrow.where("type = 'revisit'").select("page_id", "digest", "refers_to").join(sizes, ["refers_to", "digest"], "left")
    return ok.unionByName(again.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to"))

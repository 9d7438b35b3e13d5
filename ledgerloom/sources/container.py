"""Encrypted containers: a header of 128 bytes, chunks of AES-256-GCM with chained authentication, a digest.

All integers are big-endian. A chunk is its box's length, its nonce and the box (ciphertext and tag); what it
authenticates besides is the header's SHA-256, its index, and the tag of the chunk before. Reading is native: chunks are
cut with binary functions and each is decrypted on its own, as the tag before is in the file. Writing follows the chain
in one expression a file.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.crypto import TAG_BYTES, gcm_open, gcm_seal, password_hash_fits

#: Magic, sizes, flags and algorithm numbers.
MAGIC = b"PFBOOK\x01\x00"
VERSION = 1
HEADER, FIXED, TRAILER = 128, 48, 32
AESGCM, GZIP, CHUNKED, ATTACHMENTS, MULTI_VOLUME, INCREMENTAL = 1, 2, 4, 8, 16, 32
KDF_ARGON2ID, AEAD_AES256GCM = 1, 1
FRAME = 16
#: Limits of what a payload may inflate to.
MOST_INFLATED, MOST_RATIO = 512 * 1024 * 1024, 200
LAYOUT = ">8sHHHBBIIBBHHHQII16s8s12s8sHH32s"


class ContainerError(ValueError):
    """A file that isn't a container, or is damaged."""

    failure = "damaged"


class NotAContainer(ContainerError):
    failure = "not_a_container"


class NewerFormat(ContainerError):
    failure = "newer_format"


class BadHeader(ContainerError):
    failure = "damaged_header"


class OddParameters(ContainerError):
    """Parameters of the password hash that no writer of this format sets."""

    failure = "odd_parameters"


class WrongKey(ContainerError):
    """The file is as it was written, so a chunk that doesn't open has another key."""

    failure = "wrong_key"


@dataclass(frozen=True)
class Header:
    salt: bytes
    nonce_prefix: bytes
    plaintext_length: int
    chunk_count: int
    flags: int = AESGCM | CHUNKED
    kib: int = 65_536
    passes: int = 3
    lanes: int = 1
    chunk_kib: int = 1024
    volume_set: bytes = field(default=bytes(8))
    volume: int = 1
    volumes: int = 1
    set_digest: bytes = field(default=bytes(32))
    version: int = VERSION
    least_reader: int = VERSION

    def encode(self) -> bytes:
        fixed = struct.pack(LAYOUT[: LAYOUT.index("QI") + 2], MAGIC, self.version, self.least_reader, self.flags, KDF_ARGON2ID, AEAD_AES256GCM, self.kib, self.passes, self.lanes, 32, len(self.salt), len(self.nonce_prefix), self.chunk_kib, self.plaintext_length, self.chunk_count)
        first = self.nonce_prefix + bytes(4)
        return fixed + struct.pack(">I16s8s12s8sHH32s", zlib.crc32(fixed), self.salt, self.nonce_prefix, first, self.volume_set, self.volume, self.volumes, self.set_digest)

    @classmethod
    def decode(cls, data: bytes) -> Header:
        if len(data) < HEADER:
            raise BadHeader("truncated header")
        magic, version, least, flags, kdf, aead, kib, passes, lanes, out, salt_n, prefix_n, chunk_kib, plain, count, crc, salt, prefix, first, volume_set, volume, volumes, digest = struct.unpack(LAYOUT, data[:HEADER])
        if magic != MAGIC:
            raise NotAContainer("not a container")
        if crc != zlib.crc32(data[: FIXED - 4]):
            raise BadHeader("header checksum")
        if version > VERSION or least > VERSION:
            raise NewerFormat("a newer format")
        if (kdf, aead, out, salt_n, prefix_n) != (KDF_ARGON2ID, AEAD_AES256GCM, 32, 16, 8) or flags & ~63 or not flags & AESGCM:
            raise BadHeader("unknown algorithms or flags")
        if not password_hash_fits(kib, passes, lanes):
            raise OddParameters("password hash parameters out of bounds")
        if first != prefix + bytes(4):
            raise BadHeader("first nonce")
        return cls(salt, prefix, plain, count, flags, kib, passes, lanes, chunk_kib, volume_set, volume, volumes, digest, version, least)


def layout(file: bytes) -> tuple[Header, list[tuple[bytes, bytes]]]:
    """Header and chunks (nonce, box) of a whole file; cut, over-long or disordered files are errors."""
    header = Header.decode(file)
    at, chunks = HEADER, []
    for i in range(header.chunk_count):
        if at + FRAME > len(file) - TRAILER:
            raise ContainerError("truncated")
        (n,) = struct.unpack(">I", file[at : at + 4])
        nonce, box = file[at + 4 : at + FRAME], file[at + FRAME : at + FRAME + n]
        if n < TAG_BYTES or at + FRAME + n > len(file) - TRAILER:
            raise ContainerError("truncated")
        if nonce != header.nonce_prefix + struct.pack(">I", i):
            raise ContainerError("nonce out of order")
        chunks.append((nonce, box))
        at += FRAME + n
    if at + TRAILER != len(file):
        raise ContainerError("bytes after the chunks")
    if sum(len(b) - TAG_BYTES for _, b in chunks) != header.plaintext_length:
        raise ContainerError("plaintext length")
    return header, chunks


def intact(file: bytes) -> bool:
    """Whether the trailing digest fits; no key is needed."""
    return len(file) >= HEADER + TRAILER and hashlib.sha256(file[FIXED:-TRAILER]).digest() == file[-TRAILER:]


def seal(spark: SparkSession, payload: bytes, key: bytes, header: Header, chunk_bytes: int | None = None) -> bytes:
    """A container of the payload; the header's lengths are set from it. One expression follows the chain of tags.
    chunk_bytes makes chunks smaller than the header says, which readers don't mind."""
    size = chunk_bytes or header.chunk_kib * 1024
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    head = Header(**{**header.__dict__, "plaintext_length": len(payload), "chunk_count": len(parts)}).encode()
    body = b""
    if parts:
        digest = F.lit(bytearray(hashlib.sha256(head).digest()))
        rows = spark.createDataFrame([(bytearray(key), [bytearray(p) for p in parts])], "key binary, parts array<binary>")
        start = F.struct(F.array().cast("array<binary>").alias("boxes"), F.lit(bytearray(32)).alias("tag"))

        def step(state: Column, part: Column) -> Column:
            index = F.unhex(F.lpad(F.hex(F.size(state["boxes"])), 8, "0"))
            box = gcm_seal(part, F.col("key"), F.concat(F.lit(bytearray(header.nonce_prefix)), index), F.concat(digest, index, state["tag"]))
            return F.struct(F.concat(state["boxes"], F.array(box)).alias("boxes"), F.substring(box, -TAG_BYTES, TAG_BYTES).alias("tag"))

        boxes = rows.select(F.aggregate("parts", start, step)["boxes"]).first()[0]
        body = b"".join(struct.pack(">I", len(b)) + header.nonce_prefix + struct.pack(">I", i) + bytes(b) for i, b in enumerate(boxes))
    file = head + body
    return file + hashlib.sha256(file[FIXED:]).digest()


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """Per file: path, format_version, flags, chunk_count, plaintext_length, header_ok, digest_ok; nothing is decrypted."""
    part = lambda at, n: F.substring("content", at + 1, n)
    number = lambda at, n: F.conv(F.hex(part(at, n)), 16, 10).cast("long")
    size = F.octet_length("content")
    long_enough = size >= HEADER + TRAILER
    body = F.substring(F.col("content"), F.lit(FIXED + 1), size - FIXED - TRAILER)
    return spark.read.format("binaryFile").load(path).select(
        "path",
        number(8, 2).alias("format_version"),
        number(12, 2).alias("flags"),
        number(40, 4).alias("chunk_count"),
        number(32, 8).alias("plaintext_length"),
        (long_enough & (part(0, 8) == F.lit(bytearray(MAGIC))) & (F.crc32(part(0, FIXED - 4)) == number(FIXED - 4, 4))).alias("header_ok"),
        (long_enough & (F.sha2(body, 256) == F.lower(F.hex(F.substring(F.col("content"), size - TRAILER + 1, F.lit(TRAILER)))))).alias("digest_ok"),
    )


def open_file(spark: SparkSession, file: bytes, key: bytes) -> bytes:
    """The payload of one container; its chunks are decrypted by tasks. Damage is found before a wrong key."""
    header, chunks = layout(file)
    if not intact(file):
        raise ContainerError("digest")
    if not chunks:
        return b""
    digest = hashlib.sha256(file[:HEADER]).digest()
    tags = [bytes(32), *(b[-TAG_BYTES:] for _, b in chunks)]
    # the key is data like the rest, as literals show in plans and event logs
    rows = [(i, bytearray(n), bytearray(b), bytearray(digest + struct.pack(">I", i) + tags[i]), bytearray(key)) for i, (n, b) in enumerate(chunks)]
    frame = spark.createDataFrame(rows, "i int, nonce binary, box binary, aad binary, key binary").select("i", gcm_open(F.col("box"), F.col("key"), F.col("nonce"), F.col("aad")).alias("plain"))
    parts = dict(map(tuple, frame.collect()))
    if any(p is None for p in parts.values()):
        raise WrongKey("wrong key")
    return b"".join(bytes(parts[i]) for i in range(len(chunks)))


def deflated(payload: bytes) -> bytes:
    return gzip.compress(payload, 6, mtime=0)


def inflated(data: bytes, most: int = MOST_INFLATED, ratio: int = MOST_RATIO) -> bytes:
    """Gunzips, stopping at the limits."""
    limit, out = min(most, ratio * len(data)), b""
    with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
        while part := f.read(1 << 20):
            out += part
            if len(out) > limit:
                raise ContainerError("inflates beyond the limit")
    return out


def export(spark: SparkSession, payload: bytes, key: bytes, header: Header) -> bytes:
    """A gzipped, sealed payload, read back and compared before it is returned."""
    flagged = Header(**{**header.__dict__, "flags": header.flags | GZIP})
    file = seal(spark, deflated(payload), key, flagged)
    if inflated(open_file(spark, file, key)) != payload:
        raise ContainerError("what was written doesn't read back")
    return file

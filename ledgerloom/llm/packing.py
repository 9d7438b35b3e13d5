"""Packing documents into token sequences by bounded-space best fit.

Each task keeps a fixed number of open windows. A document's full windows leave at once; its rest goes to the open
window that it fills best. Where none has room, the fullest is topped up with the document's next tokens and emitted.
The windows left open at the end of all tasks are merged in a second, small step.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bound_batches, staged

#: The byte-level BPE's word pattern (published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose class might differ between Unicode versions or regex engines: such texts are encoded in one piece.
ODD = re.compile("[^\t\n\r\x20-\x7e\xa1-ȳΑ-ΡΣ-ωА-я‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
#: Tasks whose left-over windows are merged together.
MERGED = 16
END = 1


def byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable bytes stand for themselves, the others for the
    letters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


class Words:
    """Token ids of texts, as the tokenizers library gives them, as bytes of little-endian unsigned 32-bit numbers.

    A byte-level vocabulary whose ids are in the order of its merges can be encoded by ranks, which is several times as
    fast and gives the same ids. That is done for ordinary texts; texts with special tokens or odd characters, and all
    texts of other vocabularies, are encoded by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        with open(path, encoding="utf-8") as f:
            self.ranked = ranked(json.load(f), special)

    def ids(self, text: str) -> bytes:
        text = text.encode("utf-8", "replace").decode()
        if self.ranked is None or ODD.search(text) or self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    """One encoder a worker process."""
    return Words(path)


def ranked(file: dict, special: list[str]) -> tiktoken.Encoding | None:
    """The file's vocabulary as ranks; None if it isn't plain byte-level BPE with ids in the order of merges."""
    model, letters = file["model"], byte_letters()
    before = file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or file.get("normalizer"):
        return None
    words = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(words.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)) or any(c not in letters for t in words for c in t):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={bytes(letters[c] for c in t): i for t, i in words.items()}, special_tokens={})


class Piece:
    """length ids of a document, from start on."""

    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: bytes, doc_tokens: int) -> None:
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[: 4 * n], self.doc_tokens), Piece(self.doc_id, self.start + n, self.ids[4 * n :], self.doc_tokens)

    def __len__(self) -> int:
        return len(self.ids) // 4


Window = list[Piece]


def best_fit(pieces: Iterator[Piece], length: int, windows: int) -> Iterator[tuple[Window, bool]]:
    """Windows of pieces, with whether they are full; at most `windows` are open at once, which come last, not full."""
    opened: list[tuple[int, int, Window]] = []  # room, number, pieces
    number = 0
    for piece in pieces:
        while len(piece) >= length:
            full, piece = piece.cut(length)
            yield [full], True
        while len(piece):
            at = bisect_left(opened, (len(piece),))
            if at < len(opened):
                room, n, window = opened.pop(at)
            elif len(opened) < windows:
                room, n, window, number = length, number, [], number + 1
            else:
                room, n, window = opened.pop(0)
            part, piece = piece.cut(min(room, len(piece)))
            window.append(part)
            if room == len(part):
                yield window, True
            else:
                insort(opened, (room - len(part), n, window))
    for _, _, window in opened:
        yield window, False


def merged(windows: list[Window], length: int) -> Iterator[Window]:
    """Left-over windows put together: largest first, each into the sequence that it fills best; then the emptiest
    sequences are cut up to fill the fullest, and what remains is cut at powers of two, so that nothing is padded."""
    bins: list[tuple[int, int, Window]] = []
    for n, w in enumerate(sorted(windows, key=lambda w: (-sum(map(len, w)), w[0].doc_id is None, w[0].doc_id or 0, w[0].start))):
        size = sum(map(len, w))
        at = bisect_left(bins, (size,))
        room, k, held = bins.pop(at) if at < len(bins) else (length, n, [])
        insort(bins, (room - size, k, held + w))
    while bins:
        room, _, window = bins.pop(0)
        while room and bins:
            left, k, source = bins.pop()
            piece = source.pop()
            part, rest = piece.cut(min(room, len(piece)))
            window.append(part)
            room -= len(part)
            left += len(part)
            if len(rest):
                source.append(rest)
            if source:
                insort(bins, (left, k, source))
        if not room:
            yield window
            continue
        size = length - room
        for bit in reversed(range(size.bit_length())):
            want, out = size & 1 << bit, []
            while want:
                head = window.pop(0)
                part, rest = head.cut(min(want, len(head)))
                out.append(part)
                want -= len(part)
                if len(rest):
                    window.insert(0, rest)
            if out:
                yield out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
OPEN = PIECES + ", task int, ids binary"
KINDS = {"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "task": pa.int32(), "ids": pa.binary()}


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[n]) for n, c in zip(names, zip(*rows))], names)


def rows_of(window: Window, sequence: int) -> Iterator[tuple]:
    at = 0
    for p in window:
        yield p.doc_id, p.start, len(p), zlib.crc32(p.ids), p.doc_tokens, sequence, at
        at += len(p)


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, windows: int = 32) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens added, then id 1. Null and empty texts have that id
    alone; null and repeated doc_ids keep their rows; an empty table gives an empty result; other columns are not read.
    Sequences have `length` ids, but for the powers of two that the last ones of a merge are cut into. Texts aren't
    shuffled: a task packs what it scans, and holds `windows` windows. Left-over windows of MERGED tasks are merged
    together, so the second step's groups are bounded by MERGED * windows * length ids.
    """
    names = list(KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = words_of(tokenizer), TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    ids = words.ids(text.as_py() or "") + end
                    yield Piece(doc_id.as_py(), 0, ids, len(ids) // 4)

        rows: list[tuple] = []
        for n, (window, full) in enumerate(best_fit(pieces(), length, windows)):
            rows += [(*r, None if full else task, None if full else p.ids) for r, p in zip(rows_of(window, task << 40 | n), window)]
            if len(rows) >= 10_000:
                yield batch_of(rows, names)
                rows = []
        if rows:
            yield batch_of(rows, names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Window] = {}
        group = None

        def close() -> Iterator[pa.RecordBatch]:
            rows = [r for n, w in enumerate(merged(list(held.values()), length)) for r in rows_of(w, 1 << 62 | group << 24 | n)]
            if rows:
                yield batch_of(rows, names[:7])

        for batch in batches:
            for r in batch.to_pylist():
                if r["task"] // MERGED != group:
                    yield from close()
                    held, group = {}, r["task"] // MERGED
                held.setdefault(r["sequence_id"], []).append(Piece(r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
        yield from close()

    bound_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = staged(texts.mapInArrow(run, OPEN), "packing")
    left = first.where("task is not null").withColumn("grp", F.floor(F.col("task") / MERGED))
    left = left.repartition("grp").sortWithinPartitions("grp", "task", "sequence_id", "offset").drop("grp")
    return first.where("task is null").drop("task", "ids").unionByName(left.mapInArrow(merge, PIECES))

"""Packing: every id in one piece, gapless sequences, little padding, ids as the library gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing, registry

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
DOCS = "doc_id long, text string, start string, ids string, task string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def examine(tokenizer, rows, got, length, padding):
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    wanted = defaultdict(list)
    for (i, _), x in zip(rows, ids):
        wanted[i, len(x)].append(x)
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    assert set(pieces) == set(wanted)
    for key, docs in wanted.items():
        cover = np.zeros(key[1], int)
        for r in pieces[key]:
            a, b = r["start"], r["start"] + r["length"]
            assert 0 <= a < b <= key[1]
            cover[a:b] += 1
            assert r["ids_crc32"] in {zlib.crc32(x[a:b].tobytes()) for x in docs}
        assert (cover == len(docs)).all()
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert 0 < at <= length
        padded += 0 if at & (at - 1) == 0 else length - at
    assert padded <= padding * sum(map(len, ids))


def texts(n):
    rng = random.Random(3)
    return [" ".join(rng.choice(["the", "Straße", "x1y", "…", "naïve", "数据"]) for _ in range(int(rng.paretovariate(0.8) * 10) % 3000)) for _ in range(n)]


def test_pack(spark, tokenizer):
    rows = [*enumerate(texts(300)), (None, "no id"), (None, None), (7, ""), (7, ""), (8, "<|endoftext|> in text"), (9, "\x1c\x85 odd ⅷ 👩‍👩‍👧"), (10, "long " * 20_000)]
    docs = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOCS).repartition(5)
    for length, windows in ((2048, 32), (64, 1), (64, 4)):
        examine(tokenizer, rows, packing.pack(docs, PATH, length, windows).collect(), length, 0.0)


def test_edges(spark, tokenizer):
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0
    examine(tokenizer, [(1, "a b c d")], packing.pack(spark.createDataFrame([(1, "a b c d", "", "", "")], DOCS), PATH).collect(), 2048, 0.0)


def test_windows_are_bounded_and_best():
    sizes = [30, 50, 20, 40, 64, 10, 64, 33]
    pieces = [packing.Piece(i, 0, bytes(4 * n), n) for i, n in enumerate(sizes)]
    out = list(packing.best_fit(iter(pieces), 64, 3))
    assert [sum(map(len, w)) for w, full in out if full] == [64] * sum(full for _, full in out)
    assert sum(not full for _, full in out) <= 3 and sum(len(p) for w, _ in out for p in w) == sum(sizes)


def plain_best_fit(sizes, length, windows):
    """Windows as lists of (document, ids), by looking at every open window."""
    opened, out, number = [], [], 0
    for doc, size in enumerate(sizes):
        while size >= length:
            out.append(([(doc, length)], True))
            size -= length
        while size:
            fitting = [w for w in opened if w[0] >= size]
            if fitting:
                window = min(fitting, key=lambda w: (w[0], w[1]))
            elif len(opened) < windows:
                window = [length, number, []]
                number += 1
                opened.append(window)
            else:
                window = min(opened, key=lambda w: (w[0], w[1]))  # the fullest is topped up
            part = min(window[0], size)
            window[2].append((doc, part))
            window[0] -= part
            size -= part
            if window[0] == 0:
                opened.remove(window)
                out.append((window[2], True))
    return out + [(w[2], False) for w in sorted(opened, key=lambda w: (w[0], w[1]))]


def test_best_fit_against_plain_code():
    rng = random.Random(14)
    for _ in range(200):
        sizes = [int(rng.paretovariate(0.7) * 3) % 300 + 1 for _ in range(rng.randint(0, 60))]
        length, windows = rng.choice([16, 64, 100]), rng.choice([1, 2, 5, 32])
        pieces = (packing.Piece(i, 0, bytes(4 * n), n) for i, n in enumerate(sizes))
        got = [([(p.doc_id, len(p)) for p in w], full) for w, full in packing.best_fit(pieces, length, windows)]
        assert got == plain_best_fit(sizes, length, windows)


@pytest.mark.parametrize("text", ["", " ", "a", "Hello, world's  end\n\n\nx", "don't WE'LL 12x3 4½", "İstanbul ß ſ K", "数据 テスト 한국어", "\t\tx\r\n", "a‍b   c", "<|endoftext|>", "émigré " * 50])
def test_ids(tokenizer, text):
    assert packing.words_of(PATH).ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_other_vocabularies_use_the_library():
    assert packing.words_of(PATH).ranked is not None
    assert packing.Words(str(public_tokenizers.path("word_bpe_49k.json"))).ranked is None


def test_query(spark, sf_dir, tokenizer):
    rows = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    examine(tokenizer, rows, registry.op6_packing(spark, sf_dir).collect(), 2048, 0.0)

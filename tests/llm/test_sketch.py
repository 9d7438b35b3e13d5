"""Sketches: estimates against exact sets, neighbours and edits against a sorted list."""

import hashlib
import random

import numpy as np
import pytest

from ledgerloom.llm import registry, sketch

DOCS = "doc_id long, text string, n_chars string, part int, halo string"


def exact(text, width=sketch.SHINGLE):
    return {text[i : i + width] for i in range(max(1, len(text) - width + 1))} if text else set()


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_estimates():
    rng = random.Random(1)
    for n in (3, 30, 400, 3000):
        a = words(rng, n)
        b = sketch.edited(a, words(rng, n))
        x, y = exact(a), exact(b)
        s, t = sketch.sketch(a), sketch.sketch(b)
        assert abs(sketch.resemblance(s, t) - len(x & y) / len(x | y)) < 0.15
        assert abs(sketch.containment(s, t) - len(x & y) / len(x)) < 0.2
        assert abs(sketch.distinct(s) / len(x) - 1) < 0.3
        assert (sketch.decoded(sketch.encoded(s)) == s).all()
        if len(a) < 4 * sketch.SHINGLE:
            continue  # a part shorter than a shingle is a shingle of its own
        head, tail = a[: len(a) // 2 + sketch.SHINGLE - 1], a[len(a) // 2 :]
        assert (sketch.merge(sketch.sketch(head), sketch.sketch(tail)) == s).all()


def test_hash_of_a_window_is_its_own():
    rng = random.Random(2)
    for width in (1, 5, 12, 13):
        text = words(rng, 40) + "é😀" * 9
        whole = sketch.shingle_hashes(text, width)
        assert whole.size == len(text) - width + 1
        for i in range(0, whole.size, 7):
            assert sketch.shingle_hashes(text[i : i + width], width)[0] == whole[i]
    assert sketch.sketch("").size == 0 and sketch.sketch("ab").size == 1
    many = sketch.sketch(words(rng, 2000))
    assert many.size == sketch.K and (np.diff(many.astype(np.int64)) > 0).all()


def brute(rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, (r[1] or "").encode()))
    out = []
    for n, (i, text) in enumerate(known):
        out.append((i, text or "", known[(n + 1) % len(known)][1] or ""))
    out += [(None, t or "", None) for i, t in rows if i is None]
    result = []
    for i, text, following in out:
        new = sketch.edited(text, following)
        own, changed = sketch.sketch(text), sketch.sketch(new)
        near = 0.0 if following is None else sketch.resemblance(own, sketch.sketch(following))
        result.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), sketch.encoded(own), sketch.encoded(changed), sketch.resemblance(own, changed), near))
    return sorted(result, key=str)


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_operator(spark, n):
    rng = random.Random(n)
    rows = [(rng.randrange(-1000, 10**12), words(rng, rng.randint(1, 60))) for _ in range(n)]
    rows += [(r[0], r[1]) for r in rows[:5]] + [(r[0], "other") for r in rows[:5]]
    if n == 50:
        rows += [(5, None), (5, ""), (4, "é😀" * 50), (3, "z" * 300_000), (None, "no id here"), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], DOCS).repartition(3)
    assert sorted(map(tuple, sketch.fingerprint(docs).collect()), key=str) == brute(rows)


def test_only_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "abc" * 20)], "doc_id long, text string")
    assert [tuple(r) for r in sketch.fingerprint(docs).collect()] == brute([(None, "abc" * 20)])


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op10_fingerprints(spark, sf_dir).collect()), key=str) == brute(rows)

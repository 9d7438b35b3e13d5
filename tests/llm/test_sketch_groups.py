"""Sketches of groups and of pairs, against sketches of what they hold together."""

import random

import pytest

from ledgerloom.llm import sketch
from tests.llm.test_sketch import exact, words


def test_merged(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i % 2, words(rng, rng.randint(0, 40))) for i in range(400)]
    rows = [("hot" if i % 3 else g, p, t) for i, (g, p, t) in enumerate(rows)] + [("void", 0, ""), ("void", 0, None)]
    coded = [(g, p, None if t is None else sketch.encoded(sketch.sketch(t)), "clash", 5) for g, p, t in rows]
    frame = spark.createDataFrame(coded, "g string, p int, fingerprint string, _s string, n int").repartition(7)
    want = {}
    for g, p, t in rows:
        old, n = want.get((g, p), (sketch.sketch(""), 0))
        want[g, p] = sketch.merge(old, sketch.sketch(t or "")), n + 1
    for held in (4096, 1):
        monkeypatch.setattr(sketch, "HELD", held)
        got = sketch.merged(frame, ["g", "p"])
        assert got.columns == ["g", "p", "fingerprint", "n", "distinct_shingles"]
        rows_of = {(r["g"], r["p"]): (r["fingerprint"], r["n"], r["distinct_shingles"]) for r in got.collect()}
        assert set(rows_of) == set(want)
        for k, (s, n) in want.items():
            assert rows_of[k][:2] == (sketch.encoded(s), n) and abs(rows_of[k][2] - sketch.distinct(s)) < 1e-3
    assert sketch.merged(frame.limit(0), ["g"]).count() == 0


def test_merged_parts_are_the_whole(spark):
    """The sketch of a text's overlapping parts is the text's; the estimate is near its shingles' number."""
    text = words(random.Random(4), 3000)
    step = 700
    parts = [(1, sketch.encoded(sketch.sketch(text[i : i + step + sketch.SHINGLE - 1]))) for i in range(0, len(text) - sketch.SHINGLE + 1, step)]
    (got,) = sketch.merged(spark.createDataFrame(parts, "g int, fingerprint string"), ["g"]).collect()
    assert got["fingerprint"] == sketch.encoded(sketch.sketch(text)) and got["n"] == len(parts)
    assert abs(got["distinct_shingles"] / len(exact(text)) - 1) < 0.3


def test_compared(spark):
    rng = random.Random(5)
    a = [words(rng, n) for n in (0, 2, 30, 500)]
    pairs = [(x, y) for x in a for y in [*a, x + " " + words(rng, 20), None]]
    code = lambda t: None if t is None else sketch.encoded(sketch.sketch(t))
    frame = spark.createDataFrame([(i, code(x), code(y), 1) for i, (x, y) in enumerate(pairs)], "i int, s string, t string, distinct_a int")
    got = {r["i"]: r for r in sketch.compared(frame, "s", "t").collect()}
    assert sketch.compared(frame, "s", "t").columns == ["i", "s", "t", "resemblance", "contained_a", "contained_b", "distinct_a", "distinct_b"]
    for i, (x, y) in enumerate(pairs):
        s, t = sketch.sketch(x), sketch.sketch(y or "")
        want = (sketch.resemblance(s, t), sketch.containment(s, t), sketch.containment(t, s), sketch.distinct(s), sketch.distinct(t))
        assert tuple(got[i])[3:] == pytest.approx(want)
        u, v = exact(x), exact(y or "")
        if u and v and len(u | v) < sketch.K:
            assert got[i]["resemblance"] == pytest.approx(len(u & v) / len(u | v)) and got[i]["contained_a"] == pytest.approx(len(u & v) / len(u))
    assert sketch.compared(frame.limit(0), "s", "t").count() == 0

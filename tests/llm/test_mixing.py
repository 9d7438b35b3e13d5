"""Mixing: sizes and targets against plain code, taken words near targets, whole copies, repeatability."""

import random
import re

from ledgerloom.llm import mixing, registry
from tests.compare import same

DOCS = "doc_id long, text string, source string, size string, target string, rank int, weight double"


def plain_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """Shares again and again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def examine(rows, got, near):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(got) == len(rows)
    sums, taken = {}, {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    goal = plain_targets(sums)
    sources = {}
    for i, text, source in rows:
        sources.setdefault((i, size(text)), []).append(source)
    for r in got:
        assert r["source"] in sources[r["doc_id"], r["size"]]
        assert r["source_size"] == sums[r["source"]] and abs(r["target"] - goal[r["source"]]) <= 1e-9 * max(1, goal[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sums:
        largest = max(size(t) for _, t, x in rows if x == s)
        assert abs(taken[s] - goal[s]) <= max(near * goal[s], largest / 2 + 1), (s, taken[s], goal[s])


def corpus(n, seed=1):
    rng = random.Random(seed)
    sources = ["b", "a", "é", "zz", None, "𐀀", "tiny"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(int(rng.paretovariate(1)) * 3)), rng.choices(sources, [40, 10, 10, 10, 5, 10, 1])[0]) for i in range(n)]
    return [*rows, (None, "a null id", "a"), (5000, None, "a"), (5001, "", "a"), (5002, " \t\n", None), (5003, "x\xa0y\x0bz", "b")]


def test_targets_and_sums(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(*r, "clash", "clash", 1, 1.0) for r in rows], DOCS)
    first = mixing.mix(docs)
    examine(rows, first.collect(), 0.02)
    again = mixing.mix(docs.repartition(7, "text"))
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, first.select(*key).collect()), key=str) == sorted(map(tuple, again.select(*key).collect()), key=str)


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    for rows in ([(1, "one two three", "s")], [(1, None, None)], [(i, "same words here", "s") for i in (1, 1, 2, 2, 3)]):
        docs = spark.createDataFrame([(*r, "", "", 1, 1.0) for r in rows], DOCS)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)


def test_inclusion_is_even(spark):
    """Over many seeds, documents of a source are chosen alike, whatever their size, and weights make odds."""
    rows = [(i, "w " * (1 + i % 5), "s", "", "", 1, 4.0 if i % 2 else 1.0) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    twice, heavy = [0] * 5, 0
    for seed in range(5):
        for r in mixing.mix(docs, seed=f"{seed}:").where("copies = 2").collect():
            twice[r["doc_id"] % 5] += 1
        heavy += mixing.mix(docs, seed=f"{seed}:", doc_weight="weight").where("copies = 2 and doc_id % 2 = 1").count()
    assert all(0.34 < n / 200 < 0.66 for n in twice)
    assert heavy / 500 > 0.6


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    examine(rows, mixing.mix(registry.table(spark, sf_dir, "documents")).collect(), 0.03)
    same(registry.op5_mixing(spark, sf_dir), registry.SQL["op5_mixing"], sf_dir)

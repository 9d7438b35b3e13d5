"""SimHash: fingerprints and components against brute force."""

import random

import numpy as np
import xxhash

from ledgerloom.llm import registry, simhash

DOCS = "doc_id long, text string, fp long, component_id string"


def brute_fingerprint(text, width=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    n, root = len(fps), list(range(len(fps)))
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(n)]


def expected(rows, width=4, radius=4):
    fps = [brute_fingerprint(r[1], width) for r in rows]
    roots = brute_components(fps, radius)
    least = {k: min((r[0] for r, x in zip(rows, roots) if x == k and r[0] is not None), default=None) for k in set(roots)}
    return sorted(((r[0], f"{f:016x}", least[x]) for r, f, x in zip(rows, fps, roots)), key=str)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    got = simhash.near_duplicates(docs, **options)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def texts():
    rng = random.Random(1)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + str(rng.randrange(50)) for _ in range(rng.choice([1, 3, 5, 60, 300]))) for _ in range(40)]
    near = [t.replace("a", "A", 2) + " tail" for t in base if len(t) > 500]
    return base + near + base[:5]


def test_small(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (4, "ONE\ttwo"), (5, "one\xa0two"), (6, "Ärger É x y z"), (7, "ärger É x y z"), (5, "one\xa0two"), (None, "word " * 50_000)]
    check(spark, rows)


def test_random(spark):
    rows = list(enumerate(texts()))
    check(spark, rows)
    check(spark, rows, most=1)  # every bucket is covered again
    check(spark, rows, most=3)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_no_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == [None, None]


def test_covering():
    """Whatever 4 positions differ, some mask has none of them; each fixes half of the bits or more."""
    rng = random.Random(2)
    masks = simhash.covering(4, list(range(64)))
    assert len(masks) == 31 and all(32 <= m.bit_count() <= 34 for m in masks)
    for _ in range(3000):
        bits = sum(1 << p for p in rng.sample(range(64), 4))
        assert any(not m & bits for m in masks)
    for m in masks:
        free = [p for p in range(64) if not m >> p & 1]
        again = simhash.covering(4, free)
        assert all(64 - (m | x).bit_count() <= 16 for x in again)
        bits = sum(1 << p for p in rng.sample(free, 4))
        assert any(not x & bits for x in again)


def test_chains(spark):
    """A chain of fingerprints 4 bits apart is one component, whatever the buckets."""
    x, chain, rng = 0x0123456789ABCDEF, [], random.Random(4)
    for _ in range(60):
        chain.append(x)
        x ^= sum(1 << p for p in rng.sample(range(64), 4))
    far = [x ^ 0xFFFF_0000_FFFF_0000 for x in chain[:5]]
    fps = chain + far
    for most in (1 << 16, 2):
        frame = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
        from ledgerloom.llm.common import components

        got = {r["node"]: r["root"] for r in components(simhash.near_links(frame, 4, most)).collect()}
        roots = [got.get(simhash.signed(f), simhash.signed(f)) for f in fps]
        want = brute_components(fps, 4)
        assert [roots.index(r) for r in roots] == [want.index(r) for r in want]


def test_forest():
    x = np.array([0, 1, 3, 7, 15, 31, 2**40 + 2**41], np.uint64)
    links = list(simhash.forest(x, 1))
    assert len(links) == 5 and {abs(b.bit_count() - a.bit_count()) for a, b in links} == {1}


def test_distinct_words(spark):
    """Copies with some words changed link by their distinct words; unlike and short texts don't."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    changed = [w if i % 60 else f"x{i}" for i, w in enumerate(base)]
    other = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(5, " ".join(base)), (3, " ".join(changed)), (4, " ".join(other)), (6, "a b c"), (7, "c b a"), (8, None), (9, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, words_radius=8).collect()}
    assert got == {5: 3, 3: 3, 4: 4, 6: 6, 7: 7, 8: 8, 9: 3}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}[5] == 5


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in registry.table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op3_simhash(spark, sf_dir).collect()), key=str) == expected(rows)

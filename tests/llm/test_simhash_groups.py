"""Links of a large group of near copies: about one a member, however large the group is."""

import random

import pytest

from ledgerloom.llm import simhash
from ledgerloom.llm.common import components
from tests.llm.test_simhash import brute_components

CENTRE = 0x9E3779B97F4A7C15


def group(n, seed=7):
    rng = random.Random(seed)
    return sorted({CENTRE ^ sum(1 << p for p in range(64) if rng.random() < 0.06) for _ in range(n)})


def joined(names, links):
    got = {r["node"]: r["root"] for r in components(links).collect()}
    roots = [got.get(x, x) for x in names]
    return [roots.index(r) for r in roots]


@pytest.mark.parametrize("n, most", [(400, 1 << 16), (1600, 1 << 16), (400, 20)])
def test_links_of_near_copies(spark, n, most):
    fps = group(n)
    names = [simhash.signed(f) for f in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in names], "fp long"), 4, most)
    assert links.count() <= 1.1 * len(fps)
    want = brute_components(fps, 4)
    assert joined(names, links) == [want.index(r) for r in want]


def test_links_by_several_hashes(spark):
    """Each hash has groups of its own, and texts that share a fingerprint."""
    rng = random.Random(9)
    fps = [[rng.choice(g) for g in (group(300, 1), group(300, 2), group(300, 3), [5, CENTRE])] for _ in range(600)]
    names = [simhash.signed(rng.getrandbits(64)) for _ in fps]
    texts = spark.createDataFrame([([simhash.signed(x) for x in w], h) for w, h in zip(fps, names)], "words_fp array<long>, text_hash long")
    links = simhash.word_links(texts, 4, 4, 1 << 16)
    assert links.count() <= 1.5 * len(names)
    root = list(range(len(names)))
    for i in range(4):
        near = brute_components([w[i] for w in fps], 4)
        for j, k in enumerate(near):
            root = [root[k] if r == root[j] else r for r in root]
    assert joined(names, links) == [root.index(r) for r in root]


def test_merged_keeps_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    links = spark.createDataFrame(pairs, "a long, b long")
    want = joined(range(300), links)
    for times in (1, 3):
        fewer = simhash.merged(links, times)
        assert joined(range(300), fewer) == want and fewer.where("a = b").isEmpty() and fewer.count() <= len(set(pairs))

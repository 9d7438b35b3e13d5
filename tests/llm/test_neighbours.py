"""Neighbours: recall and scores against all inner products."""

import numpy as np

from ledgerloom.llm import neighbours, registry

VECTORS = "vec_id long, embedding array<float>, score string, rank string, block int"


def brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        best[i] = min(best.get(i, v), v)
    out = {}
    for q, v in best.items():
        if q % every == 0:
            near = sorted((-float(np.dot(v, w)), i) for i, w in best.items() if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def examine(spark, rows, k=20, every=20, least=1.0):
    frame = spark.createDataFrame([(i, v, "clash", "clash", 1) for i, v in rows], VECTORS)
    got = {}
    for r in neighbours.nearest(frame, k, every).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, k, every)
    assert set(got) == {q for q, near in want.items() if near}
    found = total = 0
    for q, near in got.items():
        near.sort()
        assert [x[0] for x in near] == list(range(1, len(near) + 1)) and len(near) == len(want[q])
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(near, near[1:]))
        found += len({x[1] for x in near} & {x[0] for x in want[q]})
        total += len(near)
        scores = dict(want[q])
        assert all(abs(scores[i] - s) < 1e-9 for _, i, s in near if i in scores)
    assert found >= least * total
    return got


def test_small(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(8) * rng.uniform(0.1, 5)]) for i in range(50)]
    rows += [(100, None), (120, []), (140, [0.0] * 8), (160, [1.0, None] + [0.0] * 6), (180, [float("nan")] * 8), (200, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (220, [1.0, 2.0]), (221, [2.0, 1.0]), (40, rows[40][1]), (20, [9.0] * 8)]
    rows += [(i, rows[3][1]) for i in range(300, 310)]
    examine(spark, rows)


def test_few_candidates(spark):
    examine(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5])])
    examine(spark, [(0, [1.0])])
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).count() == 0


def test_recall_of_unequal_lengths(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 32))
    x = centres[rng.integers(0, 12, 6000)] + rng.standard_normal((6000, 32)) * 0.7
    x *= rng.uniform(0.5, 1.5, (6000, 1))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    examine(spark, rows, every=200, least=0.9)


def test_blocks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(rng.standard_normal((300, 8)))]
    one = examine(spark, rows)
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 4)
    assert examine(spark, rows) == one


def test_candidates_follow_collisions():
    """Verified vectors are those that collide often enough, not all; wider windows verify more."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((8000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = neighbours.Index(x, np.arange(8000), 20)
    ((near, _, verified),) = index.search(x[:1], np.array([0]))
    assert 0 not in near and 20 <= verified < 0.5 * 8000
    (only,) = index.ranges
    at = only.projected(x[:1])[0]
    narrow, wide = only.colliding(at, 1.0), only.colliding(at, 2.0)
    assert narrow.sum() < wide.sum() and not (narrow & ~wide).any()
    misses = (np.abs(only.sorted - at[:, None]) > 1.0).sum()
    assert misses and only.colliding(at, 100.0).all()


def test_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], list(r["embedding"])) for r in registry.table(spark, sf_dir, "embeddings").collect()]
    examine(spark, rows, least=0.9)

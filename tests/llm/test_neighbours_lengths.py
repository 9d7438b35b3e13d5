"""Neighbours: recall where lengths and dimensions differ, against all inner products."""

import numpy as np
import pytest

from ledgerloom.llm import neighbours

KINDS = ["one twice", "one ten times", "one thirty times", "lognormal 0.3", "lognormal 0.6", "equal", "gauss", "768", "clusters", "1e-200", "1e-310", "1e200", "mixed"]


def vectors(kind):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((3000, 768 if kind == "768" else 64))
    if kind in ("gauss", "768"):
        return x
    if kind == "clusters":
        centres = rng.standard_normal((9, 64))
        return centres[rng.integers(0, 9, 3000)] + 0.1 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind.startswith("one"):
        x[7] *= {"twice": 2, "ten": 10, "thirty": 30}[kind.split()[1]]
    elif kind.startswith("lognormal"):
        x *= rng.lognormal(0, float(kind.split()[1]), (len(x), 1))
    elif kind == "mixed":
        x[:1000] *= 1e-200
        x[1000:1500] *= 1e150
    elif kind != "equal":
        x *= float(kind)
    return x


@pytest.mark.parametrize("kind", KINDS)
def test_recall(kind):
    x = vectors(kind)
    ids = np.arange(len(x))
    found = verified = 0
    for q, (near, _, n) in zip(ids[::60], neighbours.Index(x, ids, 20).search(x[::60], ids[::60])):
        score = neighbours.products(x, x[q])
        order = np.lexsort((ids, -score))
        found += len(set(near.tolist()) & set(order[order != q][:20].tolist()))
        verified += n
    print(kind, "recall", found / 1000, "verified", verified / 50 / len(x))
    assert found >= 950


def test_order_of_blocks_and_odd_batches():
    """The task's rows: several blocks, one without queries, one without data."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    rows = [(4, 0, 0, i, x[i].tolist()) for i in range(20)] + [(4, 0, 1, i, x[i].tolist()) for i in (0, 20)]
    rows += [(4, 1, 0, i, x[i].tolist()) for i in range(20, 40)] + [(4, 2, 1, 0, x[0].tolist())]
    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64()))])
    table = pa.table([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
    got = [r for b in neighbours.block_nearest(5)(iter(table.to_batches(max_chunksize=7))) for r in b.to_pylist()]
    assert [r["query_id"] for r in got] == [0] * 5 + [20] * 5 and not [r for r in got if r["query_id"] == r["vec_id"]]

"""Mixing: repeated and null ids meet their source's target as others do; inclusion is as unequal as weights make it."""

from collections import Counter

import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import mixing, registry
from tests.compare import TABLES, same

DOCS = "doc_id long, text string, source string"


def examine(spark, rows, most_miss=10, **options):
    got = mixing.mix(spark.createDataFrame(rows, DOCS).repartition(5), **options).collect()
    taken, goal = Counter(), {}
    for r in got:
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    for s, t in goal.items():
        assert abs(taken[s] - t) <= most_miss / 2 + 1, (s, taken[s], t)
    return sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got), key=str)


@pytest.mark.parametrize("ids", [lambda i: 7, lambda i: None, lambda i: i % 10, lambda i: i if i % 3 else None])
def test_repeated_ids_meet_the_target(spark, ids):
    ten = "w " * 10
    rows = [(i, ten, "a") for i in range(100)] + [(ids(i), ten, "b") for i in range(100)] + [(1000 + i, ten, "c") for i in range(100)]
    once = examine(spark, rows)
    if ids(0) is None:
        assert once == examine(spark, rows[::-1])


def test_alike_documents_of_many_tasks(spark, monkeypatch):
    """Rounds of a document at a time, and ties that lie in several tasks."""
    rows = [(None, "w " * (1 + i % 3), s) for i in range(300) for s in ("a", None)] + [(5, "w " * 50, "a")] * 4
    want = examine(spark, rows, 50)
    monkeypatch.setattr(mixing, "SPAN", 1)
    assert examine(spark, rows, 50) == want


def test_sql_agrees_on_repeated_and_null_ids(spark, tmp_path):
    rows = [(None if i % 4 == 0 else i // 3, "w " * (i * i % 97), ("x", "y", "é", None)[i % 7 % 4]) for i in range(400)]
    rows += [(i, None, "x") for i in range(3)] + [(9, "w " * 5000, "y"), (9, "w " * 5000, "y"), (None, "w", "alone")]
    table = spark.createDataFrame(rows, DOCS).toArrow()
    for name in TABLES:
        pq.write_table(table, tmp_path / f"{name}.parquet")
    same(registry.op5_mixing(spark, str(tmp_path)), registry.SQL["op5_mixing"], str(tmp_path))


def test_inclusion_grows_with_the_weight(spark):
    """Over seeds, copies of documents are near level * weight, at most 2."""
    rows = [(i, "w " * 20, "s") for i in range(400)]
    seen = Counter()
    for seed in range(4):
        for r in mixing.mix(spark.createDataFrame(rows, DOCS), share=0.9, seed=f"{seed}:", doc_weight=(mixing.F.col("doc_id") % 4 + 1)).collect():
            seen[r["doc_id"] % 4] += r["copies"] / 400
    # expected words: 100 * 20 * level * (1 + 2 + 3 + 4) = 0.9 * 8000
    assert all(abs(seen[w - 1] - 0.36 * w) < 0.08 for w in (1, 2, 3, 4))


def test_rows_are_repeated_with_all_their_columns(spark):
    rows = [(i % 50 if i % 5 else None, "w " * (i % 40), "s" if i % 3 else None, f"x{i}", 1, 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, n long, _k int")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    by_mix = Counter()
    for r in mixing.mix(docs).collect():
        by_mix[r["doc_id"], r["source"], r["size"]] += r["copies"]
    by_rows = Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got.collect())
    assert by_rows == Counter({k: n for k, n in by_mix.items() if n})
    assert max(Counter(r["copies"] for r in got.collect()).values()) <= 2
    assert mixing.repeated(docs.limit(0)).count() == 0

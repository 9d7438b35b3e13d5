"""Merging: the decision table row by row, and algebraic properties of the winner."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lists, merge, versions, writes

RECORD = "id string, ledger_id long, updated_at long, device_id string, content_hash string, deleted_at long"
T0 = 1_758_000_000_000


def record(i, at=T0, device="a", content="x", deleted=None):
    return (i, 1, at, device, content, deleted)


def decide(spark, remote, local, **options):
    r, l = spark.createDataFrame([remote], RECORD), spark.createDataFrame([local] if local else [], RECORD)
    d = merge.decide(r, l, **options).first()
    return d["outcome"], d["rule"], d["conflict_kind"], d["write"]


CONVERGE = {"strategy": "converge"}
LWW = CONVERGE | {"delete_edit": "edit_wins_by_lww"}
TABLE = [
    (record("1"), None, {"mode": "supplement_only"}, ("insert", "fill_only_new", None, "INSERT")),
    (record("1", deleted=5), None, {"mode": "supplement_only"}, ("insert_tombstone", "fill_only_new", None, "INSERT")),
    (record("1"), record("1"), {"mode": "supplement_only"}, ("skip", "fill_only_existing", None, None)),
    (record("1"), None, {"mode": "replace"}, ("insert", "overwrite_by_file", None, "INSERT")),
    (record("1", deleted=5), record("1"), {"mode": "replace"}, ("mark_deleted", "overwrite_tombstone", None, "UPDATE")),
    (record("1"), record("1"), {"mode": "replace"}, ("update", "overwrite_by_file", None, "UPDATE")),
    (record("1"), None, {}, ("insert", "local_missing", None, "INSERT")),
    (record("1", deleted=5), None, {}, ("insert_tombstone", "local_missing_tombstone", None, "INSERT")),
    (record("1", at=T0 + 9), record("1"), {}, ("skip", "identical_content", None, None)),
    (record("1", content="y"), record("1"), {}, ("conflict", "abort_on_divergence", 1, None)),
    (record("1", content="y", deleted=5), record("1"), {}, ("conflict", "abort_on_divergence", 2, None)),
    (record("1", at=T0 + 9), record("1"), CONVERGE, ("skip", "identical_content", None, None)),
    (record("1", content="y", deleted=5), record("1", deleted=6), CONVERGE, ("skip", "both_deleted", None, None)),
    (record("1", content="y", deleted=5), record("1", at=T0 - 1), CONVERGE, ("mark_deleted", "tombstone_wins", None, "UPDATE")),
    (record("1", content="y"), record("1", at=T0 + 1, deleted=5), CONVERGE, ("skip", "tombstone_wins", None, None)),
    (record("1", content="y"), record("1", at=T0 - 1, deleted=5), CONVERGE, ("conflict", "delete_vs_edit", 2, "UPDATE")),
    (record("1", content="y", deleted=5), record("1", at=T0 + 1), CONVERGE, ("conflict", "delete_vs_edit", 2, None)),
    (record("1", content="y"), record("1", at=T0 - 1, deleted=5), LWW, ("resurrect", "delete_vs_edit_lww", None, "UPDATE")),
    (record("1", content="y", deleted=5), record("1", at=T0 + 1), LWW | {"parity": False}, ("resurrect", "delete_vs_edit_lww", None, None)),
    (record("1", content="y"), record("1"), CONVERGE, ("conflict", "stamp_collision", 1, "UPDATE")),
    (record("1", content="w"), record("1"), CONVERGE, ("conflict", "stamp_collision", 1, None)),
    (record("1", at=T0 + 59_999, content="y"), record("1"), CONVERGE, ("conflict", "ambiguous_window", 1, "UPDATE")),
    (record("1", at=T0 + 60_000, content="y"), record("1"), CONVERGE, ("update", "remote_newer", None, "UPDATE")),
    (record("1", at=T0 - 60_000, content="y"), record("1"), CONVERGE, ("skip", "local_newer", None, None)),
]


@pytest.mark.parametrize("row", range(len(TABLE)))
def test_table(spark, row):
    remote, local, options, expected = TABLE[row]
    assert decide(spark, remote, local, **options) == expected


def test_bad_options(spark):
    with pytest.raises(ValueError):
        decide(spark, record("1"), None, mode="other")


def test_converges_from_both_sides(spark):
    """Two replicas that take each other's records end in the same state, and a second merge changes nothing."""
    rng = random.Random(3)
    def side(device):
        return [record(str(i), T0 + rng.randrange(4) * 100_000, device, rng.choice("pqr"), rng.choice([None, None, T0])) for i in range(60) if rng.random() < 0.8]
    a, b = (spark.createDataFrame(side(d), RECORD) for d in "ab")
    def taken(local, remote):
        return merge.next_state(local, remote, merge.decide(remote, local, strategy="converge"))
    ab, ba = taken(a, b), taken(b, a)
    key = ["id", "content_hash"]
    alive = lambda df: sorted(map(tuple, df.where("deleted_at is null").select(*key).collect()))
    assert alive(ab) == alive(ba)
    assert sorted(map(tuple, taken(ab, b).collect())) == sorted(map(tuple, ab.collect()))


VERSION = "id string, version_stamp string, device_id string, content_hash string, deleted boolean"


def test_reduce_ignores_order(spark):
    rng = random.Random(5)
    rows = [(str(i % 40), f"{rng.randrange(4):010d}{rng.randrange(2):016d}", rng.choice("ab"), rng.choice("xyz"), rng.random() < 0.1) for i in range(400)]
    results = set()
    for n in (1, 3):
        rng.shuffle(rows)
        got = versions.reduce_versions(spark.createDataFrame(rows, VERSION).repartition(n))
        results.add(tuple(sorted(map(tuple, got.collect()))))
    assert len(results) == 1
    for i, stamp, content, deleted, n, review in results.pop():
        own = [r for r in rows if r[0] == i]
        assert (stamp, content, deleted) == max((r[1], r[3], r[4]) for r in own) and n == len(own)
        assert review == (len({r[3] for r in own if r[1][:10] == stamp[:10]}) > 1)


def test_resolve(spark):
    v = lambda stamp, content, device="a", deleted=False: (stamp, device, content, deleted)
    kind = "struct<version_stamp:string,device_id:string,content_hash:string,deleted:boolean>"
    a, b = "0000000001" + "0" * 16, "0000000001" + "1" * 16
    c = "0000000002" + "0" * 16
    rows = [("1", v(a, "x"), v(a, "x")), ("2", v(a, "x"), v(c, "x")), ("3", v(a, "x"), v(a, "y")), ("4", v(a, "y"), v(a, "x")), ("5", v(b, "x"), v(a, "y")), ("6", v(a, "x"), v(c, "y")), ("7", v(a, "x"), v(a, "x", "b"))]
    got = versions.resolve(spark.createDataFrame(rows, f"id string, local {kind}, remote {kind}")).orderBy("id")
    assert [tuple(r) for r in got.select("side", "reason", "needs_review", "is_noop").collect()] == [
        ("none", "identical", False, True),
        ("remote", "metadata_only", False, False),
        ("remote", "stamp_collision", True, False),
        ("local", "stamp_collision", True, False),
        ("local", "newer_stamp", True, False),
        ("remote", "newer_stamp", False, False),
        ("remote", "metadata_only", False, False),
    ]


def test_guards_and_counters(spark):
    remote = spark.createDataFrame([record("1", content="y"), record("2")], RECORD)
    local = spark.createDataFrame([record("1"), record("3")], RECORD)
    d = merge.decide(remote, local)
    with pytest.raises(ValueError, match="conflicts"):
        merge.guard(d)
    gone = merge.removals(local, remote, 1)
    assert [r["id"] for r in gone.collect()] == ["3"]
    with pytest.raises(ValueError, match="removed"):
        merge.guard(d, gone, "converge")
    merge.guard(d, gone, "converge", True)
    assert merge.counters(d).first().asDict() == {"inserted": 1, "updated": 0, "skipped": 0, "conflicts": 1, "records": 2}
    queue = merge.conflicts(remote, local, d, "job", "account", T0).collect()
    assert len(queue) == 1 and len(queue[0]["conflict_id"]) == 26 and '"deleted":false' in queue[0]["local_json"]
    assert merge.duplicates(remote.union(remote)).count() == 2


def test_lists_and_writes(spark):
    rows = spark.createDataFrame([("1", 1, None), ("2", 1, 5)], "id string, rev int, deleted_at long")
    state, refused = writes.update(rows, spark.createDataFrame([("1", 9, None), ("2", 9, None), ("3", 9, None)], rows.schema))
    assert sorted(map(tuple, state.collect())) == [("1", 2, None), ("2", 1, 5)]
    assert sorted(map(tuple, refused.collect())) == [("2", "deleted"), ("3", "missing")]
    state, refused = writes.soft_delete(rows, rows.select("id"), 77, rows.where("id = '9'"))
    assert sorted(map(tuple, state.collect())) == [("1", 2, 77), ("2", 1, 5)] and refused.isEmpty()
    meta = spark.createDataFrame([("k", "v")], "key string, value string")
    assert sorted(map(tuple, lists.put_if_absent(meta, spark.createDataFrame([("k", "w"), ("m", "n")], meta.schema)).collect())) == [("k", "v"), ("m", "n")]
    assert lists.by_id(rows, "2").count() == 1 and lists.batch(rows, rows.union(rows)).count() == 2
    assert [r["id"] for r in lists.account_list(rows.withColumn("sort_order", F.lit(1))).collect()] == ["1"]

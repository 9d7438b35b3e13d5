"""Create rules, the time of last activity, hot accounts, null-heavy references, the store's manifest, entries."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balance, checks, lists, repair, writes
from ledgerloom.sources import store
from tests.test_balance import TXN, txn


def test_create_ledgers(spark):
    schema = "id string, code string, is_default int, deleted_at long"
    state = spark.createDataFrame([("L1", "A", 1, None), ("L2", "B", 0, 5)], schema)
    new = spark.createDataFrame([("L1", "X", 0, None), ("L3", "B", 0, None), ("L4", "D", 1, None), ("L5", "E", 0, None), ("L6", "F", 1, 9)], schema)
    after, refused = writes.create_ledgers(state, new)
    assert {r["id"]: r["violation"] for r in refused.collect()} == {"L1": "duplicate_id", "L3": "not_unique", "L4": "second_default"}
    assert sorted(r["id"] for r in after.collect()) == ["L1", "L2", "L5", "L6"]
    after, refused = writes.create_ledgers(state.limit(0), spark.createDataFrame([("L4", "D", 1, None), ("L5", "E", 1, None)], schema))
    assert {r["id"] for r in after.collect()} == {"L4"} and refused.first()["violation"] == "second_default"


def test_create_categories(spark):
    schema = "id string, parent_id string, ledger_id string, kind int, deleted_at long"
    state = spark.createDataFrame([("R", None, "L", 1, None), ("K", "R", "L", 1, None), ("D", None, "L", 1, 3)], schema)
    new = spark.createDataFrame([("a", "R", "L", 1, None), ("b", "K", "L", 1, None), ("c", "D", "L", 1, None), ("d", "none", "L", 1, None), ("e", "e", "L", 1, None), ("f", "R", "M", 1, None), ("g", "R", "L", 2, None), ("h", None, "L", 2, None)], schema)
    after, refused = writes.create_categories(state, new)
    assert {r["id"]: r["violation"] for r in refused.collect()} == {"b": "too_deep", "c": "parent_deleted", "d": "parent_missing", "e": "own_parent", "f": "parent_of_other_ledger", "g": "parent_kind"}
    assert {r["id"] for r in after.collect()} == {"R", "K", "D", "a", "h"}


def test_create_txns(spark):
    schema = TXN + ", category_id string"
    accounts = spark.createDataFrame([("A", "CNY", None), ("B", "CNY", 4)], "id string, currency string, deleted_at long")
    categories = spark.createDataFrame([("C", 1, None)], "id string, kind long, deleted_at long")
    rows = [(*txn("1", 1, 5, "A"), "C"), (*txn("2", 1, 0, "A"), "C"), (*txn("3", 1, 5, "B"), "C"), (*txn("4", 1, 5, "A"), "gone"), (*txn("5", 2, 5, "A"), "C"), (*txn("6", 3, 5, "A", "nobody"), None)]
    after, refused = writes.create_txns(spark.createDataFrame([], schema), spark.createDataFrame(rows, schema), accounts, categories)
    assert {r["id"]: r["violation"] for r in refused.collect()} == {"2": "amount", "3": "account_deleted", "4": "category_missing", "5": "category_kind", "6": "target_missing"}
    assert [r["id"] for r in after.collect()] == ["1"]


def test_last_activity_may_go_back(spark):
    accounts = spark.createDataFrame([("A", 10, 9), ("B", 0, 3), ("C", 5, 2)], "id string, cached_balance_minor long, balance_as_of long")
    everything = [txn("1", 2, 10, "A", at=4), txn("2", 2, 7, "A", at=9), txn("3", 1, 5, "C", at=2)]
    before = spark.createDataFrame(everything[1:2], TXN)
    after = spark.createDataFrame([txn("2", 2, 7, "A", at=9, deleted=1), txn("9", 3, 1, "A", "B", at=3)], TXN)
    txns = spark.createDataFrame([everything[0], everything[2], txn("2", 2, 7, "A", at=9, deleted=1), txn("9", 3, 1, "A", "B", at=3)], TXN)
    got = {r["id"]: (r["cached_balance_minor"], r["balance_as_of"]) for r in writes.balance_change(accounts, before, after, txns).collect()}
    assert got == {"A": (2, 4), "B": (1, 3), "C": (5, 2)}


def test_effects_are_checked(spark):
    rows = spark.createDataFrame([txn("1", 1, 5, "A"), txn("2", 9, 5, "A"), txn("3", 3, 5, "A"), txn("4", 1, -5, "A", deleted=1)], TXN)
    assert {r["id"]: r["violation"] for r in balance.effect_violations(rows).collect()} == {"2": "unknown_type", "3": "transfer_without_target"}
    with pytest.raises(Exception, match="transaction"):
        balance.delta(rows.limit(0), rows).collect()
    assert balance.legs(rows.where("id = '1'"), strict=True).count() == 1


def test_running_sums_of_a_hot_account(spark):
    day = balance.DAY_MS
    rows = [txn(f"{i:05}", 1 + i % 2, 1 + i % 7, "hot" if i % 3 else f"a{i % 5}", at=(i * 7919 % 400) * (day // 7) - day) for i in range(3000)]
    frame = spark.createDataFrame([*rows, txn("null", 1, 5, None)], TXN)
    got = {(r["txn_id"], r["account_id"]): r["running_minor"] for r in balance.running(frame).collect()}
    sums = {}
    for r in sorted(rows, key=lambda x: (x[6], x[0])):
        sums[r[4]] = sums.get(r[4], 0) + (r[2] if r[1] == 2 else -r[2])
        assert got[r[0], r[4]] == sums[r[4]]
    assert len(got) == 3001 and got["null", None] == -5


def test_null_references_are_spread(spark):
    """Of references that are mostly null no join has them all in one task."""
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 50 == 0, F.lit("k")).alias("ref"))
    other = spark.createDataFrame([("k", 1)], "ref2 string, x int").withColumn("_s", repair.gathered(F.col("ref2")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = rows.join(other, (F.col("ref") == F.col("ref2")) & (repair.spread(F.col("ref"), F.col("id")) == F.col("_s")), "left")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 8_000 and joined.where("x = 1").count() == 400
    tree = spark.range(300).select(F.concat(F.lit("c"), "id").alias("id"), F.when(F.col("id") % 3 == 1, F.concat(F.lit("c"), F.col("id") - 1)).alias("parent_id"), F.lit(None).cast("long").alias("deleted_at"))
    assert repair.promotions(tree).isEmpty()


def test_unsafe_ids_are_violations(spark):
    from ledgerloom.sources import changeset

    line = '{"type":"tag","id":"%s","ledgerId":"L","name":"n","createdAt":1,"updatedAt":1,"deletedAt":null,"deviceId":"d","rev":"x"}'
    rows = [("tag", None, line % "ok-1"), ("tag", None, line % "a b"), ("tag", None, "no json")]
    got = changeset.read_records(spark.createDataFrame(rows, "stage string, id string, line string"), "tag").collect()
    assert [r["violations"] for r in got][:2] == [["rev: no integer"], ["id: unsafe", "rev: no integer"]] and "id: missing" in got[2]["violations"]


def test_store_keeps_unchanged_tables_where_they_are(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    one, two = spark.range(5), spark.range(7)
    kept.commit({"a": one, "b": one})
    kept.commit({"b": two})
    assert kept.manifest(2) == {"a": 1, "b": 2} and not (tmp_path / "store" / "v2" / "a").exists()
    kept.drop(1)
    assert kept.versions() == [2] and kept.read("a").count() == 5 and not (tmp_path / "store" / "v1" / "b").exists()
    (tmp_path / "store" / "v9" / "a").mkdir(parents=True)  # a commit that failed half-way
    assert kept.versions() == [2] and kept.commit({"c": two}) == 10 and kept.tables() == ["a", "b", "c"]
    kept.rollback(2)
    assert kept.tables() == ["a", "b"]


def test_meta_entries(spark):
    meta = spark.createDataFrame([("b", "2"), ("a", "1"), (None, "x")], "key string, value string")
    assert [tuple(r) for r in lists.meta_list(meta).collect()] == [("a", "1"), ("b", "2")]
    first, second = "01JGFJJZ00000G40R40M30E209", "01JGFJJZ00000G40R40M30E20A"
    meta, found = lists.device_id(meta, first)
    assert found == first and lists.device_id(meta, second)[1] == first
    with pytest.raises(ValueError):
        lists.device_id(meta, "no")


def test_checks_reference_nulls(spark):
    txns = spark.createDataFrame([(i, 1, "CNY", 1, None, None, None) for i in range(50)], "id long, type long, currency string, account_id long, to_account_id long, category_id string, deleted_at long")
    accounts = spark.createDataFrame([(1, "CNY", None)], "id long, currency string, deleted_at long")
    assert checks.reference_violations(txns, accounts, spark.createDataFrame([], "id string, kind long, deleted_at long")).isEmpty()

"""References: orphan rules, placeholders, category trees."""

from ledgerloom.operators import checks, repair


def test_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9)], "id long, ledger_id long")
    got = repair.orphans({"ledger": parent, "account": child}).collect()
    assert [tuple(r) for r in got] == [("account.ledger_id", 1)]
    assert repair.orphan_rows(child, parent, "ledger_id", True).count() == 1
    assert repair.orphan_rows(child, parent.limit(0), "ledger_id", True).count() == 3
    assert repair.orphan_rows(child, parent.limit(0), "ledger_id").count() == 2


def test_promotions(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None, None) for i in range(12)]
    rows = [*chain, ("self", "self", None), ("a", "b", None), ("b", "a", None), ("lost", "nobody", None), ("kid", "dead", None), ("dead", None, 5), ("into", "a", None)]
    tree = spark.createDataFrame(rows, "id string, parent_id string, deleted_at long")
    got = {r["id"]: r["reason"] for r in repair.promotions(tree).collect()}
    assert got == {"c9": "too_deep", "c10": "too_deep", "c11": "too_deep", "self": "cycle", "a": "cycle", "b": "cycle", "lost": "missing", "kid": "deleted", "into": "cycle"}
    assert repair.promote(tree).where("parent_id is not null").count() == 8


def test_placeholders(spark):
    txns = spark.createDataFrame([(2, 1, "CNY", 1, 9, 8, "cat-long-name"), (1, 3, "USD", 2, 9, None, "cat-long-name")], "id long, ledger_id long, currency string, type long, account_id long, to_account_id long, category_id string")
    accounts = spark.createDataFrame([(5, 1, "CNY", 7), (7, 1, "CNY", None)], "id long, ledger_id long, currency string, repay_account_id long")
    got = {r["id"]: (r["ledger_id"], r["currency"], r["is_archived"]) for r in repair.placeholder_accounts(txns, accounts, "d", 1).collect()}
    assert got == {9: (3, "USD", 1), 8: (1, "CNY", 1)}
    cats = repair.placeholder_categories(txns, spark.createDataFrame([], "id string"), "d", 1).collect()
    assert [(r["id"], r["kind"], r["name"]) for r in cats] == [("cat-long-name", 2, "missing ong-name")]


def test_checks(spark):
    ids = spark.createDataFrame([("ok_1-A",), ("",), ("a b",), (None,), ("x" * 65,)], "id string")
    assert checks.unsafe_ids(ids).count() == 4
    counts = spark.createDataFrame([("a", 1), ("b", 2)], "type string, n long")
    other = spark.createDataFrame([("a", 1), ("c", 3)], "type string, n long")
    assert sorted(map(tuple, checks.count_mismatches(counts, other).collect())) == [("b", 0, 2), ("c", 3, 0)]

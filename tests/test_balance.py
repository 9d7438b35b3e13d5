"""Balances: fixed cases, and incremental against full recomputation on random edits."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balance

ACCOUNT = "id string, opening_balance_minor long, ledger_id long, credit_limit_minor long, deleted_at long"
TXN = "id string, type long, amount_minor long, fee_minor long, account_id string, to_account_id string, occurred_at long, excluded_from_stats int, currency string, deleted_at long"


def txn(i, kind, amount, account, to=None, fee=0, at=1, excluded=0, currency="CNY", deleted=None):
    return (i, kind, amount, fee, account, to, at, excluded, currency, deleted)


def run(spark, accounts, txns):
    a = spark.createDataFrame([(i, o, 1, None, None) for i, o in accounts], ACCOUNT)
    t = spark.createDataFrame(txns, TXN)
    got = {r["id"]: (r["balance_minor"], r["balance_as_of"]) for r in balance.balances(a, t).collect()}
    return got, balance.summary(t).first().asDict()


CASES = {
    "expense and income": ([("A", 100000)], [txn("1", 1, 3500, "A", at=5), txn("2", 2, 20000, "A", at=9)], {"A": (116500, 9)}, (20000, 3500, 0, 0)),
    "transfer with fee": ([("A", 100000), ("B", 0)], [txn("1", 3, 10000, "A", "B", 200)], {"A": (89800, 1), "B": (10000, 1)}, (0, 200, 10000, 200)),
    "credit card": ([("A", 100000), ("C", 0)], [txn("1", 1, 3500, "C"), txn("2", 3, 1000, "A", "C")], {"A": (99000, 1), "C": (-2500, 1)}, (0, 3500, 1000, 0)),
    "deleted": ([("A", 50000)], [txn("1", 1, 3500, "A", deleted=7)], {"A": (50000, 0)}, (0, 0, 0, 0)),
    "excluded": ([("A", 1000)], [txn("1", 1, 700, "A", excluded=1)], {"A": (300, 1)}, (0, 0, 0, 0)),
    "unknown account": ([], [txn("1", 2, 700, "X")], {"X": (700, 1)}, (700, 0, 0, 0)),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    accounts, txns, expected, sums = CASES[name]
    got, summary = run(spark, accounts, txns)
    assert got == expected
    assert tuple(summary[k] for k in ("income_minor", "expense_minor", "transfer_minor", "fee_minor")) == sums
    assert summary["currency"] == "CNY"


def test_several_currencies(spark):
    rows = spark.createDataFrame([txn("1", 1, 5, "A"), txn("2", 1, 5, "A", currency="USD")], TXN)
    with pytest.raises(Exception, match="several currencies"):
        balance.summary(rows).collect()


def test_effect_errors(spark):
    rows = [txn("1", 1, 0, "A"), txn("2", 1, 5, "A", fee=-1), txn("3", 2, 5, "A", fee=1), txn("4", 3, 5, "A"), txn("5", 9, 5, "A"), txn("6", 3, 5, "A", "B", 1)]
    got = [r[0] for r in spark.createDataFrame(rows, TXN).orderBy("id").select(balance.effect_error()).collect()]
    assert got == ["amount_not_positive", "negative_fee", "fee_on_non_transfer", "transfer_without_target", "unknown_type", None]


def test_incremental_is_full(spark):
    """A thousand operations on five accounts: after each hundred, the changes add up to a recomputation."""
    rng, state, names = random.Random(7), {}, list("ABCDE")
    accounts = spark.createDataFrame([(n, 1000 * i, 1, None, None) for i, n in enumerate(names)], ACCOUNT)
    cached = {n: 1000 * i for i, n in enumerate(names)}
    for step in range(10):
        before = dict(state)
        for k in range(100):
            x = rng.random()
            if x < 0.2 and state:
                state.pop(rng.choice(sorted(state)))
            else:
                key = rng.choice(sorted(state)) if x < 0.4 and state else f"{step}-{k}"
                kind = rng.choices([1, 2, 3], [45, 30, 25])[0]
                a, b = rng.sample(names, 2)
                state[key] = txn(key, kind, rng.randint(1, 9999), a, b if kind == 3 else None, rng.randint(0, 9) if kind == 3 else 0, at=step * 100 + k)
        if step % 3 == 0 or step == 9:
            frame = lambda s: spark.createDataFrame(list(s.values()), TXN)
            for r in balance.delta(frame(before), frame(state)).collect():
                cached[r["id"]] += r["delta"]
            full = {r["id"]: r["balance_minor"] for r in balance.balances(accounts, frame(state)).collect()}
            assert cached == full
        else:
            frame = lambda s: spark.createDataFrame(list(s.values()), TXN)
            for r in balance.delta(frame(before), frame(state)).collect():
                cached[r["id"]] += r["delta"]


def test_apply_changes_nothing_else(spark):
    accounts = spark.createDataFrame([("A", 5, 1, 100, None), ("B", 7, 1, None, 3)], ACCOUNT)
    txns = spark.createDataFrame([txn("1", 1, 5, "A", at=4)], TXN)
    got = balance.apply_balances(accounts, txns)
    assert got.drop("cached_balance_minor", "balance_as_of").exceptAll(accounts).isEmpty()
    assert balance.net_worth(got).first()[0] == 0
    credit = balance.available_credit(got.withColumn("cached_balance_minor", F.lit(-30).cast("long"))).collect()
    assert [tuple(r) for r in credit] == [("A", 70, 30)]
    assert balance.apply_balances(accounts.limit(0), txns).count() == 0

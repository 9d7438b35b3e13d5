"""Validation of records as violation rows; nothing is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.repair import gathered, spread

#: The longest id, and what it is made of.
ID_PATTERN = "^[0-9A-Za-z_-]{1,64}$"
#: Fixed value: how far in the future a record's time may lie without a warning.
AHEAD_MS = 24 * 3600 * 1000


def shape_error(entity_rules: bool = True) -> Column:
    """What is wrong with a transaction's shape, or null; without entity_rules a fee on a non-transfer is allowed."""
    move = F.col("type") == 3
    out = (
        F.when(~F.coalesce(F.col("type").isin(1, 2, 3), F.lit(False)), "type")
        .when(~F.coalesce(F.col("amount_minor") > 0, F.lit(False)), "amount")
        .when(F.col("fee_minor") < 0, "fee")
        .when(move & F.col("to_account_id").isNull(), "transfer_needs_target")
        .when(move & (F.col("to_account_id") == F.col("account_id")), "transfer_to_itself")
        .when(move & F.col("category_id").isNotNull(), "transfer_with_category")
        .when(~move & F.col("category_id").isNull(), "category_missing")
        .when(~move & F.col("to_account_id").isNotNull(), "target_on_non_transfer")
    )
    return out.when(~move & (F.col("fee_minor") > 0), "fee_on_non_transfer") if entity_rules else out


def shape_violations(txns: DataFrame, entity_rules: bool = True) -> DataFrame:
    return txns.select("id", shape_error(entity_rules).alias("violation")).where("violation is not null")


def reference_violations(txns: DataFrame, accounts: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, violation): accounts and categories that a live transaction names and that are missing, deleted, of another
    currency or of the other direction. The first that applies, in this order. Transactions without target or category
    are spread over all tasks."""
    a = accounts.select(F.col("id").alias("a_id"), F.col("currency").alias("a_currency"), F.col("deleted_at").alias("a_gone"))
    b = accounts.select(F.col("id").alias("b_id"), F.col("currency").alias("b_currency"), F.col("deleted_at").alias("b_gone"), gathered(F.col("id")).alias("b_spread"))
    c = categories.select(F.col("id").alias("c_id"), F.col("kind").alias("c_kind"), F.col("deleted_at").alias("c_gone"), gathered(F.col("id")).alias("c_spread"))
    rows = txns.where("deleted_at is null").join(a, F.col("account_id") == F.col("a_id"), "left")
    rows = rows.join(b, (F.col("to_account_id") == F.col("b_id")) & (spread(F.col("to_account_id"), F.col("id")) == F.col("b_spread")), "left")
    rows = rows.join(c, (F.col("category_id") == F.col("c_id")) & (spread(F.col("category_id"), F.col("id")) == F.col("c_spread")), "left")
    target, kind = F.col("to_account_id").isNotNull(), F.col("category_id").isNotNull()
    bad = (
        F.when(F.col("a_id").isNull(), "account_missing")
        .when(F.col("a_gone").isNotNull(), "account_deleted")
        .when(F.col("a_currency") != F.col("currency"), "account_currency")
        .when(target & F.col("b_id").isNull(), "target_missing")
        .when(target & F.col("b_gone").isNotNull(), "target_deleted")
        .when(target & (F.col("b_currency") != F.col("currency")), "target_currency")
        .when(kind & F.col("c_id").isNull(), "category_missing")
        .when(kind & F.col("c_gone").isNotNull(), "category_deleted")
        .when(kind & (F.col("c_kind") != F.col("type")), "category_kind")
    )
    return rows.select("id", bad.alias("violation")).where("violation is not null")


def account_blockers(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """(id, n_txns): live accounts that live transactions name on either leg, which can't be deleted."""
    legs = txns.where("deleted_at is null").select("id", F.explode(F.array_distinct(F.array_compact(F.array("account_id", "to_account_id")))).alias("account"))
    used = legs.groupBy("account").agg(F.count("*").alias("n_txns"))
    return accounts.where("deleted_at is null").join(used, F.col("id") == F.col("account")).select("id", "n_txns")


def category_blockers(categories: DataFrame, txns: DataFrame) -> DataFrame:
    """(id, n_children, n_txns): live categories with live children or transactions."""
    kids = categories.where("deleted_at is null and parent_id is not null").groupBy(F.col("parent_id").alias("k")).agg(F.count("*").alias("n_children"))
    used = txns.where("deleted_at is null and category_id is not null").groupBy(F.col("category_id").alias("t")).agg(F.count("*").alias("n_txns"))
    rows = categories.where("deleted_at is null").join(kids, F.col("id") == F.col("k"), "left").join(used, F.col("id") == F.col("t"), "left")
    return rows.select("id", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_txns", F.lit(0)).alias("n_txns")).where("n_children + n_txns > 0")


def ledger_blockers(ledgers: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(id, n): live ledgers with live rows in any of the child tables."""
    rows = None
    for child in children.values():
        part = child.where("deleted_at is null").groupBy("ledger_id").agg(F.count("*").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    used = rows.groupBy("ledger_id").agg(F.sum("n").alias("n"))
    return ledgers.where("deleted_at is null").join(used, F.col("id") == F.col("ledger_id")).select("id", "n")


def parent_errors(categories: DataFrame) -> DataFrame:
    """(id, violation): parents that are missing, deleted, of the other direction, of another ledger, or no roots."""
    p = categories.select(F.col("id").alias("p_id"), F.col("kind").alias("p_kind"), F.col("ledger_id").alias("p_ledger"), F.col("parent_id").alias("p_parent"), F.col("deleted_at").alias("p_gone"))
    rows = categories.where("parent_id is not null").join(p, F.col("parent_id") == F.col("p_id"), "left")
    bad = (
        F.when(F.col("parent_id") == F.col("id"), "own_parent")
        .when(F.col("p_id").isNull(), "parent_missing")
        .when(F.col("p_gone").isNotNull(), "parent_deleted")
        .when(F.col("p_ledger") != F.col("ledger_id"), "parent_of_other_ledger")
        .when(F.col("p_kind") != F.col("kind"), "parent_kind")
        .when(F.col("p_parent").isNotNull(), "too_deep")
    )
    return rows.select("id", bad.alias("violation")).where("violation is not null")


def scope_violations(records: DataFrame, ledger_ids: DataFrame) -> DataFrame:
    """Records of ledgers that a change set doesn't declare (ledger_ids: id)."""
    return records.join(ledger_ids.select(F.col("id").alias("ledger_id")).distinct(), "ledger_id", "left_anti")


def clock_warnings(records: DataFrame, now_ms: int) -> DataFrame:
    """(id, warning): records whose time is before the epoch or more than a day ahead."""
    at = F.col("updated_at")
    return records.select("id", F.when(at < 1, "before_epoch").when(at > now_ms + AHEAD_MS, "ahead").alias("warning")).where("warning is not null")


def unsafe_ids(records: DataFrame, column: str = "id") -> DataFrame:
    return records.where(~F.coalesce(F.col(column).rlike(ID_PATTERN), F.lit(False)))


def count_mismatches(observed: DataFrame, declared: DataFrame) -> DataFrame:
    """(type, declared, observed) where a change set's counts differ: both frames are (type, n)."""
    d, o = declared.select("type", F.col("n").alias("declared")), observed.select("type", F.col("n").alias("observed"))
    rows = d.join(o, "type", "full").select("type", F.coalesce("declared", F.lit(0)).alias("declared"), F.coalesce("observed", F.lit(0)).alias("observed"))
    return rows.where("declared <> observed")


def unique_violations(rows: DataFrame, columns: list[str], live_only: bool = True) -> DataFrame:
    """Groups of columns that more than one row has."""
    rows = rows.where("deleted_at is null") if live_only else rows
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")

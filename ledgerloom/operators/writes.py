"""Writes as next states: created, updated and deleted transactions, and what balances change by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.balance import legs
from ledgerloom.operators.checks import parent_errors, reference_violations, shape_error


def create(state: DataFrame, new: DataFrame, unique: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The next state and the refused rows (id, violation): rows of an id, or of unique columns, that the state has.

    new has each id once.
    """
    taken = state.select("id").withColumn("_taken", F.lit(1))
    rows = new.join(taken, "id", "left").withColumn("violation", F.when(F.col("_taken") == 1, "duplicate_id")).drop("_taken")
    if unique:
        used = state.select(*unique).distinct().withColumn("_used", F.lit(1))
        rows = rows.join(used, unique, "left").withColumn("violation", F.coalesce("violation", F.when(F.col("_used") == 1, "not_unique"))).drop("_used")
    good = rows.where("violation is null").select(*state.columns)
    return state.unionByName(good), rows.where("violation is not null").select("id", "violation")


def update(state: DataFrame, changed: DataFrame, fixed: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The next state and the refused rows (id, violation): rows that are missing, deleted, or change a fixed column.

    rev goes up by one and created_at stays, if the state has them.
    """
    old = state.select(*[F.col(c).alias(f"_{c}") for c in state.columns])
    rows = changed.join(old, F.col("id") == F.col("_id"), "left")
    bad = F.when(F.col("_id").isNull(), "missing").when(F.col("_deleted_at").isNotNull(), "deleted")
    for c in fixed:
        bad = bad.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c}_is_fixed")
    rows = rows.withColumn("violation", bad)
    good = rows.where("violation is null")
    if "rev" in state.columns:
        good = good.withColumn("rev", F.col("_rev") + 1)
    for c in ("created_at", "origin_device_id"):
        if c in state.columns:
            good = good.withColumn(c, F.col(f"_{c}"))
    good = good.select(*state.columns)
    return state.join(good.select("id"), "id", "left_anti").unionByName(good), rows.where("violation is not null").select("id", "violation")


def soft_delete(state: DataFrame, ids: DataFrame, at_ms: int, blockers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The next state and the refused ids (id, violation): missing or blocked ones. Deleting a tombstone does nothing."""
    wanted = ids.select("id").distinct()
    refused = wanted.join(state.select("id"), "id", "left_anti").withColumn("violation", F.lit("missing"))
    if blockers is not None:
        blocked = wanted.join(blockers.select("id").distinct(), "id", "left_semi")
        refused = refused.unionByName(blocked.withColumn("violation", F.lit("in_use")))
        wanted = wanted.join(blockers.select("id").distinct(), "id", "left_anti")
    go = wanted.withColumn("_go", F.lit(1))
    rows = state.join(go, "id", "left")
    now = (F.col("_go") == 1) & F.col("deleted_at").isNull()
    if "rev" in state.columns:
        rows = rows.withColumn("rev", F.when(now, F.col("rev") + 1).otherwise(F.col("rev")))
    if "updated_at" in state.columns:
        rows = rows.withColumn("updated_at", F.when(now, F.lit(at_ms)).otherwise(F.col("updated_at")))
    return rows.withColumn("deleted_at", F.when(now, F.lit(at_ms)).otherwise(F.col("deleted_at"))).select(*state.columns), refused


def balance_change(accounts: DataFrame, before: DataFrame, after: DataFrame, txns: DataFrame | None = None) -> DataFrame:
    """(id, cached_balance_minor, balance_as_of): the accounts' cached balances moved by what the change of transactions
    does. Accounts that it touches, even by nothing, get the time of their last live transaction, which may go back;
    txns are all transactions after the change (None: `after` has them all)."""
    gone = legs(before).select("account_id", (-F.col("delta")).alias("delta"), F.lit(None).cast("long").alias("at"))
    new = legs(after, strict=True).select("account_id", "delta", F.col("occurred_at").alias("at"))
    moved = gone.unionByName(new).groupBy(F.col("account_id").alias("_id")).agg(F.sum("delta").alias("_delta"), F.max("at").alias("_last"))
    if txns is not None:
        last = legs(txns).join(moved.select(F.col("_id").alias("account_id")), "account_id", "left_semi").groupBy(F.col("account_id").alias("_id")).agg(F.max("occurred_at").alias("_last"))
        moved = moved.drop("_last").join(last, "_id", "left")
    old = F.col("balance_as_of") if "balance_as_of" in accounts.columns else F.lit(0).cast("long")
    rows = accounts.join(moved, F.col("id") == F.col("_id"), "left")
    as_of = F.when(F.col("_id").isNotNull(), F.coalesce("_last", F.lit(0))).otherwise(old)
    return rows.select("id", (F.col("cached_balance_minor") + F.coalesce("_delta", F.lit(0))).alias("cached_balance_minor"), as_of.alias("balance_as_of"))


def create_ledgers(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As create(), with codes that no ledger has, tombstones included, and at most one live default."""
    rows = new.withColumn("_default", (F.col("is_default") == 1) & F.col("deleted_at").isNull())
    lots = state.where("deleted_at is null and is_default = 1").select(F.lit(True).alias("_has")).limit(1)
    first = rows.where("_default").agg(F.min("id").alias("_first"))
    rows = rows.join(F.broadcast(first)).join(F.broadcast(lots), F.lit(True), "left")  # a row each
    bad = F.when(F.col("_default") & (F.col("_has").isNotNull() | (F.col("id") != F.col("_first"))), "second_default")
    return _with_rule(state, rows.select(*new.columns, bad.alias("_rule")), ["code"])


def create_categories(state: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As create(), with parents that are live roots of the same ledger and direction."""
    merged = new.unionByName(state.join(new.select("id"), "id", "left_anti"))
    bad = parent_errors(merged).withColumnRenamed("violation", "_rule")
    return _with_rule(state, new.join(bad, "id", "left"))


def create_txns(state: DataFrame, new: DataFrame, accounts: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As create(), of transactions of a valid shape whose accounts and categories are live and fit."""
    lost = reference_violations(new, accounts, categories).withColumnRenamed("violation", "_lost")
    rows = new.join(lost, "id", "left").withColumn("_rule", F.coalesce(shape_error(), "_lost")).drop("_lost")
    return _with_rule(state, rows)


def _with_rule(state: DataFrame, rows: DataFrame, unique: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """create() of the rows whose _rule is null; the others are refused with it."""
    after, refused = create(state, rows.where("_rule is null").drop("_rule"), unique)
    return after, refused.unionByName(rows.where("_rule is not null").select("id", F.col("_rule").alias("violation")))

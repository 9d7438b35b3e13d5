"""Double-entry balances: legs of transactions, full and incremental recomputation, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXPENSE, INCOME, TRANSFER = 1, 2, 3
DAY_MS = 86_400_000


def live() -> Column:
    """Rows that aren't tombstones."""
    return F.col("deleted_at").isNull()


def effect_error() -> Column:
    """What forbids a transaction's effect, or null."""
    move = F.col("type") == TRANSFER
    return (
        F.when(~F.col("type").isin(EXPENSE, INCOME, TRANSFER), "unknown_type")
        .when(F.col("amount_minor") <= 0, "amount_not_positive")
        .when(F.col("fee_minor") < 0, "negative_fee")
        .when(~move & (F.col("fee_minor") != 0), "fee_on_non_transfer")
        .when(move & F.col("to_account_id").isNull(), "transfer_without_target")
    )


def effect_violations(txns: DataFrame) -> DataFrame:
    """(id, violation) of live transactions that have no effect that could be reckoned."""
    return txns.where(live()).select("id", effect_error().alias("violation")).where("violation is not null")


def legs(txns: DataFrame, strict: bool = False) -> DataFrame:
    """(txn_id, account_id, delta, occurred_at): one row for each account that a live transaction moves.

    An expense takes the amount, an income brings it; a transfer takes amount and fee from its account and brings the
    amount to the other. One scan: the legs are an array that is exploded, so nothing is shuffled. If strict, a
    transaction of effect_violations() is an error.
    """
    if strict:
        bad = F.raise_error(F.concat(F.lit("transaction "), F.col("id").cast("string"), F.lit(": "), effect_error())).cast("long")
        txns = txns.withColumn("amount_minor", F.when(live() & effect_error().isNotNull(), bad).otherwise(F.col("amount_minor")))
    amount, fee = F.col("amount_minor"), F.col("fee_minor")
    own = F.when(F.col("type") == INCOME, amount).otherwise(-amount - fee)
    first = F.struct(F.col("account_id").alias("account_id"), own.alias("delta"))
    second = F.when(F.col("type") == TRANSFER, F.struct(F.col("to_account_id").alias("account_id"), amount.alias("delta")))
    rows = txns.where(live()).select(F.col("id").alias("txn_id"), "occurred_at", F.explode(F.array_compact(F.array(first, second))).alias("leg"))
    return rows.select("txn_id", "leg.account_id", "leg.delta", "occurred_at")


def balances(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """(id, balance_minor, balance_as_of) of every account, and of accounts that only transactions name, from zero.

    Legs are summed before they meet the accounts, so a hot account is a few partial sums.
    """
    moved = legs(txns).groupBy(F.col("account_id").alias("id")).agg(F.sum("delta").alias("delta"), F.max("occurred_at").alias("as_of"))
    return accounts.select("id", "opening_balance_minor").join(moved, "id", "full").select("id", (F.coalesce("opening_balance_minor", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("balance_minor"), F.coalesce("as_of", F.lit(0)).alias("balance_as_of"))


def apply_balances(accounts: DataFrame, txns: DataFrame) -> DataFrame:
    """accounts with cached_balance_minor and balance_as_of brought up to date; accounts that only transactions name
    are left out. No other column changes."""
    moved = legs(txns).groupBy(F.col("account_id").alias("_id")).agg(F.sum("delta").alias("_delta"), F.max("occurred_at").alias("_as_of"))
    rows = accounts.drop("cached_balance_minor", "balance_as_of").join(moved, F.col("id") == F.col("_id"), "left")
    return rows.withColumn("cached_balance_minor", F.col("opening_balance_minor") + F.coalesce("_delta", F.lit(0))).withColumn("balance_as_of", F.coalesce("_as_of", F.lit(0))).drop("_id", "_delta", "_as_of")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, delta): what accounts change by when transactions `before` become `after`; zero changes are left out, a new
    transaction without a valid effect is an error."""
    out = legs(before).select("account_id", (-F.col("delta")).alias("delta")).unionByName(legs(after, strict=True).select("account_id", "delta"))
    return out.groupBy(F.col("account_id").alias("id")).agg(F.sum("delta").alias("delta")).where("delta <> 0")


def running(txns: DataFrame) -> DataFrame:
    """Each leg with its account's sum so far, in order of time and transaction.

    Sums of the days before are added to sums within the day, so that an account with a third of all rows is dealt by
    days; the legs are shuffled once, by account and day.
    """
    rows = legs(txns).withColumn("_day", F.floor(F.col("occurred_at") / DAY_MS))
    days = rows.groupBy("account_id", "_day").agg(F.sum("delta").alias("_sum"))
    earlier = Window.partitionBy("account_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(F.col("account_id").alias("_a"), F.col("_day").alias("_d"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    within = Window.partitionBy("account_id", "_day").orderBy("occurred_at", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, F.col("account_id").eqNullSafe(F.col("_a")) & (F.col("_day") == F.col("_d")))
    return out.withColumn("running_minor", F.col("_start") + F.sum("delta").over(within)).select("txn_id", "account_id", "delta", "occurred_at", "running_minor")


def summary(txns: DataFrame, by: list[str] | None = None) -> DataFrame:
    """income_minor, expense_minor (with transfers' fees), transfer_minor and fee_minor of live transactions that count
    for statistics, in all or by columns. More than one currency in a group is an error; no row gives CNY and zeros."""
    kind, amount, fee = F.col("type"), F.col("amount_minor"), F.col("fee_minor")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = txns.where(live() & (F.col("excluded_from_stats") == 0))
    one = F.when(F.min("currency") == F.max("currency"), F.min("currency")).when(F.count("currency") == 0, F.lit("CNY")).otherwise(F.raise_error(F.lit("several currencies in one summary")).cast("string"))
    return rows.groupBy(*(by or [])).agg(
        one.alias("currency"),
        total(F.when(kind == INCOME, amount)).alias("income_minor"),
        total(F.when(kind == EXPENSE, amount).when(kind == TRANSFER, fee)).alias("expense_minor"),
        total(F.when(kind == TRANSFER, amount)).alias("transfer_minor"),
        total(F.when(kind == TRANSFER, fee)).alias("fee_minor"),
    )


def net_worth(accounts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The sum of live accounts' cached balances, whatever their type."""
    return accounts.where(live()).groupBy(*(by or [])).agg(F.coalesce(F.sum("cached_balance_minor"), F.lit(0)).alias("net_worth_minor"))


def available_credit(accounts: DataFrame) -> DataFrame:
    """(id, available_minor, debt_minor) of live accounts with a credit limit."""
    rows = accounts.where(live() & F.col("credit_limit_minor").isNotNull())
    balance = F.col("cached_balance_minor")
    return rows.select("id", (F.col("credit_limit_minor") + F.least(F.lit(0), balance)).alias("available_minor"), F.greatest(F.lit(0), -balance).alias("debt_minor"))


def shift_opening(accounts: DataFrame, changes: DataFrame) -> DataFrame:
    """accounts with opening and cached balance moved by changes (id, opening_delta)."""
    moved = F.coalesce("opening_delta", F.lit(0))
    rows = accounts.join(changes, "id", "left")
    return rows.withColumn("opening_balance_minor", F.col("opening_balance_minor") + moved).withColumn("cached_balance_minor", F.col("cached_balance_minor") + moved).drop("opening_delta")


def money_sum(rows: DataFrame, amount: str, currency: str, by: list[str] | None = None, most: int = 2**53 - 1) -> DataFrame:
    """sum_minor and currency; several currencies or a sum out of range are errors, an empty sum is 0."""
    out = rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(amount), F.lit(0)).alias("sum_minor"), F.min(currency).alias("currency"), F.max(currency).alias("_last"))
    checked = F.when(F.col("currency") != F.col("_last"), F.raise_error(F.lit("several currencies in one sum")).cast("long")).when(F.abs("sum_minor") > most, F.raise_error(F.lit("sum out of range")).cast("long")).otherwise(F.col("sum_minor"))
    return out.withColumn("sum_minor", checked).drop("_last")

"""The driver's tables seen as a ledger: accounts, categories, transactions, record versions, a replica pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_758_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(df: DataFrame, name: str) -> Column:
    """Epoch milliseconds of a timestamp column, whatever the session's time zone."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {name}) div 1000")
    return F.unix_millis(name)


def minor(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(
        key.alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("L"), key.cast("string")).alias("code"),
        F.lit("CNY").alias("currency"),
        F.when(key == 3, 1).otherwise(0).alias("is_default"),
        (key * 7 % 10).alias("sort_order"),
        F.when(key % 11 == 10, F.lit(BASE_MS)).alias("deleted_at"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_nationkey").cast("long").alias("ledger_id"),
        F.col("c_name").alias("name"),
        (key % 5 + 1).alias("type"),
        F.lit("CNY").alias("currency"),
        minor("c_acctbal").alias("opening_balance_minor"),
        F.when(key % 5 == 2, 500_000 + key * 100).alias("credit_limit_minor"),
        F.when(key % 9 == 4, key + 1).alias("repay_account_id"),
        (key * 3 % 10).alias("sort_order"),
        F.when(key % 17 == 5, BASE_MS + key).alias("deleted_at"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots are part types, children pairs of type and brand; kind 1 (expense) or 2 (income) by the brand's length."""
    part = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    roots = part.select(F.concat(F.lit("R:"), "p_type").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("p_type").alias("name")).distinct()
    kids = part.select(F.concat_ws(":", F.lit("C"), "p_type", "p_brand").alias("id"), F.concat(F.lit("R:"), "p_type").alias("parent_id"), F.col("p_brand").alias("name"))
    both = roots.unionByName(kids)
    return both.withColumn("kind", F.length("name") % 2 + 1).withColumn("kind", F.col("kind").cast("long")).withColumn("ledger_id", F.lit(0).cast("long")).withColumn("sort_order", (F.length("id") % 7).cast("long")).withColumn("deleted_at", F.when(F.col("name").endswith("3"), F.lit(BASE_MS)))


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as expenses, incomes and transfers; a transfer goes to the account of the neighbouring number."""
    orders = table(spark, sf_dir, "orders")
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).cast("long")
    move = kind == 3
    return orders.select(
        key.alias("id"),
        (who % 25).alias("ledger_id"),
        kind.alias("type"),
        minor("o_totalprice").alias("amount_minor"),
        F.lit("CNY").alias("currency"),
        F.when(move, key % 500).otherwise(0).alias("fee_minor"),
        millis(orders, "o_orderdate").alias("occurred_at"),
        ((key % 29 - 14) * 60).alias("tz_offset_min"),
        who.alias("account_id"),
        F.when(move, who + 1 - who % 2 * 2).alias("to_account_id"),
        F.when(~move, F.concat(F.lit("K"), (key % 150).cast("string"))).alias("category_id"),
        F.when(key % 23 == 0, 1).otherwise(0).alias("excluded_from_stats"),
        F.when((F.col("o_orderpriority") == "5-LOW") & (key % 7 == 0), F.lit(BASE_MS)).alias("deleted_at"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of their user's record."""
    events = table(spark, sf_dir, "events")
    ms = millis(events, "ts")
    return events.select(
        F.col("user_id").alias("id"),
        ms.alias("updated_at"),
        F.concat(F.lpad(ms.cast("string"), 15, "0"), F.lit("-"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("version_stamp"),
        F.col("event_type").alias("device_id"),
        F.sha2(F.coalesce("props", F.lit("")), 256).alias("content_hash"),
        (F.col("event_type") == "error").alias("deleted"),
    )


def replica(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Customers as records of two replicas that were edited apart: side local or remote."""
    key = F.col("c_custkey")
    base = table(spark, sf_dir, "customer").select(key.alias("id"), F.col("c_name").alias("name"), minor("c_acctbal").alias("balance"), F.col("c_nationkey").cast("long").alias("ledger_id"))
    key = F.col("id")
    if side == "local":
        rows = base.where(key % 19 != 1)
        at = BASE_MS + key % 7 * 1000
        gone, balance, device = key % 13 == 6, F.col("balance"), F.lit("device-a")
    else:
        rows = base.where(key % 11 != 1)
        at = BASE_MS + key % 5 * 40_000 - F.when(key % 3 == 0, 90_000).otherwise(0)
        gone, balance, device = (key % 13 == 7) | (key % 26 == 6), F.when(key % 7 == 0, F.col("balance") + 100).otherwise(F.col("balance")), F.lit("device-b")
    out = rows.select("id", "ledger_id", "name", balance.alias("balance"), at.alias("updated_at"), device.alias("device_id"), F.when(gone, at).alias("deleted_at"))
    seen = F.concat_ws("|", "id", "name", "balance", F.coalesce(F.col("deleted_at").cast("string"), F.lit("-")))
    return out.withColumn("content_hash", F.sha2(seen, 256))

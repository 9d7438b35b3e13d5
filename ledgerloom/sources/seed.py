"""A small sample ledger, and canonical dumps of any ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_MS = 1_700_000_000_000
META = "created_at long, updated_at long, deleted_at long, device_id string, rev long"


def sample(spark: SparkSession, device_id: str = "device-a") -> dict[str, DataFrame]:
    """One ledger, two categories, a current account and a credit card, an expense, an income and a transfer with a fee."""
    meta = (BASE_MS, BASE_MS, None, device_id, 1)
    frame = lambda rows, schema: spark.createDataFrame([(*r, *meta) for r in rows], f"{schema}, {META}")
    ledger = frame([("L1", "Household", "HOME", "CNY", 1, 0)], "id string, name string, code string, currency string, is_default long, sort_order long")
    category = frame([("C1", "L1", None, 1, "Groceries", 1), ("C2", "L1", None, 2, "Wages", 2)], "id string, ledger_id string, parent_id string, kind long, name string, sort_order long")
    account = frame([("A1", "L1", "Giro", 2, "CNY", 80_000, None, 1), ("A2", "L1", "Visa", 3, "CNY", 0, 200_000, 2)], "id string, ledger_id string, name string, type long, currency string, opening_balance_minor long, credit_limit_minor long, sort_order long")
    rows = [("T1", 1, 4_575, "A1", None, "C1", 0), ("T2", 2, 120_000, "A1", None, "C2", 0), ("T3", 3, 30_000, "A1", "A2", None, 150)]
    txns = [(i, "L1", kind, amount, "CNY", BASE_MS, "2023-11-14", "2023-11", -300, a, b, c, fee, 0) for i, kind, amount, a, b, c, fee in rows]
    txn = frame(txns, "id string, ledger_id string, type long, amount_minor long, currency string, occurred_at long, day_key string, month_key string, tz_offset_min long, account_id string, to_account_id string, category_id string, fee_minor long, excluded_from_stats long")
    return {"ledger": ledger, "category": category, "account": account, "txn": txn}


def canonical(tables: dict[str, DataFrame]) -> DataFrame:
    """(stage, n, digest) of tables, alike for equal rows however they are stored: the digest is over sums of the rows'
    hashes, taken from JSON with sorted keys, so no task holds a table."""
    parts = None
    for name, df in tables.items():
        line = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
        digest = F.sha2(line, 256)
        piece = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(20,0)")), F.lit(0))
        one = df.agg(F.count("*").alias("n"), piece(1).alias("a"), piece(13).alias("b"), piece(25).alias("c"))
        one = one.select(F.lit(name).alias("stage"), "n", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string")), 256).alias("digest"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def differences(one: dict[str, DataFrame], other: dict[str, DataFrame]) -> list[str]:
    """Names of tables whose canonical dumps differ, or that only one side has."""
    a, b = ({r["stage"]: (r["n"], r["digest"]) for r in canonical(t).collect()} for t in (one, other))
    return sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))

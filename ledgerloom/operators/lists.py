"""Lists in the order that users see, pages, lookups."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.store import cut_lineage


def by_id(rows: DataFrame, value: object, column: str = "id") -> DataFrame:
    return rows.where(F.col(column) == F.lit(value))


def batch(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is among ids (id), which may repeat."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")


def default_ledger(ledgers: DataFrame) -> DataFrame:
    return ledgers.where("deleted_at is null and is_default = 1")


def txn_page(txns: DataFrame, ledger_id: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a ledger's live transactions, latest day first; txns has day_key."""
    rows = txns.where(F.col("deleted_at").isNull() & (F.col("ledger_id") == ledger_id))
    return rows.orderBy(F.desc("day_key"), F.desc("id")).offset(offset).limit(limit)


def account_list(accounts: DataFrame) -> DataFrame:
    return accounts.where("deleted_at is null").orderBy("sort_order", "id")


def category_list(categories: DataFrame) -> DataFrame:
    return categories.where("deleted_at is null").orderBy(F.col("parent_id").asc_nulls_first(), "sort_order", "id")


def ledger_list(ledgers: DataFrame) -> DataFrame:
    return ledgers.where("deleted_at is null").orderBy(F.desc("is_default"), "sort_order", "id")


def positions(rows: DataFrame, partition: list[str], order: list) -> DataFrame:
    """rows with their place (from 1) in their partition's order."""
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)).cast("long"))


def ranked(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place (from 1) in an order over all of them. They are dealt by ranges of the order, and each range
    starts where the ranges before end, so that no task sorts them all."""
    dealt = cut_lineage(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(starts, F.col("_part") == F.col("_p")).withColumn(name, (F.col("_start") + within).cast("long")).drop("_part", "_p", "_start")


def merge_by_id(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both by id; the first frame's win. Each frame has an id once."""
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


def put_if_absent(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """meta (key, value) with the entries whose key it doesn't have."""
    return meta.unionByName(entries.join(meta.select("key"), "key", "left_anti"))


def meta_list(meta: DataFrame) -> DataFrame:
    """All entries (key, value) in order of key."""
    return meta.where("key is not null").orderBy("key")


def device_id(meta: DataFrame, new: str, key: str = "device_id") -> tuple[DataFrame, str]:
    """meta with a device's id, and that id: the one it has, or else `new`, a ULID. What the entries then say counts."""
    if not re.fullmatch("[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}", new):
        raise ValueError(f"no ULID: {new!r}")
    entry = meta.sparkSession.createDataFrame([(key, new)], "key string, value string")
    kept = meta.where((F.col("key") != key) | (F.col("value") != ""))
    after = put_if_absent(kept, entry)
    return after, after.where(F.col("key") == key).first()["value"]

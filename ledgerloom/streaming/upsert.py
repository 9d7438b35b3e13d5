"""Streams of record versions and transactions: winners by id, balances, and merges batch by batch.

A winner is a maximum, so late and repeated versions need no watermark to come out right; tombstones stay in the state,
or a late edit would bring its record back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import balance, merge
from ledgerloom.sources.store import cut_lineage


def winners(stream: DataFrame) -> DataFrame:
    """The winning version of every id so far (for update or complete output): a running maximum with partial sums."""
    order = F.struct("version_stamp", "content_hash", "deleted")
    best = stream.groupBy("id").agg(F.max(order).alias("w"), F.count("*").alias("merged_count"))
    return best.select("id", "w.version_stamp", "w.content_hash", "w.deleted", "merged_count")


def account_totals(stream: DataFrame) -> DataFrame:
    """Each account's sum of legs and last time so far, from a stream of transactions."""
    return balance.legs(stream).groupBy("account_id").agg(F.sum("delta").alias("delta"), F.max("occurred_at").alias("as_of"))


def daily_totals(stream: DataFrame, time: str = "occurred_at", late: str = "2 days") -> DataFrame:
    """Sums by UTC day and type, for append output: a day is final once events are `late` past its end."""
    at = stream.withColumn("at", F.timestamp_millis(time)).withWatermark("at", late)
    return at.where("deleted_at is null").groupBy(F.window("at", "1 day").alias("day"), "type").agg(F.sum("amount_minor").alias("amount_minor"), F.count("*").alias("n"))


def merge_batches(read_state: Callable[[], DataFrame], write_state: Callable[[DataFrame, int], None], **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch of remote records is merged into the state.

    A batch's records are first reduced to one an id. write_state gets the next state and the batch's number and must
    replace the state as a whole, so that a batch that runs again gives the same state.
    """

    def run(batch: DataFrame, number: int) -> None:
        write_state(merged(read_state(), batch, **options), number)

    return run


def merged(local: DataFrame, batch: DataFrame, **options: str) -> DataFrame:
    """local after a batch of remote records, of which an id may have several."""
    # ties of time, device and content are equal records but for their other columns, which then decide
    order = F.struct("updated_at", F.sha2(F.coalesce("device_id", F.lit("")), 256).alias("device"), "content_hash", F.struct(*batch.columns).alias("row"))
    remote = batch.groupBy("id").agg(F.max(order).alias("w")).select("w.row.*")
    decisions = merge.decide(remote, local, options.get("mode", "merge"), options.get("strategy", "converge"), options.get("delete_edit", "conflict"))
    return merge.next_state(local, remote, decisions)


#: The column that a bucketed state is partitioned by.
BUCKET = "_bucket"


def bucket(buckets: int, key: str = "id") -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(state: DataFrame, path: str, buckets: int) -> None:
    """A state as a table of hash buckets of the id."""
    state.withColumn(BUCKET, bucket(buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop(BUCKET)


def merge_buckets(path: str, buckets: int, **options: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each batch is merged into the state that write_buckets() wrote under path, of which only the
    buckets that the batch touches are read and replaced.

    A batch that runs again gives the same state, as a record that was merged already is a skip. The numbers of touched
    buckets, at most `buckets`, are all that the driver sees.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = cut_lineage(batch)
        touched = [r[0] for r in kept.select(bucket(buckets)).distinct().collect()]
        if not touched:
            return
        state = spark.read.parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        # computed before the buckets that it comes from are replaced
        after = cut_lineage(merged(state, kept, **options).withColumn(BUCKET, bucket(buckets)).repartition(BUCKET))
        after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    return run

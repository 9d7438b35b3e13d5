"""Versions of a record: which of two wins, and which of many.

A version is (id, version_stamp, device_id, content_hash, deleted). The order is by stamp, then content hash, so the
winner of any set is its maximum, whatever the order of comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ulid_millis, ulid_valid

#: Characters of a stamp that hold its time.
STAMP_TIME = 10


def version_error() -> Column:
    """What makes a version invalid, or null."""
    return (
        F.when(~F.coalesce(ulid_valid(F.col("id")), F.lit(False)), "bad_id")
        .when(~F.coalesce(ulid_valid(F.col("version_stamp")), F.lit(False)), "bad_stamp")
        .when(F.coalesce(F.length("device_id"), F.lit(0)) == 0, "empty_device")
        .when(~F.coalesce(F.col("content_hash").rlike("^[0-9a-f]{64}$"), F.lit(False)), "bad_hash")
    )


def version_millis() -> Column:
    return ulid_millis(F.col("version_stamp"))


def pair_error(local: str = "local", remote: str = "remote") -> Column:
    """Why two versions (structs) can't be compared, or null: another record, or no content hash."""
    hashed = lambda c: F.coalesce(F.col(c)["content_hash"].rlike("^[0-9a-f]{64}$"), F.lit(False))
    return F.when(~F.col(local)["id"].eqNullSafe(F.col(remote)["id"]), "other_record").when(~hashed(local) | ~hashed(remote), "bad_hash")


def resolve(pairs: DataFrame, stamp_time: int = STAMP_TIME) -> DataFrame:
    """pairs (id, local struct, remote struct) with side, reason, needs_review, is_noop and the winner (struct).

    Identical versions need nothing. Equal content: the larger stamp, remote on a tie. Equal stamps: the larger hash,
    to be reviewed. Else the larger stamp, to be reviewed if both are of one millisecond.
    """
    a, b = F.col("local"), F.col("remote")
    same_stamp, same_hash = a["version_stamp"] == b["version_stamp"], (a["content_hash"] == b["content_hash"]) & (a["deleted"] == b["deleted"])
    identical = same_stamp & same_hash & (a["device_id"] == b["device_id"])
    later = b["version_stamp"] > a["version_stamp"]
    same_ms = F.substring(a["version_stamp"], 1, stamp_time) == F.substring(b["version_stamp"], 1, stamp_time)
    side = F.when(identical, "none").when(same_hash, F.when(later | same_stamp, "remote").otherwise("local")).when(same_stamp, F.when(b["content_hash"] >= a["content_hash"], "remote").otherwise("local")).otherwise(F.when(later, "remote").otherwise("local"))
    reason = F.when(identical, "identical").when(same_hash, "metadata_only").when(same_stamp, "stamp_collision").otherwise("newer_stamp")
    review = ~same_hash & (same_stamp | same_ms)
    winner = F.when(side == "remote", b).otherwise(a)
    return pairs.select("*", side.alias("side"), reason.alias("reason"), review.alias("needs_review"), identical.alias("is_noop"), winner.alias("winner"))


def reduce_versions(rows: DataFrame, stamp_time: int = STAMP_TIME) -> DataFrame:
    """One row an id: the winner's version_stamp, content_hash and deleted, merged_count, and needs_review.

    A record needs review if another version of the winner's millisecond has other content. Two aggregates with partial
    sums and one join: no id's versions are gathered.
    """
    order = F.struct("version_stamp", "content_hash", "deleted")
    won = rows.groupBy("id").agg(F.max(order).alias("w"), F.count("*").alias("merged_count"))
    by_ms = rows.groupBy("id", F.substring("version_stamp", 1, stamp_time).alias("_ms")).agg(F.min("content_hash").alias("_first"), F.max("content_hash").alias("_last"))
    out = won.join(by_ms, (won["id"] == by_ms["id"]) & (F.substring(F.col("w.version_stamp"), 1, stamp_time) == by_ms["_ms"]))
    return out.select(won["id"], "w.version_stamp", "w.content_hash", "w.deleted", "merged_count", (F.col("_first") != F.col("_last")).alias("needs_review"))

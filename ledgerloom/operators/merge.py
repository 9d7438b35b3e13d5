"""Merging a change set into local state: decisions, next state, conflicts, removals, counters.

Records are (id, updated_at, device_id, content_hash, deleted_at, ...business columns). The decision is one ordered
chain of conditions over a left join of remote to local by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import conflict_id, version_stamp

#: An import's modes, strategies and ways to treat a deletion here and an edit there; decide() has the
#: names of outcomes and rules.
MODES = ("merge", "replace", "supplement_only")
STRATEGIES = ("abort", "converge")
DELETE_EDIT = ("conflict", "edit_wins_by_lww")
#: Fixed value: edits less than this many milliseconds apart are ambiguous.
SKEW_MS = 60_000
#: The order in which record types are written.
STAGES = ("ledger", "account", "category", "tag", "theme", "txn", "budget", "attachment")
META = ("updated_at", "device_id", "content_hash", "deleted_at")


def record_order(updated_at: Column, device_id: Column) -> Column:
    """What orders versions of a record: time (not below 0), then the first 80 bits of the device's SHA-256."""
    return F.struct(F.greatest(F.coalesce(updated_at, F.lit(0)), F.lit(0)), F.substring(F.sha2(F.coalesce(device_id, F.lit("")), 256), 1, 20))


def decide(remote: DataFrame, local: DataFrame, mode: str = "merge", strategy: str = "abort", delete_edit: str = "conflict", skew_ms: int = SKEW_MS, parity: bool = True) -> DataFrame:
    """Every remote record: id, outcome, rule, conflict_kind (1 edit, 2 deletion) and write (INSERT, UPDATE or null).

    parity: with edit_wins_by_lww a newer local edit of a record that the remote deleted is still overwritten; without
    it the edit stays and nothing is written.
    """
    if mode not in MODES or strategy not in STRATEGIES or delete_edit not in DELETE_EDIT:
        raise ValueError((mode, strategy, delete_edit))
    r = remote.select("id", *[F.col(c).alias(f"r_{c}") for c in META])
    mine = local.select(F.col("id").alias("_id"), *[F.col(c).alias(f"l_{c}") for c in META])
    pairs = r.join(mine, F.col("id") == F.col("_id"), "left")
    missing = F.col("_id").isNull()
    r_gone, l_gone = F.col("r_deleted_at").isNotNull(), F.col("l_deleted_at").isNotNull()
    same = F.col("r_content_hash") == F.col("l_content_hash")
    r_at, l_at = record_order(F.col("r_updated_at"), F.col("r_device_id")), record_order(F.col("l_updated_at"), F.col("l_device_id"))
    tie = r_at == l_at
    remote_wins = (r_at > l_at) | tie & (F.col("r_content_hash") >= F.col("l_content_hash"))
    inserted = F.when(r_gone, "insert_tombstone").otherwise("insert")
    none = F.lit(None).cast("string")

    def case(outcome: Column | str, rule: Column | str, write: Column | str | None = None, kind: Column | int | None = None) -> Column:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(lit(outcome).cast("string").alias("outcome"), lit(rule).cast("string").alias("rule"), lit(kind).cast("long").alias("conflict_kind"), lit(write).cast("string").alias("write"))

    if mode == "supplement_only":
        chain = F.when(missing, case(inserted, "fill_only_new", "INSERT")).otherwise(case("skip", "fill_only_existing"))
    elif mode == "replace":
        rule = F.when(r_gone, "overwrite_tombstone").otherwise("overwrite_by_file")
        chain = F.when(missing, case(inserted, rule, "INSERT")).otherwise(case(F.when(r_gone, "mark_deleted").otherwise("update"), rule, "UPDATE"))
    else:
        chain = F.when(missing, case(inserted, F.when(r_gone, "local_missing_tombstone").otherwise("local_missing"), "INSERT"))
        if strategy == "abort":
            kind = F.when(r_gone != l_gone, 2).otherwise(1)
            chain = chain.when(same, case("skip", "identical_content")).otherwise(case("conflict", "abort_on_divergence", None, kind))
        else:
            differs = r_gone != l_gone
            edit_newer = F.when(l_gone, remote_wins).otherwise(~remote_wins)
            overwrite = F.when(remote_wins, "UPDATE").otherwise(none)
            chain = chain.when(same & ~differs, case("skip", "identical_content")).when(r_gone & l_gone, case("skip", "both_deleted"))
            chain = chain.when(differs & ~edit_newer, case(F.when(l_gone, "skip").otherwise("mark_deleted"), "tombstone_wins", F.when(l_gone, none).otherwise("UPDATE")))
            if delete_edit == "edit_wins_by_lww":
                kept = case("resurrect", "delete_vs_edit_lww", "UPDATE" if parity else F.when(l_gone, "UPDATE").otherwise(none))
                chain = chain.when(differs, kept)
            else:
                chain = chain.when(differs, case("conflict", "delete_vs_edit", overwrite, 2))
            near = F.abs(F.col("r_updated_at") - F.coalesce("l_updated_at", F.lit(0))) < skew_ms
            chain = chain.when(tie | near, case("conflict", F.when(tie, "stamp_collision").otherwise("ambiguous_window"), overwrite, 1))
            chain = chain.when(remote_wins, case("update", "remote_newer", "UPDATE")).otherwise(case("skip", "local_newer"))
    return pairs.withColumn("_d", chain).select("id", "_d.outcome", "_d.rule", "_d.conflict_kind", "_d.write")


def duplicates(remote: DataFrame) -> DataFrame:
    """Ids that a change set has more than once, which no plan can insert."""
    return remote.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def remap_ledgers(records: DataFrame, mapping: DataFrame, column: str = "ledger_id") -> DataFrame:
    """records with ledger ids replaced by mapping (old, new) where it has them."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return records.join(m, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def removals(local: DataFrame, remote: DataFrame, ledger_id: int) -> DataFrame:
    """Live local rows of a ledger that a replacing change set doesn't hold."""
    return local.where(F.col("deleted_at").isNull() & (F.col("ledger_id") == ledger_id)).join(remote.select("id"), "id", "left_anti")


def removed(rows: DataFrame, now_ms: int, device_id: str) -> DataFrame:
    """Rows as tombstones."""
    out = rows.withColumn("deleted_at", F.lit(now_ms).cast("long")).withColumn("updated_at", F.lit(now_ms).cast("long")).withColumn("device_id", F.lit(device_id))
    return out.withColumn("rev", F.col("rev") + 1) if "rev" in rows.columns else out


def next_state(local: DataFrame, remote: DataFrame, decisions: DataFrame) -> DataFrame:
    """local after the decisions' writes: written records replace those of their id, others stay."""
    written = remote.join(decisions.where("write is not null").select("id"), "id", "left_semi")
    return local.join(written.select("id"), "id", "left_anti").unionByName(written.select(*local.columns))


def counters(decisions: DataFrame) -> DataFrame:
    """One row: how many records were inserted, updated, skipped and in conflict, and how many there are."""
    count = lambda c: F.count(F.when(c, 1))
    return decisions.agg(
        count(F.col("write") == "INSERT").alias("inserted"),
        count(F.col("write") == "UPDATE").alias("updated"),
        count(F.col("outcome") == "skip").alias("skipped"),
        count(F.col("outcome") == "conflict").alias("conflicts"),
        F.count("*").alias("records"),
    )


def classify(decisions: DataFrame) -> DataFrame:
    """(id, state): each record as insert, skip or conflict, as an import shows them before anything is decided for good."""
    state = F.when(F.col("write") == "INSERT", "insert").when(F.col("outcome") == "skip", "skip").otherwise("conflict")
    return decisions.select("id", state.alias("state"))


def conflicts(remote: DataFrame, local: DataFrame, decisions: DataFrame, job: str, entity: str, now_ms: int) -> DataFrame:
    """The review queue: conflict_id, entity, record_id, kind, and both versions (stamp, content hash, deleted) as JSON."""
    rows = decisions.where("outcome = 'conflict'").select("id", "conflict_kind")
    version = F.struct(version_stamp(F.coalesce("updated_at", F.lit(0)), F.coalesce("device_id", F.lit(""))).alias("versionStamp"), F.col("content_hash").alias("contentHash"), F.col("deleted_at").isNotNull().alias("deleted"))
    as_json = lambda df, name: df.select("id", F.to_json(version, {"ignoreNullFields": "false"}).alias(name))
    out = rows.join(as_json(local, "local_json"), "id", "left").join(as_json(remote, "remote_json"), "id", "left")
    key = conflict_id(now_ms, F.lit(job), F.lit(entity), F.col("id").cast("string"), F.col("conflict_kind"))
    return out.select(key.alias("conflict_id"), F.lit(entity).alias("entity"), F.col("id").alias("record_id"), F.col("conflict_kind").alias("kind"), "local_json", "remote_json")


class Conflicts(ValueError):
    """An aborting import met conflicts."""

    failure = "conflicts"


class Unconfirmed(ValueError):
    """An import would remove rows and nobody said that it may."""

    failure = "unconfirmed_removals"


def guard(decisions: DataFrame, removal_rows: DataFrame | None = None, strategy: str = "abort", allow_removals: bool = False) -> None:
    """Raises before anything is written: conflicts when aborting, removals that nobody confirmed."""
    if removal_rows is not None and not allow_removals and not removal_rows.isEmpty():
        raise Unconfirmed(f"{removal_rows.count()} rows would be removed; allow_removals confirms that")
    if strategy == "abort" and not decisions.where("outcome = 'conflict'").isEmpty():
        raise Conflicts("conflicts in an aborting import")


def write_rank() -> list[Column]:
    """What orders writes (entity, phase, record_index): by stage, placeholders (phase 0) before records."""
    return [F.array_position(F.array(*map(F.lit, STAGES)), F.col("entity")), F.col("phase"), F.col("record_index")]


def write_order(writes: DataFrame) -> DataFrame:
    return writes.orderBy(*write_rank())

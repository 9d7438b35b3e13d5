"""Importing a change set: remap, repair, decide, guard, next state, balances, counters, job record."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import balance, checks, merge, repair
from ledgerloom.sources.store import cut_lineage

#: Columns that a record's fingerprint leaves out.
NOT_IN_FINGERPRINT = ("rev", "updated_at", "created_at", "device_id", "source_import_job")
#: Columns that are derived here and never taken from a record.
DERIVED = ("cached_balance_minor", "balance_as_of")
#: What a new row has in columns that its record doesn't carry, if not null.
DEFAULTS = {"cached_balance_minor": 0, "balance_as_of": 0, "rev": 1, "fee_minor": 0, "is_archived": 0, "is_hidden": 0, "is_system": 0, "is_reimbursable": 0, "excluded_from_stats": 0, "sort_order": 0}


class Refused(ValueError):
    """Records that no plan can be made of."""

    failure = "invalid_records"


class BrokenReferences(ValueError):
    """References that would name nothing after an import."""

    failure = "broken_references"


def failure(error: Exception) -> str:
    """What went wrong with an import, as the layer that raised it names it; whatever has no name counts as damage,
    never as a wrong key."""
    return getattr(error, "failure", "damaged")


def fingerprint(columns: list[str]) -> F.Column:
    """A record's content hash over its columns in order of name, nulls included."""
    names = sorted(c for c in columns if c not in NOT_IN_FINGERPRINT and c != "violations")
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


@dataclass
class Options:
    mode: str = "merge"
    strategy: str = "abort"
    delete_edit: str = "conflict"
    target_ledger: str | None = None
    allow_removals: bool = False
    device_id: str = "local"
    now_ms: int = 0
    job: str = "job"
    ledger_map: dict[str, str] = field(default_factory=dict)


@dataclass
class Report:
    """What an import did: counters by table, placeholders and promoted categories, removed rows, and as frames the
    conflicts and the fixes of references."""

    counters: dict[str, dict[str, int]]
    placeholders: int
    promoted: int
    conflicts: DataFrame | None
    skipped_as_known: bool = False
    removed: int = 0
    fixes: DataFrame | None = None


@dataclass
class Plan:
    """What an import would do: records by table as they will be written, decisions, placeholders, removals, fixes."""

    records: dict[str, DataFrame]
    decisions: dict[str, DataFrame]
    placeholders: dict[str, DataFrame]
    removals: dict[str, DataFrame]
    fixes: DataFrame | None
    conflicts: DataFrame | None


def file_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def carried(records: DataFrame, state: DataFrame) -> list[str]:
    """The state's columns that records have; others stay as they are in the state."""
    return [c for c in state.columns if c in records.columns and c not in DERIVED]


def signed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with content_hash over the columns that the records carry, whatever else a side has."""
    return df.withColumn("content_hash", fingerprint(columns))


def plan(state: dict[str, DataFrame], records: dict[str, DataFrame], options: Options) -> Plan:
    """Records are remapped to other ledgers and, in converging imports, repaired before they are decided on: parents
    that nobody has get placeholders, broken category parents become roots. Two versions are alike if the columns that
    the record carries are. Nothing is written.
    """
    order = [k for k in merge.STAGES if k in records and k in state]
    incoming = {k: records[k] for k in order}
    spark = next(iter(state.values())).sparkSession
    if broken := [k for k, df in incoming.items() if "violations" in df.columns and not df.where("size(violations) > 0").isEmpty()]:
        raise Refused(f"invalid records: {broken}")
    if unsafe := [k for k, df in incoming.items() if dict(df.dtypes)["id"] == "string" and not checks.unsafe_ids(df).isEmpty()]:
        raise Refused(f"unsafe ids: {unsafe}")
    if options.ledger_map:
        mapping = spark.createDataFrame(list(options.ledger_map.items()), "old string, new string")
        incoming = {k: merge.remap_ledgers(df, mapping, "id" if k == "ledger" else "ledger_id") if k != "theme" else df for k, df in incoming.items()}
    if twice := [k for k, df in incoming.items() if not merge.duplicates(df).isEmpty()]:
        raise Refused(f"repeated ids: {twice}")
    types = {k: dict(state[k].dtypes) for k in order}
    incoming = {k: cut_lineage(df.select(*[F.col(c).cast(types[k][c]).alias(c) for c in carried(df, state[k])])) for k, df in incoming.items()}
    made, fixes = {}, None
    if options.strategy == "converge" and incoming:
        incoming, made, fixes = repair.repaired(incoming, state, options.device_id, max(0, options.now_ms))
        incoming = {k: cut_lineage(df) for k, df in incoming.items()} if "category" in incoming else incoming
        made = {k: cut_lineage(df) for k, df in made.items()}
        fixes = None if fixes is None else cut_lineage(fixes)
    decisions, queue = {}, None
    for k, df in incoming.items():
        columns = df.columns
        remote, local = signed(df, columns), signed(state[k], columns)
        decisions[k] = cut_lineage(merge.decide(remote, local, options.mode, options.strategy, options.delete_edit))
        found = merge.conflicts(remote, local, decisions[k], options.job, k, options.now_ms)
        queue = found if queue is None else queue.unionByName(found)
    return Plan(incoming, decisions, made, removals(state, incoming, options), fixes, queue)


def removals(state: dict[str, DataFrame], incoming: dict[str, DataFrame], options: Options) -> dict[str, DataFrame]:
    """Of a replacing import, the target ledger's live rows whose id no record of any type has, by table."""
    if options.mode != "replace" or options.target_ledger is None:
        return {}
    seen = None
    for df in incoming.values():
        part = df.select("id")
        seen = part if seen is None else seen.unionByName(part)
    out = {}
    for k in dict.fromkeys(r.child for r in repair.RULES if r.column == "ledger_id"):
        if k in state:
            rows = state[k].where(F.col("deleted_at").isNull() & (F.col("ledger_id") == options.target_ledger))
            out[k] = rows if seen is None else rows.join(seen, "id", "left_anti")
    return out


def written(state: DataFrame, records: DataFrame, decisions: DataFrame) -> DataFrame:
    """The state after the decisions' writes, column by column: a written record sets the columns that it carries, and
    its row keeps the others; a new row has DEFAULTS there. One join by id."""
    columns = records.columns
    inc = records.select(F.col("id").alias("_id"), F.struct(*columns).alias("_r")).join(decisions.where("write is not null").select(F.col("id").alias("_id")), "_id")
    rows = state.join(inc, F.col("id") == F.col("_id"), "full")
    new = F.col("id").isNull()
    kinds = dict(state.dtypes)

    def value(c: str) -> F.Column:
        if c in columns:
            return F.when(F.col("_id").isNotNull(), F.col("_r")[c]).otherwise(F.col(c)).alias(c)
        return F.when(new, F.lit(DEFAULTS.get(c)).cast(kinds[c])).otherwise(F.col(c)).alias(c)

    return rows.select(*map(value, state.columns))


def apply_import(state: dict[str, DataFrame], records: dict[str, DataFrame], options: Options, known_files: set[str] | None = None, file: str | None = None) -> tuple[dict[str, DataFrame], Report]:
    """The next state and a report; the state isn't touched, and guards raise before anything is made of the decisions.

    A file whose hash is known gives the state as it is. See plan() for what is decided. After the writes no reference of
    the written tables may be broken, and balances are recomputed.
    """
    if file is not None and file in (known_files or set()):
        return state, Report({}, 0, 0, None, True)
    todo = plan(state, records, options)
    gone = None
    for rows in todo.removals.values():
        gone = rows.select("id") if gone is None else gone.unionByName(rows.select("id"))
    for k, decided in todo.decisions.items():
        merge.guard(decided, None, options.strategy if options.mode == "merge" else "converge")
    if gone is not None and not options.allow_removals and not gone.isEmpty():
        raise merge.Unconfirmed(f"{gone.count()} rows would be removed; allow_removals confirms that")
    counters = {k: merge.counters(d).first().asDict() for k, d in todo.decisions.items()}
    after, placeholders = dict(state), 0
    for k in state:
        rows = state[k]
        if k in todo.decisions:
            rows = written(rows, todo.records[k], todo.decisions[k])
        if k in todo.placeholders:
            new = todo.placeholders[k]
            placeholders += new.count()
            types = dict(rows.dtypes)
            rows = rows.unionByName(new.select(*[(F.col(c) if c in new.columns else F.lit(DEFAULTS.get(c))).cast(types[c]).alias(c) for c in rows.columns]))
        if k in todo.removals:
            out = todo.removals[k].select(F.col("id").alias("_gone"))
            rows = rows.join(out, F.col("id") == F.col("_gone"), "left")
            dead = merge.removed(rows.where("_gone is not null").drop("_gone"), options.now_ms, options.device_id)
            rows = rows.where("_gone is null").drop("_gone").unionByName(dead)
        if k in todo.decisions or k in todo.placeholders or k in todo.removals:
            after[k] = cut_lineage(rows)
    touched = set(todo.decisions)
    if any(r.child in touched and r.parent in after and r.column in after[r.child].columns for r in repair.RULES):
        lost = [r["rule"] for r in repair.orphans(after, touched=touched).where("n > 0").collect()]
        if lost:
            raise BrokenReferences(f"broken references: {lost}")
    if "account" in after and "txn" in after and set(DERIVED) & set(state["account"].columns):
        after["account"] = balance.apply_balances(after["account"], after["txn"]).select(*state["account"].columns)
    promoted = 0 if todo.fixes is None else todo.fixes.where("kind = 'promote_to_root'").count()
    removed = 0 if gone is None else gone.count()
    fixes = None if todo.fixes is None else repair.fix_report(todo.fixes)
    return after, Report(counters, placeholders, promoted, todo.conflicts, False, removed, fixes)


def job_record(spark: SparkSession, job: str, file: str, report: Report, options: Options, started_ms: int, status: int) -> DataFrame:
    """One row for the table of imports: status 0 running, 1 done, 2 failed, 3 rolled back. Placeholders count as
    inserted."""
    total = lambda k: sum(c[k] for c in report.counters.values())
    row = (job, file, options.mode, options.strategy, started_ms, options.now_ms, status, total("inserted") + report.placeholders, total("updated"), total("skipped"), total("conflicts"), report.removed)
    return spark.createDataFrame([row], "id string, file_sha256 string, mode string, strategy string, started_at long, finished_at long, status int, inserted long, updated long, skipped long, conflicts long, removed long")

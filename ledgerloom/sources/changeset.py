"""Change sets: newline-delimited JSON with a manifest line, record lines by stage, and an end line.

Writing and reading are distributed: lines carry (stage, ordinal) and are range-sorted into part files. The content hash
is a digest of the stages' digests, each over its lines' hashes in order of ordinal, so that no task needs all lines.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.checks import ID_PATTERN

#: Limits of a change set.
MOST_LINE = 16 * 1024 * 1024
MOST_RECORDS = 2_000_000
MOST_TEXT = 8 * 1024
MOST_AMOUNT = 10**15
MOST_IDS = 64
#: Hash bins of a stage's digest.
BINS = 1024


@dataclass(frozen=True)
class Field:
    """A record's field: JSON key, column, kind, default of a missing optional one."""

    key: str
    column: str
    kind: str  # text, integer, flag, amount, ids, object, bytes
    required: bool = True
    default: object = None
    allowed: tuple[int, ...] = ()


COMMON = (Field("createdAt", "created_at", "integer"), Field("updatedAt", "updated_at", "integer"), Field("deletedAt", "deleted_at", "integer", False), Field("deviceId", "device_id", "text"), Field("rev", "rev", "integer", False, 1))


@dataclass(frozen=True)
class Spec:
    """A record type: its table and fields."""

    type: str
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def column(self, key: str) -> Field:
        return next(f for f in self.fields if f.key == key)


#: Record types, their keys on the wire, columns and defaults.
SPECS = {
    s.type: s
    for s in (
        Spec("ledger", (Field("id", "id", "text"), Field("name", "name", "text"), Field("code", "code", "text"), Field("currency", "currency", "text", False, "CNY"), Field("isDefault", "is_default", "flag", False, 0), Field("sortOrder", "sort_order", "integer", False, 0), *COMMON)),
        Spec("account", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("name", "name", "text"), Field("accountType", "type", "integer", allowed=(1, 2, 3, 4, 5)), Field("currency", "currency", "text"), Field("openingBalanceMinor", "opening_balance_minor", "amount", False, 0), Field("creditLimitMinor", "credit_limit_minor", "amount", False), Field("statementDay", "statement_day", "integer", False), Field("dueDay", "due_day", "integer", False), Field("repayAccountId", "repay_account_id", "text", False), Field("icon", "icon", "text", False), Field("color", "color", "text", False), Field("isArchived", "is_archived", "flag", False, 0), Field("sortOrder", "sort_order", "integer", False, 0), Field("note", "note", "text", False), *COMMON)),
        Spec("category", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("parentId", "parent_id", "text", False), Field("kind", "kind", "integer", allowed=(1, 2)), Field("name", "name", "text"), Field("icon", "icon", "text", False), Field("color", "color", "text", False), Field("isSystem", "is_system", "flag", False, 0), Field("isHidden", "is_hidden", "flag", False, 0), Field("sortOrder", "sort_order", "integer", False, 0), *COMMON)),
        Spec("tag", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("name", "name", "text"), Field("color", "color", "text", False), *COMMON)),
        Spec("theme", (Field("id", "id", "text"), Field("name", "name", "text"), Field("spec", "spec_json", "object"), Field("isActive", "is_active", "flag", False, 0), *COMMON)),
        Spec("txn", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("txnType", "type", "integer", allowed=(1, 2, 3)), Field("amountMinor", "amount_minor", "amount"), Field("currency", "currency", "text"), Field("occurredAt", "occurred_at", "integer"), Field("dayKey", "day_key", "text"), Field("monthKey", "month_key", "text"), Field("tzOffsetMin", "tz_offset_min", "integer"), Field("accountId", "account_id", "text"), Field("toAccountId", "to_account_id", "text", False), Field("categoryId", "category_id", "text", False), Field("merchant", "merchant", "text", False), Field("note", "note", "text", False), Field("tags", "tags", "ids", False), Field("feeMinor", "fee_minor", "amount", False, 0), Field("isReimbursable", "is_reimbursable", "flag", False, 0), Field("excludedFromStats", "excluded_from_stats", "flag", False, 0), Field("originDeviceId", "origin_device_id", "text", False), *COMMON)),
        Spec("budget", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("periodType", "period_type", "integer", allowed=(1, 2)), Field("periodKey", "period_key", "text"), Field("scope", "scope", "integer", allowed=(1, 2)), Field("categoryId", "category_id", "text", False), Field("amountMinor", "amount_minor", "amount"), Field("currency", "currency", "text"), Field("rollover", "rollover", "flag", False, 0), Field("alertBp", "alert_bp", "integer", False, 8000), *COMMON)),
        Spec("attachment", (Field("id", "id", "text"), Field("ledgerId", "ledger_id", "text"), Field("txnId", "txn_id", "text", False), Field("fileName", "file_name", "text"), Field("mime", "mime", "text"), Field("sizeBytes", "size_bytes", "integer"), Field("sha256", "sha256", "text"), Field("storage", "storage", "integer", allowed=(1, 2)), Field("dataB64", "data", "bytes", False), Field("extRelPath", "ext_rel_path", "text", False), Field("wrappedDek", "wrapped_dek", "bytes", False), Field("dekNonce", "dek_nonce", "bytes", False), Field("width", "width", "integer", False), Field("height", "height", "integer", False), *COMMON)),
    )
}
KIND_TYPES = {"text": T.StringType(), "integer": T.LongType(), "flag": T.LongType(), "amount": T.LongType(), "ids": T.ArrayType(T.StringType()), "object": T.StringType(), "bytes": T.BinaryType()}


def _encoded(f: Field) -> Column:
    c = F.col(f.column)
    if f.kind == "ids":
        return F.coalesce(c, F.array().cast("array<string>"))
    if f.kind == "object":
        return F.parse_json(F.coalesce(c, F.lit("{}")))
    # base64 may come in lines of 76 characters
    return F.translate(F.base64(c), "\r\n", "") if f.kind == "bytes" else c


def record_lines(rows: DataFrame, kind: str) -> DataFrame:
    """(stage, id, line): a record's JSON, `type` first, keys in the type's order, nulls kept."""
    spec = SPECS[kind]
    fields = [f for f in spec.fields if f.column in rows.columns]
    body = F.to_json(F.struct(F.lit(kind).alias("type"), *[_encoded(f).alias(f.key) for f in fields]), {"ignoreNullFields": "false"})
    return rows.select(F.lit(kind).alias("stage"), F.col("id").cast("string").alias("id"), body.alias("line"))


def digests(lines: DataFrame) -> DataFrame:
    """(stage, n, digest) of lines (stage, id, line): SHA-256 over the digests of hash bins of ids, each over its
    lines' hashes in order. The same records give the same digest, however they are partitioned."""
    bins = lines.withColumn("_bin", F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(BINS)))
    # a bin's hashes are summed as two 60-bit numbers of salted hashes: order-free, and no bin is gathered
    salted = F.sha2(F.concat_ws("\n", "id", "line"), 256)
    part = lambda at: F.sum(F.conv(F.substring(salted, at, 12), 16, 10).cast("decimal(20,0)"))
    sums = bins.groupBy("stage", "_bin").agg(F.count("*").alias("n"), part(1).alias("a"), part(13).alias("b"), part(25).alias("c"))
    text = F.concat_ws(":", F.col("_bin").cast("string"), F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string"))
    return sums.groupBy("stage").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(text)), "\n"), 256).alias("digest"))


def write_changeset(tables: dict[str, DataFrame], path: str, generated_at: int, export_kind: str = "full", ledger_ids: list[str] | None = None) -> dict:
    """Writes the tables (by record type) as change-set files under path and returns the manifest.

    Record lines go to path/records, by stage and id; manifest and end line to path/manifest and path/end.
    """
    unknown = set(tables) - set(SPECS)
    if unknown or not tables:
        raise ValueError(f"record types: {sorted(unknown) or 'none'}")
    if export_kind == "ledger" and not ledger_ids:
        raise ValueError("an export of ledgers names them")
    order = list(SPECS)
    lines = None
    for kind in sorted(tables, key=order.index):
        part = record_lines(tables[kind], kind)
        lines = part if lines is None else lines.unionByName(part)
    spark = lines.sparkSession
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("stage"))
    lines.withColumn("_rank", rank).repartitionByRange("_rank", "id").sortWithinPartitions("_rank", "id").select("line").write.text(f"{path}/records")
    found = {r["stage"]: r.asDict() for r in digests(lines).collect()}  # a row a stage
    counts = {k: int(found[k]["n"]) if k in found else 0 for k in sorted(tables, key=order.index)}
    content = hashlib.sha256("\n".join(f"{k}:{found[k]['digest']}" for k in counts if k in found).encode()).hexdigest()
    manifest = {"type": "manifest", "formatVersion": 1, "exportKind": export_kind, "ledgerIds": ledger_ids or [], "generatedAt": generated_at, "counts": counts, "contentHash": content}
    spark.createDataFrame([(json.dumps(manifest),)], "line string").coalesce(1).write.text(f"{path}/manifest")
    spark.createDataFrame([(json.dumps({"type": "end", "recordCount": sum(counts.values())}),)], "line string").coalesce(1).write.text(f"{path}/end")
    return manifest


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stage, id, line) of a change set's records; a line that is no JSON object has a null stage."""
    parsed = F.from_json("value", "type string, id string")
    return spark.read.text(f"{path}/records").select(parsed["type"].alias("stage"), parsed["id"].alias("id"), F.col("value").alias("line"))


def _raw(f: Field) -> Column:
    """A field's JSON text, or a string's characters, of the line as parsed by read_records()."""
    return F.col("_line")[f.key]


def _value(f: Field) -> Column:
    raw = _raw(f)
    if f.kind in ("integer", "flag", "amount"):
        value = F.when(raw.rlike("^-?[0-9]{1,18}$"), raw.try_cast("long"))
    elif f.kind == "ids":
        value = F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))
    elif f.kind == "bytes":
        value = F.try_to_binary(raw, F.lit("base64"))
    else:
        value = raw
    return value if f.default is None or f.kind == "ids" else F.coalesce(value, F.lit(f.default))


def _error(f: Field) -> Column:
    raw = _raw(f)
    out = F.when(raw.isNull(), F.lit(f"{f.key}: missing") if f.required else F.lit(None).cast("string"))
    if f.kind == "text":
        out = out.when(raw == "", f"{f.key}: empty").when(F.octet_length(raw) > MOST_TEXT, f"{f.key}: too long")
        if f.key == "id":
            out = out.when(~raw.rlike(ID_PATTERN), f"{f.key}: unsafe")
    elif f.kind in ("integer", "flag", "amount"):
        out = out.when(~raw.rlike("^-?[0-9]{1,18}$"), f"{f.key}: no integer")
        if f.kind == "flag":
            out = out.when(~raw.isin("0", "1"), f"{f.key}: no flag")
        if f.kind == "amount":
            out = out.when(F.abs(raw.try_cast("long")) > MOST_AMOUNT, f"{f.key}: out of range")
        if f.allowed:
            out = out.when(~raw.try_cast("long").isin(*f.allowed), f"{f.key}: not allowed")
    elif f.kind == "ids":
        ids = F.from_json(raw, "array<string>")
        out = out.when(ids.isNull(), f"{f.key}: no list").when(F.size(ids) > MOST_IDS, f"{f.key}: too many")
    elif f.kind == "object":
        out = out.when(~F.trim(raw).startswith("{") | (F.regexp_replace(raw, r"\s", "") == "{}"), f"{f.key}: no object")
    elif f.kind == "bytes":
        out = out.when(F.try_to_binary(raw, F.lit("base64")).isNull(), f"{f.key}: no base64")
    return out


def read_records(lines: DataFrame, kind: str) -> DataFrame:
    """A type's records from read_lines(): its columns, typed and with defaults, and violations, an array of texts. Each
    line is parsed once, all fields as text."""
    spec = SPECS[kind]
    schema = ", ".join(f"`{f.key}` string" for f in spec.fields)
    rows = lines.where(F.col("stage") == kind).select(F.from_json("line", schema).alias("_line"))
    return rows.select(*[_value(f).cast(KIND_TYPES[f.kind]).alias(f.column) for f in spec.fields], F.array_compact(F.array(*map(_error, spec.fields))).alias("violations"))


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def verify(spark: SparkSession, path: str, most_records: int | None = MOST_RECORDS) -> dict:
    """Checks a change set's counts, end line and content hash and returns its manifest; a mismatch raises, as do more
    than most_records records (None: any number)."""
    manifest = read_manifest(spark, path)
    end = json.loads(spark.read.text(f"{path}/end").first()[0])
    lines = read_lines(spark, path)
    found = {r["stage"]: r.asDict() for r in digests(lines).collect()}
    total = sum(int(r["n"]) for r in found.values())
    if most_records is not None and total > most_records:
        raise ValueError("too many records")
    if end["recordCount"] != total:
        raise ValueError(f"the end line has {end['recordCount']} records, the files {total}")
    for kind, n in manifest["counts"].items():
        if n != (int(found[kind]["n"]) if kind in found else 0):
            raise ValueError(f"{kind}: {n} declared, {found.get(kind, {}).get('n', 0)} found")
    known = [k for k in manifest["counts"] if k in found]
    if hashlib.sha256("\n".join(f"{k}:{found[k]['digest']}" for k in known).encode()).hexdigest() != manifest["contentHash"]:
        raise ValueError("content hash")
    return manifest

"""Exports: what a request selects, the manifest that says so, and a report to compare implementations by."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.changeset import SPECS, record_lines
from ledgerloom.sources.payload import decode

SCOPES = {"all": "full", "time_range": "range", "ledger": "ledger", "incremental": "incremental"}
#: Volume sizes in bytes.
DEFAULT_VOLUME, LEAST_VOLUME = 64 * 1024 * 1024, 1024 * 1024


@dataclass(frozen=True)
class Request:
    scope: str = "all"
    from_ms: int | None = None
    to_ms: int | None = None
    ledger_ids: list[str] = field(default_factory=list)
    since_ms: int | None = None
    include_attachments: bool = False
    volume_bytes: int = DEFAULT_VOLUME

    def validate(self) -> None:
        if self.scope not in SCOPES:
            raise ValueError(f"scope {self.scope!r}")
        if self.scope == "time_range" and (self.from_ms is None or self.to_ms is None or self.from_ms > self.to_ms):
            raise ValueError("a time range has a start, and an end that isn't before it")
        if self.scope == "ledger" and not self.ledger_ids:
            raise ValueError("a ledger export names its ledgers")
        if self.scope == "incremental" and self.since_ms is None:
            raise ValueError("an incremental export says since when")
        if self.volume_bytes < LEAST_VOLUME:
            raise ValueError("volumes are too small")


def select(tables: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
    """The rows that a request exports. A time range limits transactions and their attachments and keeps what they refer
    to; ledgers limit all but themes; an incremental export takes what changed since."""
    request.validate()
    out = dict(tables) if request.include_attachments else {k: df for k, df in tables.items() if k != "attachment"}
    if request.scope == "time_range" and "txn" in out:
        out["txn"] = out["txn"].where(F.col("occurred_at").between(request.from_ms, request.to_ms))
        if "attachment" in out:
            out["attachment"] = out["attachment"].join(out["txn"].select(F.col("id").alias("txn_id")), "txn_id", "left_semi")
    if request.scope == "ledger":
        column = lambda k: F.col("id" if k == "ledger" else "ledger_id")
        out = {k: df if k == "theme" else df.where(column(k).isin(request.ledger_ids)) for k, df in out.items()}
    if request.scope == "incremental":
        out = {k: df.where(F.col("updated_at") >= request.since_ms) for k, df in out.items()}
    return out


def manifest(request: Request, counts: dict[str, int], device_id: str, exported_at: int, sequence: tuple[int, int] | None = None) -> dict:
    """The manifest of a request's export; the content hash is the encoder's."""
    request.validate()
    out: dict = {"type": "manifest", "deviceId": device_id, "exportedAt": exported_at, "exportKind": SCOPES[request.scope]}
    if request.scope == "time_range":
        out["range"] = {"from": request.from_ms, "to": request.to_ms}
    if request.scope == "ledger":
        out["ledgerIds"] = list(request.ledger_ids)
    if request.scope == "incremental":
        low, high = sequence or (0, 0)
        out |= {"sinceExportAt": request.since_ms, "changeLogRange": {"minSeq": low, "maxSeq": high}}
    return out | {"includesAttachments": request.include_attachments, "counts": counts}


def line_hashes(rows: DataFrame, kind: str) -> DataFrame:
    """(stage, id, line_sha256, canonical_sha256): hashes of a type's record lines as written and with sorted keys, for
    comparison with another implementation's."""
    lines = record_lines(rows, kind)
    return lines.select("stage", "id", F.sha2("line", 256).alias("line_sha256"), F.sha2(F.to_json(F.parse_json("line")), 256).alias("canonical_sha256"))


def stages(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables as an export writes them: by stage, each type's own columns in their order, rows by id."""
    out = {}
    for kind, spec in SPECS.items():
        if kind in tables:
            known = [f.column for f in spec.fields if f.column in tables[kind].columns]
            out[kind] = tables[kind].select(*known).orderBy("id")
    return out


def report(spark: SparkSession, file: bytes, plain: bytes, inner: bytes) -> tuple[dict[str, str], DataFrame]:
    """Hashes by which two implementations compare an export, from outside in: the file, what it decrypts to, the payload
    that this inflates to, and each of its record lines (stage, id, line_sha256, canonical_sha256)."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    lines = decode(inner).lines(spark)
    hashes = lines.select("stage", "id", F.sha2("line", 256).alias("line_sha256"), F.sha2(F.to_json(F.parse_json("line")), 256).alias("canonical_sha256"))
    return {"file": sha(file), "plain": sha(plain), "payload": sha(inner)}, hashes

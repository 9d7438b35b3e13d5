"""Schema migrations of a store: an unbroken chain of steps, each with a checksum, each a version of the store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerloom.sources.store import Store

TABLE = "schema_migration"
SCHEMA = "version int, name string, checksum string, applied_at long"


class NewerSchema(ValueError):
    """The store is ahead of this code."""


@dataclass(frozen=True)
class Migration:
    """A step to `version`: statements are SQL over the store's tables, as (table, query); apply is any function of the
    tables besides."""

    version: int
    name: str
    statements: tuple[tuple[str, str], ...] = ()
    apply: Callable[[dict[str, DataFrame]], dict[str, DataFrame]] | None = None

    def checksum(self) -> str:
        text = "\n".join(f"{t}:{' '.join(q.split())}" for t, q in self.statements)
        return hashlib.sha256(f"{self.version}\n{self.name}\n{text}".encode()).hexdigest()


def plan(now: int, target: int, known: list[Migration]) -> list[Migration]:
    """The steps from one version to another; a gap, a version given twice, or a way back is an error."""
    if now == target:
        return []
    if now > target:
        raise NewerSchema(f"the store has version {now}, this code {target}")
    if now < 0:
        raise ValueError("version below zero")
    by_version = {m.version: m for m in known}
    if len(by_version) != len(known):
        raise ValueError("two migrations of one version")
    if missing := [v for v in range(now + 1, target + 1) if v not in by_version]:
        raise ValueError(f"no migration to version {missing[0]}")
    return [by_version[v] for v in range(now + 1, target + 1)]


def applied(store: Store) -> list[tuple[int, str]]:
    """(version, checksum) of the steps that the store has."""
    if store.current() is None or TABLE not in store.tables():
        return []
    return sorted((r["version"], r["checksum"]) for r in store.read(TABLE).collect())


def migrate(store: Store, target: int, known: list[Migration], now_ms: int) -> int:
    """Brings the store to the target and returns the number of steps. A step whose checksum differs from what the store
    recorded is an error. Each step is committed as a whole."""
    done = applied(store)
    by_version = {m.version: m for m in known}
    for version, checksum in done:
        if version in by_version and by_version[version].checksum() != checksum:
            raise ValueError(f"migration {version} was changed after it ran")
    steps = plan(done[-1][0] if done else 0, target, known)
    spark = store.spark
    for step in steps:
        tables = {} if store.current() is None else {n: store.read(n) for n in store.tables()}
        changed: dict[str, DataFrame] = {}
        for table, query in step.statements:
            for name, df in {**tables, **changed}.items():
                df.createOrReplaceTempView(name)
            changed[table] = spark.sql(query)
        if step.apply:
            changed |= step.apply({**tables, **changed})
        row = spark.createDataFrame([(step.version, step.name, step.checksum(), now_ms)], SCHEMA)
        changed[TABLE] = tables[TABLE].unionByName(row) if TABLE in tables else row
        store.commit(changed)
    return len(steps)

"""Export requests, identifiers, migrations."""

import pytest

from ledgerloom.functions.identifiers import Ulids, encode
from ledgerloom.sources import export, migration, payload, seed, store


def test_requests(spark):
    tables = seed.sample(spark)
    for bad in (export.Request("x"), export.Request("time_range", 1), export.Request("time_range", 2, 1), export.Request("ledger"), export.Request("incremental"), export.Request(volume_bytes=1)):
        with pytest.raises(ValueError):
            export.select(tables, bad)
    n = lambda r: {k: df.count() for k, df in export.select(tables, r).items()}
    assert n(export.Request()) == {"ledger": 1, "category": 2, "account": 2, "txn": 3}
    assert n(export.Request("time_range", 0, 1))["txn"] == 0 and n(export.Request("ledger", ledger_ids=["L2"]))["account"] == 0
    assert n(export.Request("incremental", since_ms=seed.BASE_MS + 1))["txn"] == 0
    for r in (export.Request(), export.Request("time_range", 1, 2), export.Request("ledger", ledger_ids=["L1"]), export.Request("incremental", since_ms=5)):
        payload.check_scope(export.manifest(r, {}, "d", 1))
    hashes = export.line_hashes(tables["txn"], "txn").collect()
    assert len({r["line_sha256"] for r in hashes}) == 3 and all(r["line_sha256"] != r["canonical_sha256"] for r in hashes)


def test_ulids_grow():
    times = iter([5, 5, 3, 6, 6])
    draws = iter([7, 2**80 - 1, 1])
    made = Ulids(lambda: next(times), lambda: next(draws))
    got = [made.next() for _ in range(5)]
    assert got == [encode(5, 7), encode(5, 8), encode(5, 9), encode(6, 2**80 - 1), encode(7, 1)] == sorted(got)
    assert encode(1735689600000, 0x00010203040506070809) == "01JGFJJZ00000G40R40M30E209"


def test_migrations(spark, tmp_path):
    kept = store.Store(spark, str(tmp_path / "store"))
    steps = [
        migration.Migration(1, "first", (("ledger", "select 'L1' as id, 'x' as name"),)),
        migration.Migration(2, "color", (("ledger", "select *, cast(null as string) as color from ledger"),)),
        migration.Migration(3, "code", apply=lambda t: {"ledger": t["ledger"].withColumnRenamed("name", "title")}),
    ]
    assert migration.migrate(kept, 2, steps, 9) == 2 and kept.read("ledger").columns == ["id", "name", "color"]
    assert migration.migrate(kept, 3, steps, 9) == 1 and kept.read("ledger").columns == ["id", "title", "color"]
    assert migration.migrate(kept, 3, steps, 9) == 0 and [v for v, _ in migration.applied(kept)] == [1, 2, 3]
    with pytest.raises(migration.NewerSchema):
        migration.migrate(kept, 2, steps, 9)
    with pytest.raises(ValueError, match="changed"):
        migration.migrate(kept, 3, [migration.Migration(1, "other"), *steps[1:]], 9)
    with pytest.raises(ValueError, match="no migration"):
        migration.plan(0, 3, steps[1:])
    with pytest.raises(ValueError, match="two"):
        migration.plan(0, 3, [*steps, steps[0]])

"""End to end: sample ledger, payload, container, import, store, dumps."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balance, importer
from ledgerloom.sources import changeset, container, payload, seed, store

MANIFEST = {"type": "manifest", "appVersion": "1.0.0", "deviceId": "d", "exportedAt": 1, "exportKind": "full", "includesAttachments": False}


def exported(tables):
    """Tables as a payload's bytes."""
    stages = {}
    for kind, df in tables.items():
        lines = [json.loads(r["line"]) for r in changeset.record_lines(df, kind).orderBy("id").collect()]
        stages[kind] = [{k: v for k, v in x.items() if k != "type"} for x in lines]
    return payload.encode({**MANIFEST, "counts": {k: len(v) for k, v in stages.items()}}, stages, 2)


def imported(spark, data, kinds):
    lines = payload.decode(data).lines(spark)
    return {k: changeset.read_records(lines, k) for k in kinds}


def test_empty_payload_is_the_known_one():
    manifest = {"type": "manifest", "appVersion": "1.0.0", "deviceId": "01J8Z9K2M4P6Q8R0T2V4X6Z8B1", "deviceName": "向量生成器", "platform": "android", "exportedAt": 1757922436790, "exportKind": "full", "includesAttachments": False, "counts": {}}
    data, n, digest = payload.encode(manifest, {}, 1757922437001)
    assert (n, digest) == (0, "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")
    assert data.decode().split("\n")[1] == '{"type":"end","recordCount":0,"contentHash":"sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855","generatedAt":1757922437001}'
    assert '"deviceName":"向量生成器"' in data.decode() and payload.decode(data).records == []


def test_sample_balances(spark):
    t = seed.sample(spark)
    cached = balance.apply_balances(t["account"], t["txn"])
    assert {r["id"]: r["cached_balance_minor"] for r in cached.collect()} == {"A1": 165275, "A2": 30000}
    assert balance.net_worth(cached).first()[0] == 195275
    s = balance.summary(t["txn"]).first()
    assert (s["income_minor"], s["expense_minor"], s["transfer_minor"]) == (120000, 4725, 30000)


def test_round_trip(spark, tmp_path):
    """Export, seal, open, import into an empty store: dumps are equal; a second import changes nothing."""
    tables = seed.sample(spark)
    data, n, _ = exported(tables)
    assert n == 8
    key = bytes(range(32))
    file = container.export(spark, data, key, container.Header(bytes(16), bytes(8), 0, 0))
    back = container.inflated(container.open_file(spark, file, key))
    assert back == data
    empty = {k: df.limit(0) for k, df in tables.items()}
    options = importer.Options(strategy="converge", now_ms=5)
    state, report = importer.apply_import(empty, imported(spark, back, tables), options)
    assert {k: c["inserted"] for k, c in report.counters.items()} == {"ledger": 1, "category": 2, "account": 2, "txn": 3}
    assert seed.differences(tables, state) == [] and report.conflicts.isEmpty() and report.placeholders == 0
    again, report = importer.apply_import(state, imported(spark, back, tables), options)
    assert seed.differences(state, again) == [] and sum(c["skipped"] for c in report.counters.values()) == 8
    known = {importer.file_hash(file)}
    assert importer.apply_import(state, {}, options, known, importer.file_hash(file))[1].skipped_as_known

    kept = store.Store(spark, str(tmp_path / "store"))
    assert kept.current() is None and kept.versions() == []
    assert kept.commit(state) == 1
    changed = state["txn"].withColumn("amount_minor", F.col("amount_minor") + 1)
    assert kept.commit({"txn": changed}) == 2 and kept.tables() == ["account", "category", "ledger", "txn"]
    assert seed.differences({"txn": changed}, {"txn": kept.read("txn")}) == []
    kept.rollback(1)
    assert kept.current() == 1 and seed.differences(state, {k: kept.read(k) for k in state}) == []
    kept.drop(2)
    assert kept.versions() == [1]
    with pytest.raises(ValueError):
        kept.drop(1)


def test_repairs_and_guards(spark):
    tables = seed.sample(spark)
    txn = tables["txn"].withColumn("account_id", F.when(F.col("id") == "T1", "LOST").otherwise(F.col("account_id"))).withColumn("updated_at", F.col("updated_at") + 100_000)
    category = tables["category"].withColumn("parent_id", F.when(F.col("id") == "C1", F.lit("NOBODY")))
    data, _, _ = exported({"txn": txn, "category": category.withColumn("updated_at", F.col("updated_at") + 100_000)})
    records = imported(spark, data, ["txn", "category"])
    state, report = importer.apply_import(tables, records, importer.Options(strategy="converge", now_ms=9))
    assert report.placeholders == 1 and report.promoted == 1 and report.counters["txn"]["updated"] == 1
    assert state["account"].where("id = 'LOST'").count() == 1 and state["category"].where("parent_id is not null").isEmpty()
    with pytest.raises(ValueError, match="conflicts"):
        importer.apply_import(tables, records, importer.Options())
    only = imported(spark, exported({"txn": tables["txn"].where("id = 'T1'")})[0], ["txn"])
    replace = importer.Options(mode="replace", target_ledger="L1", now_ms=77)
    with pytest.raises(ValueError, match="removed"):
        importer.apply_import(tables, only, replace)
    replace.allow_removals = True
    state, _ = importer.apply_import(tables, only, replace)
    assert {r["id"]: r["deleted_at"] for r in state["txn"].collect()} == {"T1": None, "T2": 77, "T3": 77}
    mapped, _ = importer.apply_import({k: df.limit(0) if k != "ledger" else df.withColumn("id", F.lit("L9")) for k, df in tables.items()}, imported(spark, exported(tables)[0], tables), importer.Options(mode="supplement_only", ledger_map={"L1": "L9"}))
    assert {r["ledger_id"] for r in mapped["txn"].collect()} == {"L9"}


@pytest.mark.parametrize(
    "change",
    [
        lambda x: x[1:],
        lambda x: x[:-1],
        lambda x: [*x, x[1]],
        lambda x: [x[0], b"", *x[1:]],
        lambda x: [x[0], x[0], *x[1:]],
        lambda x: [x[0], x[1].replace(b"Household", b"Housebold"), *x[2:]],
        lambda x: [x[0].replace(b'"full"', b'"ledger"'), *x[1:]],
        lambda x: [x[0].replace(b'"payloadVersion":1', b'"payloadVersion":2'), *x[1:]],
        lambda x: [x[0].replace(b'"ledger":1', b'"ledger":2'), *x[1:]],
        lambda x: [x[0], b"[1]", *x[1:]],
        lambda x: [x[0], b"\xff", *x[1:]],
    ],
)
def test_broken_payloads(spark, change):
    lines = exported({"ledger": seed.sample(spark)["ledger"]})[0].split(b"\n")[:-1]
    payload.decode(b"\n".join(lines))
    with pytest.raises(payload.PayloadError):
        payload.decode(b"\n".join(change(lines)))


def test_failures_are_named_where_they_are_raised():
    assert importer.failure(container.WrongKey("x")) == "wrong_key" and importer.failure(container.NewerFormat("x")) == "newer_format"
    assert importer.failure(container.ContainerError("x")) == "damaged" and importer.failure(KeyError("x")) == "damaged"
    assert importer.failure(payload.NewerPayload("x")) == "newer_format" and importer.failure(payload.PayloadError("x")) == "invalid_payload"
    assert importer.failure(importer.Refused("x")) == "invalid_records" and importer.failure(importer.BrokenReferences("x")) == "broken_references"


def local_ledger(spark):
    """The sample with columns that change sets don't carry."""
    tables = seed.sample(spark)
    tables["txn"] = tables["txn"].withColumns({"source_import_job": F.lit("job-0"), "merchant": F.lit("shop"), "note": F.col("id")})
    tables["account"] = tables["account"].withColumns({"cached_balance_minor": F.lit(7).cast("long"), "balance_as_of": F.lit(7).cast("long"), "note": F.lit("mine")})
    return tables


def test_records_set_only_the_columns_that_they_carry(spark):
    tables = local_ledger(spark)
    records = {k: df.drop("merchant", "note", "source_import_job", "cached_balance_minor", "balance_as_of") for k, df in tables.items()}
    for strategy in ("abort", "converge"):
        state, report = importer.apply_import(tables, records, importer.Options(strategy=strategy, now_ms=9))
        assert sum(c["skipped"] for c in report.counters.values()) == 8 and report.conflicts.isEmpty()
        assert seed.differences({k: tables[k] for k in tables if k != "account"}, {k: state[k] for k in state if k != "account"}) == []
        assert {r["id"]: (r["cached_balance_minor"], r["note"]) for r in state["account"].collect()} == {"A1": (165275, "mine"), "A2": (30000, "mine")}
    later = {"txn": records["txn"].withColumns({"amount_minor": F.col("amount_minor") + 5, "updated_at": F.col("updated_at") + 100_000})}
    state, report = importer.apply_import(tables, later, importer.Options(strategy="converge", now_ms=9))
    assert report.counters["txn"]["updated"] == 3
    assert {(r["merchant"], r["note"] == r["id"], r["source_import_job"]) for r in state["txn"].collect()} == {("shop", True, "job-0")}
    new = {"account": records["account"].withColumn("id", F.concat("id", F.lit("x"))).withColumn("cached_balance_minor", F.lit(99).cast("long"))}
    state, _ = importer.apply_import(tables, new, importer.Options(now_ms=9))
    assert {r["id"]: (r["note"], r["cached_balance_minor"], r["balance_as_of"]) for r in state["account"].collect() if r["id"].endswith("x")} == {"A1x": (None, 80_000, 0), "A2x": (None, 0, 0)}


def test_repair_comes_before_the_decisions(spark):
    """Placeholders are complete, also for budgets and repayments, and made for the records' references alone."""
    tables = local_ledger(spark)
    tables["budget"] = spark.createDataFrame([("B0", "L1", "OLD-GONE", "CNY", 1, 1, 1, None, "d", 1)], "id string, ledger_id string, category_id string, currency string, amount_minor long, created_at long, updated_at long, deleted_at long, device_id string, rev long")
    budget = tables["budget"].withColumns({"id": F.lit("B1"), "category_id": F.lit("0123456789")})
    account = tables["account"].where("id = 'A2'").withColumns({"repay_account_id": F.lit("PAYER"), "updated_at": F.lit(BASE := 1_758_000_200_000).cast("long")})
    tables["account"] = tables["account"].withColumn("repay_account_id", F.lit(None).cast("string"))
    txn = tables["txn"].where("id = 'T2'").withColumns({"id": F.lit("T9"), "account_id": F.lit("LOST"), "category_id": F.lit("INC"), "updated_at": F.lit(BASE).cast("long")})
    records = {"budget": budget, "account": account, "txn": txn}
    todo = importer.plan(tables, records, importer.Options(strategy="converge", now_ms=50, device_id="me"))
    accounts = {r["id"]: r.asDict() for r in todo.placeholders["account"].collect()}
    assert set(accounts) == {"PAYER", "LOST"}
    for r in accounts.values():
        assert (r["name"], r["type"], r["currency"], r["is_archived"], r["sort_order"], r["created_at"], r["updated_at"], r["rev"], r["device_id"], r["ledger_id"]) == ("missing account", 1, "CNY", 1, 0, 50, 50, 1, "me", "L1")
    assert {r["id"]: (r["kind"], r["name"], r["is_hidden"], r["is_system"], r["created_at"]) for r in todo.placeholders["category"].collect()} == {"0123456789": (1, "missing 23456789", 1, 0, 50), "INC": (2, "missing INC", 1, 0, 50)}
    with pytest.raises(importer.BrokenReferences):  # the state's own budget names a category that nobody has
        importer.apply_import(tables, records, importer.Options(strategy="converge", now_ms=50))
    tables["budget"] = tables["budget"].limit(0)
    state, report = importer.apply_import(tables, records, importer.Options(strategy="converge", now_ms=50))
    assert report.placeholders == 4 and [(r["entity"], r["record_id"], r["column"], r["kind"]) for r in report.fixes.collect()] == [("account", "A2", "repay_account_id", "placeholder_account"), ("budget", "B1", "category_id", "placeholder_category"), ("txn", "T9", "account_id", "placeholder_account"), ("txn", "T9", "category_id", "placeholder_category")]
    job = importer.job_record(spark, "j", "f", report, importer.Options(), 1, 1).first()
    assert (job["inserted"], job["updated"], job["removed"]) == (6, 1, 0)
    assert state["account"].where("id = 'LOST'").first()["cached_balance_minor"] == 120_000


def test_removals_reach_tables_that_the_file_lacks(spark):
    tables = seed.sample(spark)
    records = {"ledger": tables["ledger"], "txn": tables["txn"].where("id = 'T1'"), "account": tables["account"].where("id = 'A1'")}
    options = importer.Options(mode="replace", target_ledger="L1", now_ms=77, allow_removals=True)
    state, report = importer.apply_import(tables, records, options)
    gone = {k: sorted(r["id"] for r in df.where("deleted_at = 77").collect()) for k, df in state.items()}
    assert gone == {"ledger": [], "category": ["C1", "C2"], "account": ["A2"], "txn": ["T2", "T3"]} and report.removed == 5


def test_unsafe_ids_are_refused(spark):
    tables = seed.sample(spark)
    with pytest.raises(importer.Refused, match="unsafe"):
        importer.apply_import(tables, {"txn": tables["txn"].withColumn("id", F.concat("id", F.lit(" x")))}, importer.Options())

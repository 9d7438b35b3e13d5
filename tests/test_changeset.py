"""Change sets: round trip, tampering, typed reading."""

import pytest

from ledgerloom.sources import changeset

META = "created_at long, updated_at long, deleted_at long, device_id string, rev long"


def tables(spark):
    ledger = spark.createDataFrame([("L1", "Home \"é\" 家", "home", "CNY", 1, 0, 1, 2, None, "d", 1)], f"id string, name string, code string, currency string, is_default long, sort_order long, {META}")
    tag = spark.createDataFrame([(f"T{i:03d}", "L1", f"tag {i}", None, 1, 2, None, "d", 1) for i in range(50)], f"id string, ledger_id string, name string, color string, {META}")
    return {"ledger": ledger, "tag": tag}


def test_round_trip(spark, tmp_path):
    path = str(tmp_path / "set")
    manifest = changeset.write_changeset(tables(spark), path, 7)
    assert manifest["counts"] == {"ledger": 1, "tag": 50}
    assert changeset.verify(spark, path)["contentHash"] == manifest["contentHash"]
    lines = changeset.read_lines(spark, path)
    for kind, rows in tables(spark).items():
        back = changeset.read_records(lines, kind)
        assert back.where("size(violations) > 0").isEmpty()
        assert sorted(map(tuple, back.select(*rows.columns).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    again = changeset.write_changeset({k: v.repartition(7) for k, v in tables(spark).items()}, str(tmp_path / "again"), 7)
    assert again["contentHash"] == manifest["contentHash"]


def test_tampering(spark, tmp_path):
    path = str(tmp_path / "set")
    changeset.write_changeset(tables(spark), path, 7)
    lines = [r[0] for r in spark.read.text(f"{path}/records").collect()]
    for name, changed in (("changed", [lines[0].replace("Home", "Hame"), *lines[1:]]), ("cut", lines[1:]), ("doubled", [*lines, lines[-1]])):
        bad = str(tmp_path / name)
        for part in ("manifest", "end"):
            spark.read.text(f"{path}/{part}").coalesce(1).write.text(f"{bad}/{part}")
        spark.createDataFrame([(x,) for x in changed], "line string").write.text(f"{bad}/records")
        with pytest.raises(ValueError):
            changeset.verify(spark, bad)


def test_violations(spark):
    rows = [('{"type":"account","id":"","accountType":9,"openingBalanceMinor":1.5,"isArchived":2}',), ("no json",)]
    lines = spark.createDataFrame(rows, "value string")
    from pyspark.sql import functions as F

    parsed = F.from_json("value", "type string, id string")
    lines = lines.select(parsed["type"].alias("stage"), parsed["id"].alias("id"), F.col("value").alias("line"))
    found = set(changeset.read_records(lines, "account").first()["violations"])
    assert {"id: empty", "accountType: not allowed", "openingBalanceMinor: no integer", "isArchived: no flag", "ledgerId: missing"} <= found


def test_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        changeset.write_changeset({"nothing": spark.range(1)}, str(tmp_path / "x"), 1)
    with pytest.raises(ValueError):
        changeset.write_changeset(tables(spark), str(tmp_path / "y"), 1, "ledger")


def test_bytes_are_one_line_of_base64(spark):
    import base64
    import json

    data = bytes(range(256))
    rows = spark.createDataFrame([("f", "l", bytearray(data))], "id string, ledger_id string, data binary")
    line = json.loads(changeset.record_lines(rows, "attachment").first()["line"])
    assert line["dataB64"] == base64.b64encode(data).decode()

"""Streams end where the batch operators do."""

from ledgerloom.operators import balance, merge, versions
from ledgerloom.sources import adapter
from ledgerloom.streaming import upsert


def played(spark, frame, tmp_path, name, transform, mode):
    """Runs a transformation over the frame's rows as a stream of three files and returns what the sink has."""
    path = str(tmp_path / f"{name}-in")
    frame.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = transform(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_winners(spark, sf_dir, tmp_path):
    rows = adapter.versions(spark, sf_dir)
    got = played(spark, rows, tmp_path, "winners", upsert.winners, "complete")
    want = versions.reduce_versions(rows, 15).drop("needs_review")
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_totals(spark, sf_dir, tmp_path):
    rows = adapter.txns(spark, sf_dir)
    got = played(spark, rows, tmp_path, "totals", upsert.account_totals, "complete")
    want = {(r["id"], r["balance_minor"], r["balance_as_of"]) for r in balance.balances(adapter.accounts(spark, sf_dir).limit(0), rows).collect()}
    assert set(map(tuple, got.collect())) == want


def test_daily(spark, sf_dir, tmp_path):
    rows = adapter.txns(spark, sf_dir).orderBy("occurred_at").coalesce(1)
    got = played(spark, rows, tmp_path, "daily", upsert.daily_totals, "complete")
    assert got.agg({"n": "sum"}).first()[0] == rows.where("deleted_at is null").count()


def test_merge_batches(spark, sf_dir, tmp_path):
    local, remote = adapter.replica(spark, sf_dir, "local"), adapter.replica(spark, sf_dir, "remote")
    local.write.parquet(str(tmp_path / "state-0"))
    now = {"path": str(tmp_path / "state-0")}

    def write(df, number):
        path = str(tmp_path / f"state-{number + 1}")
        df.write.mode("overwrite").parquet(path)
        now["path"] = path

    path = str(tmp_path / "in")
    remote.union(remote.limit(20)).repartition(3, "id").write.parquet(path)
    stream = spark.readStream.schema(remote.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = stream.writeStream.foreachBatch(upsert.merge_batches(lambda: spark.read.parquet(now["path"]), write)).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    want = merge.next_state(local, remote, merge.decide(remote, local, "merge", "converge"))
    assert sorted(map(tuple, spark.read.parquet(now["path"]).collect())) == sorted(map(tuple, want.collect()))


def test_merge_buckets(spark, sf_dir, tmp_path):
    """Only touched buckets are rewritten; a batch that runs twice changes nothing more."""
    local, remote = adapter.replica(spark, sf_dir, "local"), adapter.replica(spark, sf_dir, "remote")
    path = str(tmp_path / "state")
    upsert.write_buckets(local, path, 8)
    run = upsert.merge_buckets(path, 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    one = remote.orderBy("id").limit(1)
    run(one, 0)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("*.parquet")}
    changed = {p.parent.name for p in set(after.items()) ^ set(before.items()) for p in [p[0]]}
    assert len(changed) == 1
    parts = remote.union(remote.limit(20)).randomSplit([1.0, 1.0], seed=3)
    for n, part in enumerate([*parts, parts[1]]):
        run(part, n)
    want = merge.next_state(local, remote, merge.decide(remote, local, "merge", "converge"))
    assert sorted(map(tuple, upsert.read_buckets(spark, path).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    run(remote.limit(0), 9)

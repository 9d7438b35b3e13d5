"""Queries over change sets, imports, exports, containers and stores, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import crypto, scalars
from ledgerloom.operators import balance, checks, importer, lists, merge, raw, repair, versions, writes
from ledgerloom.plans import sql
from ledgerloom.plans.base import query
from ledgerloom.sources import adapter, changeset, container, export, migration, payload
from ledgerloom.sources.store import Store, scratch

NOW = adapter.BASE_MS + 86_400_000
LATER = adapter.BASE_MS + 100_000
A, T = sql.with_(sql.ACCOUNT), sql.with_(sql.TXN)


def text(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("string") for n in names}


def place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


# lookups and entries


@query(A + "SELECT id, name FROM account WHERE id = 7")
def lookup_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.by_id(adapter.accounts(spark, sf_dir), 7).select("id", "name")


@query(sql.with_(sql.LEDGER) + "SELECT id, code FROM ledger WHERE code = 'L11'")
def lookup_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.by_id(adapter.ledgers(spark, sf_dir), "L11", "code").select("id", "code")


@query("""SELECT key, value, row_number() OVER (ORDER BY key) AS position FROM (SELECT r_name AS key, 'old' AS value FROM region
  UNION ALL SELECT n_name, 'new' FROM nation WHERE n_name NOT IN (SELECT r_name FROM region))""")
def meta_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries put where absent, in order of key."""
    regions, nations = adapter.table(spark, sf_dir, "region"), adapter.table(spark, sf_dir, "nation")
    entry = lambda df, name, value: df.select(F.col(name).alias("key"), F.lit(value).alias("value"))
    put = lists.put_if_absent(entry(regions, "r_name", "old"), entry(nations, "n_name", "new").unionByName(entry(regions, "r_name", "new")))
    return lists.meta_list(put).withColumn("position", F.row_number().over(Window.orderBy("key")).cast("long"))


@query(sql.with_(sql.ACCOUNT, sql.TXN) + "SELECT id FROM account EXCEPT SELECT account_id FROM txn EXCEPT SELECT to_account_id FROM txn")
def unused_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.txns(spark, sf_dir)
    return adapter.accounts(spark, sf_dir).select("id").subtract(rows.select("account_id")).subtract(rows.select("to_account_id"))


# record lines: typed decoding with defaults and violations

#: Planted by the number's last digit: a missing name, an unknown type, text for a number, an empty reference, a flag that
#: is none, an id with a space, an amount out of range, no optional field at all, a broken number.
ACCOUNT_LINE = """'{"type":"account","id":"' || CASE k WHEN 6 THEN 'a ' ELSE 'a' END || n || '","ledgerId":"' || CASE k WHEN 4 THEN '' ELSE 'l' || n % 25 END || '"'
  || CASE k WHEN 1 THEN '' ELSE ',"name":"Name ' || n || '"' END || ',"accountType":' || CASE k WHEN 2 THEN 9 ELSE n % 5 + 1 END || ',"currency":"CNY"'
  || CASE k WHEN 8 THEN '' ELSE ',"openingBalanceMinor":' || CASE k WHEN 3 THEN '"x1"' WHEN 7 THEN '1000000000000001' ELSE CAST(n * 10 AS VARCHAR(20)) END || ',"isArchived":' || CASE k WHEN 5 THEN 2 ELSE n % 2 END || ',"note":null' END
  || ',"createdAt":1,"updatedAt":' || n || ',"deletedAt":' || CASE k WHEN 9 THEN '1.5' ELSE 'null' END || ',"deviceId":"d"}'"""


@query(
    """SELECT CASE k WHEN 6 THEN 'a ' ELSE 'a' END || n AS id, CASE k WHEN 4 THEN '' ELSE 'l' || n % 25 END AS ledger_id, CASE WHEN k <> 1 THEN 'Name ' || n END AS name, CASE k WHEN 2 THEN 9 ELSE n % 5 + 1 END AS type,
  CASE WHEN k IN (3, 8) THEN 0 WHEN k = 7 THEN 1000000000000001 ELSE n * 10 END AS opening_balance_minor, CASE WHEN k = 8 THEN 0 WHEN k = 5 THEN 2 ELSE n % 2 END AS is_archived, CAST(NULL AS BIGINT) AS deleted_at, CAST(1 AS BIGINT) AS rev, n AS updated_at,
  CASE k WHEN 1 THEN 'name: missing' WHEN 2 THEN 'accountType: not allowed' WHEN 3 THEN 'openingBalanceMinor: no integer' WHEN 4 THEN 'ledgerId: empty' WHEN 5 THEN 'isArchived: no flag' WHEN 6 THEN 'id: unsafe'
    WHEN 7 THEN 'openingBalanceMinor: out of range' WHEN 9 THEN 'deletedAt: no integer' ELSE '' END AS violations
FROM (SELECT c_custkey AS n, c_custkey % 10 AS k FROM customer)"""
)
def account_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.table(spark, sf_dir, "customer").selectExpr("c_custkey AS n", "c_custkey % 10 AS k")
    lines = rows.select(F.lit("account").alias("stage"), F.lit(None).cast("string").alias("id"), F.expr(ACCOUNT_LINE.replace("VARCHAR(20)", "STRING")).alias("line"))
    got = changeset.read_records(lines, "account").withColumn("violations", F.array_join("violations", "; "))
    return got.select("id", "ledger_id", "name", "type", "opening_balance_minor", "is_archived", "deleted_at", "rev", "updated_at", "violations")


def common(at: Column | None = None) -> dict[str, Column]:
    return {"created_at": F.lit(1).cast("long"), "updated_at": F.lit(NOW) if at is None else at, "device_id": F.lit("device-a"), "rev": F.lit(1).cast("long")}


def reread(rows: DataFrame, kind: str) -> DataFrame:
    """Rows as record lines, read again."""
    return changeset.read_records(changeset.record_lines(rows, kind), kind)


@query(T + "SELECT CAST(id AS VARCHAR) AS id, amount_minor, fee_minor, CAST(to_account_id AS VARCHAR) AS to_account_id, category_id, CASE WHEN id % 3 = 0 THEN '' ELSE 'tag' || id % 7 || ',tag' || id % 5 END AS tags, excluded_from_stats, CAST(0 AS BIGINT) AS is_reimbursable, deleted_at, CAST(0 AS BIGINT) AS n_violations FROM (SELECT * REPLACE (CAST(excluded_from_stats AS BIGINT) AS excluded_from_stats) FROM txn)")
def txn_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with lists of tags as record lines, read again; a missing flag gets its default."""
    rows = adapter.txns(spark, sf_dir).withColumns(text("id", "ledger_id", "account_id", "to_account_id") | common())
    at, tz = F.col("occurred_at"), F.col("tz_offset_min")
    tag = lambda n: F.concat(F.lit("tag"), (F.col("id").cast("long") % n).cast("string"))
    rows = rows.withColumns({"day_key": scalars.day_key(at, tz), "month_key": scalars.month_key(at, tz), "tags": F.when(F.col("id").cast("long") % 3 != 0, F.array(tag(7), tag(5)))})
    return reread(rows, "txn").select("id", "amount_minor", "fee_minor", "to_account_id", "category_id", F.array_join("tags", ",").alias("tags"), "excluded_from_stats", "is_reimbursable", "deleted_at", F.size("violations").cast("long").alias("n_violations"))


@query("SELECT 'f' || p_partkey AS id, p_name AS file_name, strlen(p_name) AS size_bytes, CASE WHEN p_partkey % 4 > 0 THEN hex(encode(p_name)) END AS data, sha256(p_name) AS sha256, CAST(0 AS BIGINT) AS n_violations FROM part")
def attachment_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments, whose bytes are base64 in record lines, read again."""
    name = F.col("p_name")
    rows = adapter.table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("id"), F.lit("l1").alias("ledger_id"), F.lit(None).cast("string").alias("txn_id"), name.alias("file_name"), F.lit("text/plain").alias("mime"), F.octet_length(name).cast("long").alias("size_bytes"), F.sha2(name, 256).alias("sha256"), F.lit(1).cast("long").alias("storage"), F.when(F.col("p_partkey") % 4 > 0, name.cast("binary")).alias("data"), F.lit(None).cast("long").alias("deleted_at")).withColumns(common())
    return reread(rows, "attachment").select("id", "file_name", "size_bytes", F.hex("data").alias("data"), "sha256", F.size("violations").cast("long").alias("n_violations"))


@query("""SELECT 't' || n_nationkey AS id, n_name AS name, '{"a":[1,{"b":null}],"z":"' || n_name || '"}' AS spec, CAST(0 AS BIGINT) AS n_violations FROM nation""")
def theme_lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes, whose specification is an object, read again and put in canonical form."""
    spec = F.concat(F.lit('{"z" : "'), F.col("n_name"), F.lit('", "a":[1, {"b":null}]}'))
    rows = adapter.table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), spec.alias("spec_json"), F.lit(0).cast("long").alias("is_active"), F.lit(None).cast("long").alias("deleted_at")).withColumns(common())
    return reread(rows, "theme").select("id", "name", scalars.canonical_json(F.col("spec_json")).alias("spec"), F.size("violations").cast("long").alias("n_violations"))


@query("""SELECT event_id AS id, '{"id":' || event_id || ',"kind":"' || event_type || '","user":{"a":null,"b":' || user_id || '}}' AS json FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('{"user": {"b": '), F.col("user_id").cast("string"), F.lit(', "a": null}, "kind": "'), F.col("event_type"), F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}"))
    return adapter.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), scalars.canonical_json(line).alias("json"))


BAD_IDS = "CASE WHEN c_custkey % 7 = 0 THEN 'a b' || c_custkey WHEN c_custkey % 7 = 1 THEN '' WHEN c_custkey % 7 = 2 THEN repeat('x', 65) WHEN c_custkey % 7 = 3 THEN NULL WHEN c_custkey % 7 = 4 THEN 'é' || c_custkey ELSE 'ok_-' || c_custkey END AS id"


@query(f"SELECT c_custkey AS n, id FROM (SELECT c_custkey, {BAD_IDS} FROM customer) WHERE c_custkey % 7 < 5")
def unsafe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unsafe_ids(adapter.table(spark, sf_dir, "customer").selectExpr("c_custkey AS n", BAD_IDS))


LEDGER_LINE = """'{"type":"ledger","id":"' || id || '","name":"' || name || '","code":"' || code || '","currency":"CNY","isDefault":' || is_default || ',"sortOrder":' || sort_order || ',"deletedAt":' || coalesce(CAST(deleted_at AS VARCHAR), 'null') || '}'"""


@query(sql.with_(sql.LEDGER) + f"SELECT 'ledger' AS stage, CAST(id AS VARCHAR) AS id, sha256({LEDGER_LINE}) AS line_sha256 FROM ledger")
def line_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of record lines' hashes, by which implementations compare their exports."""
    rows = adapter.ledgers(spark, sf_dir).withColumns(text("id"))
    return export.line_hashes(rows, "ledger").select("stage", "id", "line_sha256")


@query(sql.with_(sql.LEDGER) + "SELECT CAST(id AS VARCHAR) AS id, name, code, CAST(is_default AS BIGINT) AS is_default, deleted_at, CAST(0 AS BIGINT) AS n_violations FROM ledger")
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers as a payload's bytes, decoded with every check, and read as records."""
    rows = [r.asDict() for r in adapter.ledgers(spark, sf_dir).withColumns(text("id")).collect()]  # a payload is bounded
    lines = [{"id": r["id"], "name": r["name"], "code": r["code"], "currency": "CNY", "isDefault": r["is_default"], "sortOrder": r["sort_order"], "createdAt": 1, "updatedAt": 1, "deletedAt": r["deleted_at"], "deviceId": "d", "rev": 1} for r in rows]
    data, _, _ = payload.encode({"type": "manifest", "exportKind": "full", "counts": {"ledger": len(lines)}}, {"ledger": lines}, NOW)
    got = changeset.read_records(payload.decode(data).lines(spark), "ledger")
    return got.select("id", "name", "code", "is_default", "deleted_at", F.size("violations").cast("long").alias("n_violations"))


# containers and keys


@query("SELECT r_name AS name, CAST(1 AS BIGINT) AS format_version, CAST((strlen(r_name) + 6) // 7 AS BIGINT) AS chunk_count, strlen(r_name) AS plaintext_length, TRUE AS header_ok, r_regionkey % 2 = 0 AS digest_ok, r_name AS opened FROM region")
def container_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions' names sealed in containers of tiny chunks, some damaged; inspected without a key, the whole ones opened."""
    names = [(r["r_regionkey"], r["r_name"]) for r in adapter.table(spark, sf_dir, "region").collect()]
    key, folder = bytes(range(32)), place(spark, "containers")
    files, opened = [], []
    for n, name in names:
        file = sealed(spark, name.encode(), key)
        opened.append((n, container.open_file(spark, file, key).decode()))
        files.append((n, bytearray(file if n % 2 == 0 else file[:-33] + bytes([file[-33] ^ 1]) + file[-32:])))
    frame = spark.createDataFrame(files, "n int, content binary").withColumn("name", F.concat(F.lit("c"), F.col("n").cast("string")))
    save(frame, folder)
    seen = container.inspect(spark, f"{folder}/*").withColumn("n", F.regexp_extract("path", "c([0-9]+)$", 1).cast("int"))
    back = spark.createDataFrame(opened, "n int, opened string")
    named = spark.createDataFrame(names, "n int, name string")
    return seen.join(back, "n").join(named, "n").select("name", "format_version", "chunk_count", "plaintext_length", "header_ok", "digest_ok", "opened")


def sealed(spark: SparkSession, data: bytes, key: bytes) -> bytes:
    """A container whose chunks have seven bytes."""
    header = container.Header(bytes(16), bytes(8), 0, 0)
    return container.seal(spark, data, key, header, 7)


def save(files: DataFrame, folder: str) -> None:
    """Writes small files (name, content) on any file system that Spark reaches."""
    context = files.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(context._jsc.hadoopConfiguration())
    for r in files.collect():
        out = system.create(path(f"{folder}/{r['name']}"))
        out.write(bytearray(r["content"]))
        out.close()


@query("SELECT p_partkey AS id, p_name AS opened, CAST(strlen(p_name) + 16 AS BIGINT) AS box_bytes FROM part")
def aes_gcm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names sealed with a nonce and authenticated data of their own, opened again; the tag takes 16 bytes."""
    key = F.unhex(F.sha2(F.lit("a key"), 256))
    nonce = F.substring(F.unhex(F.sha2(F.col("p_partkey").cast("string"), 256)), 1, 12)
    aad = F.col("p_brand").cast("binary")
    rows = adapter.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), crypto.gcm_seal(F.col("p_name").cast("binary"), key, nonce, aad).alias("box"), nonce.alias("nonce"), aad.alias("aad"))
    return rows.select("id", crypto.gcm_open(F.col("box"), key, F.col("nonce"), F.col("aad")).cast("string").alias("opened"), F.octet_length("box").cast("long").alias("box_bytes"))


# money and versions


@query(T + "SELECT id, amount_minor + fee_minor AS total, amount_minor - fee_minor AS rest, amount_minor * (id % 9 - 4) AS times, CAST(sign(amount_minor - 10000000) AS BIGINT) AS compared FROM txn")
def money_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, fee, cny = F.col("amount_minor"), F.col("fee_minor"), F.col("currency")
    return adapter.txns(spark, sf_dir).select("id", scalars.money_add(a, fee, cny, cny).alias("total"), scalars.money_subtract(a, fee, cny, cny).alias("rest"), scalars.money_times(a, F.col("id") % 9 - 4).alias("times"), scalars.money_compare(a, F.lit(10_000_000), cny, cny).alias("compared"))


@query(T + """SELECT id, '{"minorUnits":' || amount_minor || ',"currency":"CNY","scale":2}' AS json, CASE WHEN id % 5 <> 0 THEN amount_minor END AS parsed FROM txn""")
def money_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as JSON and back; a fifth are spoiled."""
    json = scalars.money_json(F.col("amount_minor"), F.col("currency"))
    rows = adapter.txns(spark, sf_dir).select("id", json.alias("json"))
    spoiled = F.when(F.col("id") % 5 == 0, F.regexp_replace("json", '"scale":2', '"scale":"2"')).otherwise(F.col("json"))
    return rows.select("id", "json", scalars.money_from_json(spoiled)["minor"].alias("parsed"))


@query(T + f"""SELECT id, CASE WHEN id % 6 = 1 THEN 'bad_id' WHEN id % 6 = 2 THEN 'bad_stamp' WHEN id % 6 = 3 THEN 'empty_device' WHEN id % 6 = 4 THEN 'bad_hash' END AS error, CASE WHEN id % 6 <> 2 THEN occurred_at END AS millis FROM txn""")
def version_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    stamp = scalars.ulid_encode(F.col("occurred_at"), F.substring(F.sha2(key.cast("string"), 256), 1, 20))
    rows = adapter.txns(spark, sf_dir).select(key.alias("n"), F.when(key % 6 == 1, "x").otherwise(stamp).alias("id"), F.when(key % 6 == 2, F.lower(F.concat(F.lit("9"), stamp))).otherwise(stamp).alias("version_stamp"), F.when(key % 6 == 3, "").otherwise("d").alias("device_id"), F.when(key % 6 == 4, "abc").otherwise(F.sha2(F.lit("x"), 256)).alias("content_hash"))
    return rows.select(F.col("n").alias("id"), versions.version_error().alias("error"), versions.version_millis().alias("millis"))


# writes


@query(sql.with_(sql.LOCAL, sql.REMOTE) + """SELECT r.id, r.ledger_id, r.name, r.balance, r.updated_at FROM remote r JOIN local l ON r.id = l.id AND l.deleted_at IS NULL
UNION ALL SELECT l.id, l.ledger_id, l.name, l.balance, l.updated_at FROM local l LEFT JOIN remote r ON r.id = l.id WHERE r.id IS NULL OR l.deleted_at IS NOT NULL""")
def record_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = adapter.replica(spark, sf_dir, "remote"), adapter.replica(spark, sf_dir, "local")
    return writes.update(local, remote, ("ledger_id",))[0].select("id", "ledger_id", "name", "balance", "updated_at")


FAULTY = """faulty AS (SELECT id, type, CASE WHEN id % 101 = 0 THEN 0 ELSE amount_minor END AS amount_minor, currency, fee_minor, account_id, CASE WHEN id % 103 = 0 THEN NULL ELSE to_account_id END AS to_account_id, category_id, deleted_at FROM txn)"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    return adapter.txns(spark, sf_dir).withColumns({"amount_minor": F.when(key % 101 == 0, F.lit(0)).otherwise(F.col("amount_minor")), "to_account_id": F.when(key % 103 != 0, F.col("to_account_id"))})


@query(sql.with_(sql.TXN, FAULTY) + "SELECT id, CASE WHEN amount_minor <= 0 THEN 'amount_not_positive' ELSE 'transfer_without_target' END AS violation FROM faulty WHERE deleted_at IS NULL AND (amount_minor <= 0 OR type = 3 AND to_account_id IS NULL)")
def effect_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.effect_violations(faulty(spark, sf_dir))


@query(
    sql.with_(sql.ACCOUNT, sql.TXN, FAULTY, "cat AS (SELECT DISTINCT category_id AS id, type AS kind, NULL AS deleted_at FROM txn WHERE category_id NOT LIKE '%9' AND type = 1)")
    + """SELECT f.id, CASE WHEN f.amount_minor <= 0 THEN 'amount' WHEN f.type = 3 AND f.to_account_id IS NULL THEN 'transfer_needs_target' WHEN a.id IS NULL THEN 'account_missing' WHEN a.deleted_at IS NOT NULL THEN 'account_deleted'
  WHEN f.to_account_id IS NOT NULL AND b.id IS NULL THEN 'target_missing' WHEN b.deleted_at IS NOT NULL THEN 'target_deleted' WHEN f.category_id IS NOT NULL AND c.id IS NULL THEN 'category_missing' WHEN c.kind <> f.type THEN 'category_kind' ELSE 'created' END AS outcome
FROM faulty f LEFT JOIN account a ON f.account_id = a.id LEFT JOIN account b ON f.to_account_id = b.id LEFT JOIN cat c ON f.category_id = c.id WHERE f.deleted_at IS NULL"""
)
def txn_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New transactions by what becomes of them: created, or the first rule that they break."""
    rows = faulty(spark, sf_dir).where("deleted_at is null")
    cats = adapter.txns(spark, sf_dir).where("category_id not like '%9' and type = 1").select(F.col("category_id").alias("id"), F.col("type").alias("kind"), F.lit(None).cast("long").alias("deleted_at")).distinct()
    after, refused = writes.create_txns(rows.limit(0), rows, adapter.accounts(spark, sf_dir), cats)
    return after.select("id", F.lit("created").alias("outcome")).unionByName(refused.withColumnRenamed("violation", "outcome"))


@query("SELECT 'N' || n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'not_unique' WHEN n_nationkey = 2 THEN 'created' WHEN n_nationkey % 5 = 2 THEN 'second_default' ELSE 'created' END AS outcome FROM nation")
def ledger_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ledgers: a fifth have a taken code, a fifth want to be the default, which one of them becomes."""
    key = F.col("n_nationkey")
    name = lambda n: F.concat(F.lit("N"), F.lpad(key.cast("string"), n, "0")) if n else F.concat(F.lit("N"), key.cast("string"))
    nations = adapter.table(spark, sf_dir, "nation")
    new = nations.select(name(2).alias("id"), F.when(key % 5 == 0, F.lit("taken")).otherwise(F.col("n_name")).alias("code"), F.when(key % 5 == 2, 1).otherwise(0).alias("is_default"), F.lit(None).cast("long").alias("deleted_at"))
    state = new.limit(0).unionByName(spark.createDataFrame([("old", "taken", 0, None)], "id string, code string, is_default int, deleted_at long"))
    after, refused = writes.create_ledgers(state, new)
    rows = after.where("id <> 'old'").select("id", F.lit("created").alias("outcome")).unionByName(refused.withColumnRenamed("violation", "outcome"))
    return rows.select(F.regexp_replace("id", "^N0", "N").alias("id"), "outcome")


WRITES = "SELECT o_orderkey AS n, CASE o_orderkey % 4 WHEN 0 THEN 'txn' WHEN 1 THEN 'ledger' WHEN 2 THEN 'attachment' ELSE 'category' END AS entity, CAST(o_orderkey % 2 AS INTEGER) AS phase, o_custkey AS record_index FROM orders"


@query(f"SELECT n, row_number() OVER (ORDER BY CASE entity WHEN 'ledger' THEN 1 WHEN 'category' THEN 3 WHEN 'txn' THEN 6 ELSE 8 END, phase, record_index, n) AS position FROM ({WRITES})")
def import_write_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of an import's writes: by stage, placeholders (phase 0) before records."""
    rows = adapter.table(spark, sf_dir, "orders").createOrReplaceTempView
    rows("import_write_order_orders")
    frame = spark.sql(WRITES.replace("FROM orders", "FROM import_write_order_orders"))
    return lists.ranked(frame, [*merge.write_rank(), "n"], "position").select("n", "position")


# stores


@query(A + "SELECT 1 AS version, id, name FROM account UNION ALL SELECT 2, id, upper(name) FROM account WHERE id % 2 = 0 UNION ALL SELECT 3, id, name FROM account")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table committed, changed, and rolled back; another table stays where it lies."""
    kept = Store(spark, place(spark, "store"))
    rows = adapter.accounts(spark, sf_dir).select("id", "name")
    kept.commit({"account": rows, "ledger": adapter.ledgers(spark, sf_dir)})
    kept.commit({"account": rows.where("id % 2 = 0").withColumn("name", F.upper("name"))})
    changed = kept.read("account")
    kept.rollback(1)
    part = lambda df, n: df.select(F.lit(n).alias("version"), "id", "name")
    return part(kept.read("account", 1), 1).unionByName(part(changed, 2)).unionByName(part(kept.read("account"), 3))


@query(sql.with_(sql.LEDGER) + "SELECT id, code, 'Ledger ' || name AS title, id % 3 = 0 AS shared FROM ledger")
def store_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two migrations of a store, one of them run again, which does nothing."""
    kept = Store(spark, place(spark, "store"))
    kept.commit({"ledger": adapter.ledgers(spark, sf_dir).select("id", "code", "name")})
    steps = [migration.Migration(1, "titles", (("ledger", "SELECT id, code, 'Ledger ' || name AS title FROM ledger"),)), migration.Migration(2, "shared", (("ledger", "SELECT *, id % 3 = 0 AS shared FROM ledger"),))]
    migration.migrate(kept, 1, steps, NOW)
    migration.migrate(kept, 2, steps, NOW)
    if migration.migrate(kept, 2, steps, NOW):
        raise RuntimeError("a migration ran twice")
    return kept.read("ledger")


# exports

SELECTED = """sel AS (SELECT 'all' AS scope, 'account' AS stage, count(*) AS n FROM account UNION ALL SELECT 'all', 'txn', count(*) FROM txn
  UNION ALL SELECT 'time_range', 'account', count(*) FROM account UNION ALL SELECT 'time_range', 'txn', count(*) FROM txn WHERE occurred_at BETWEEN 820000000000 AND 850000000000
  UNION ALL SELECT 'ledger', 'account', count(*) FROM account WHERE ledger_id IN (3, 4) UNION ALL SELECT 'ledger', 'txn', count(*) FROM txn WHERE ledger_id IN (3, 4)
  UNION ALL SELECT 'incremental', 'account', count(*) FROM account WHERE id >= 100 UNION ALL SELECT 'incremental', 'txn', count(*) FROM txn WHERE occurred_at >= 850000000000)"""


@query(sql.with_(sql.ACCOUNT, sql.TXN, SELECTED) + "SELECT scope, stage, n FROM sel")
def export_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table that each kind of export request selects."""
    accounts = adapter.accounts(spark, sf_dir).withColumns(text("ledger_id")).withColumn("updated_at", F.col("id"))
    txns = adapter.txns(spark, sf_dir).withColumns(text("ledger_id")).withColumn("updated_at", F.col("occurred_at"))
    requests = [
        (export.Request(), {}),
        (export.Request("time_range", 820_000_000_000, 850_000_000_000), {}),
        (export.Request("ledger", ledger_ids=["3", "4"]), {}),
        (export.Request("incremental", since_ms=850_000_000_000), {"account": export.Request("incremental", since_ms=100)}),
    ]
    out = None
    for request, own in requests:
        for stage, df in {"account": accounts, "txn": txns}.items():
            chosen = export.select({stage: df}, own.get(stage, request))[stage]
            part = chosen.agg(F.count("*").alias("n")).select(F.lit(request.scope).alias("scope"), F.lit(stage).alias("stage"), "n")
            out = part if out is None else out.unionByName(part)
    return out


# imports: a local ledger, a change set that carries some columns only, converged

AT = f"CAST({adapter.BASE_MS} AS BIGINT)"
IMPORT = sql.with_(
    sql.TXN,
    f"local_account AS (SELECT DISTINCT CAST(k AS VARCHAR) AS id, CAST(k % 25 AS VARCHAR) AS ledger_id, 'acct ' || k AS name, CAST(1 AS BIGINT) AS type, 'CNY' AS currency, k * 10 AS opening_balance_minor, 'note ' || k AS note, k FROM (SELECT unnest([o_custkey, o_custkey + 1 - o_custkey % 2 * 2]) AS k FROM orders))",
    "rec_account AS (SELECT id, CASE WHEN k % 20 = 0 THEN opening_balance_minor + 100 ELSE opening_balance_minor END AS opening_balance_minor, k FROM local_account WHERE k % 10 = 0)",
    "cats AS (SELECT DISTINCT id % 150 AS n FROM txn WHERE category_id IS NOT NULL)",
    "local_category AS (SELECT 'K' || n AS id, n FROM cats WHERE n % 3 <> 2)",
    "rec_category AS (SELECT 'K' || n AS id, CASE n % 5 WHEN 0 THEN 'NOPE' WHEN 1 THEN 'K' || n ELSE 'K0' END AS parent_id, n FROM cats WHERE n % 3 = 2 AND n % 2 = 0)",
    "local_txn AS (SELECT * FROM txn WHERE id % 4 <> 0 AND (category_id IS NULL OR id % 150 % 3 <> 2))",
    "rec_txn AS (SELECT id, ledger_id, type, amount_minor + CASE WHEN id % 4 <> 0 THEN 7 ELSE 0 END AS amount_minor, fee_minor, occurred_at, CASE WHEN id % 50 = 0 THEN 'X' || account_id % 10 ELSE CAST(account_id AS VARCHAR) END AS account_id, CAST(to_account_id AS VARCHAR) AS to_account_id, category_id, deleted_at, id % 4 <> 0 AND deleted_at IS NOT NULL AS both_deleted FROM txn WHERE id % 4 = 0 OR id % 40 = 1 AND (category_id IS NULL OR id % 150 % 3 <> 2))",
    "rec_budget AS (SELECT 'B' || p_partkey AS id, 'Z' || p_partkey % 7 AS category_id FROM part WHERE p_partkey % 10 = 0)",
    "after_txn AS (SELECT CAST(id AS VARCHAR) AS id, type, amount_minor, fee_minor, occurred_at, account_id, to_account_id, CASE WHEN id IN (SELECT id FROM local_txn) THEN 'm' || id % 10 END AS merchant, deleted_at FROM rec_txn WHERE NOT both_deleted UNION ALL SELECT CAST(id AS VARCHAR), type, amount_minor, fee_minor, occurred_at, CAST(account_id AS VARCHAR), CAST(to_account_id AS VARCHAR), 'm' || id % 10, deleted_at FROM local_txn WHERE id NOT IN (SELECT id FROM rec_txn WHERE NOT both_deleted))",
    sql.legs("after_txn"),
    "moved AS (SELECT account_id, sum(delta) AS delta, max(occurred_at) AS as_of FROM legs GROUP BY account_id)",
    "after_account AS (SELECT l.id, l.name, coalesce(r.opening_balance_minor, l.opening_balance_minor) AS opening_balance_minor, l.note, CAST(0 AS BIGINT) AS is_archived FROM local_account l LEFT JOIN rec_account r ON l.id = r.id UNION ALL SELECT DISTINCT account_id, 'missing account', CAST(0 AS BIGINT), 'made by an import: merge it into the account that is meant', CAST(1 AS BIGINT) FROM rec_txn WHERE account_id LIKE 'X%')",
    "known_category AS (SELECT id FROM local_category UNION SELECT id FROM rec_category)",
    "lost AS (SELECT category_id AS id, arg_min(type = 2, id) AS income FROM rec_txn WHERE category_id IS NOT NULL AND category_id NOT IN (SELECT id FROM known_category) GROUP BY category_id UNION ALL SELECT DISTINCT category_id, FALSE FROM rec_budget)",
)


def local_ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A state of string ids: accounts, categories, transactions and no budgets."""
    orders = adapter.table(spark, sf_dir, "orders")
    who, at = F.col("o_custkey"), F.lit(adapter.BASE_MS)
    keys = orders.select(F.explode(F.array(who, who + 1 - who % 2 * 2)).alias("k")).distinct()
    meta = {"created_at": at, "updated_at": at, "deleted_at": F.lit(None).cast("long"), "device_id": F.lit("device-a"), "rev": F.lit(1).cast("long")}
    account = keys.select(F.col("k").cast("string").alias("id"), (F.col("k") % 25).cast("string").alias("ledger_id"), F.concat(F.lit("acct "), F.col("k").cast("string")).alias("name"), F.lit(1).cast("long").alias("type"), F.lit("CNY").alias("currency"), (F.col("k") * 10).alias("opening_balance_minor"), F.concat(F.lit("note "), F.col("k").cast("string")).alias("note"), F.lit(0).cast("long").alias("is_archived"), F.lit(0).cast("long").alias("cached_balance_minor"), F.lit(0).cast("long").alias("balance_as_of")).withColumns(meta)
    n = F.col("n")
    cats = adapter.txns(spark, sf_dir).where("category_id is not null").select((F.col("id") % 150).alias("n")).distinct()
    category = cats.select(F.concat(F.lit("K"), n.cast("string")).alias("id"), F.lit("0").alias("ledger_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1).cast("long").alias("kind"), F.concat(F.lit("K"), n.cast("string")).alias("name"), F.lit(0).cast("long").alias("is_hidden"), "n").withColumns(meta)
    txn = adapter.txns(spark, sf_dir).drop("tz_offset_min").withColumns({c: e for c, e in meta.items() if c != "deleted_at"}).withColumn("n", F.col("id")).withColumn("merchant", F.concat(F.lit("m"), (F.col("id") % 10).cast("string"))).withColumns(text("id", "ledger_id", "account_id", "to_account_id"))
    budget = spark.createDataFrame([], "id string, ledger_id string, category_id string, currency string, amount_minor long, created_at long, updated_at long, deleted_at long, device_id string, rev long")
    return {"account": account, "category": category, "txn": txn, "budget": budget}


def known_category() -> Column:
    return F.col("category_id").isNull() | (F.col("n") % 150 % 3 != 2)


def local_state(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    full = local_ledger(spark, sf_dir)
    return {"account": full["account"], "category": full["category"].where("n % 3 <> 2").drop("n"), "txn": full["txn"].where((F.col("n") % 4 != 0) & known_category()).drop("n"), "budget": full["budget"]}


def incoming(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The change set: records without notes, merchants and derived balances."""
    full = local_ledger(spark, sf_dir)
    newer = {"updated_at": F.lit(LATER), "device_id": F.lit("device-b")}
    key, n = F.col("id").cast("long"), F.col("n")
    account = full["account"].where(key % 10 == 0).drop("note", "is_archived", "cached_balance_minor", "balance_as_of").withColumn("opening_balance_minor", F.when(key % 20 == 0, F.col("opening_balance_minor") + 100).otherwise(F.col("opening_balance_minor"))).withColumns(newer)
    parent = F.when(n % 5 == 0, F.lit("NOPE")).when(n % 5 == 1, F.col("id")).otherwise(F.lit("K0"))
    category = full["category"].where("n % 3 = 2 and n % 2 = 0").withColumn("parent_id", parent).withColumns(newer).drop("n")
    txn = full["txn"].where((n % 4 == 0) | (n % 40 == 1) & known_category()).drop("merchant")
    txn = txn.withColumn("amount_minor", F.col("amount_minor") + F.when(n % 4 != 0, 7).otherwise(0)).withColumn("account_id", F.when(n % 50 == 0, F.concat(F.lit("X"), (F.col("account_id").cast("long") % 10).cast("string"))).otherwise(F.col("account_id"))).withColumns(newer).drop("n")
    part = F.col("p_partkey")
    budget = adapter.table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.concat(F.lit("B"), part.cast("string")).alias("id"), F.lit("0").alias("ledger_id"), F.concat(F.lit("Z"), (part % 7).cast("string")).alias("category_id"), F.lit("CNY").alias("currency"), F.lit(5).cast("long").alias("amount_minor"), F.lit(1).cast("long").alias("created_at"), F.lit(LATER).alias("updated_at"), F.lit(None).cast("long").alias("deleted_at"), F.lit("device-b").alias("device_id"), F.lit(1).cast("long").alias("rev"))
    return {"account": account, "category": category, "txn": txn, "budget": budget}


def imported(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], importer.Report]:
    return importer.apply_import(local_state(spark, sf_dir), incoming(spark, sf_dir), OPTIONS)


OPTIONS = importer.Options(strategy="converge", now_ms=NOW, device_id="device-a", job="job-1")


@query(IMPORT + "SELECT a.id, name, opening_balance_minor, note, is_archived, CAST(opening_balance_minor + coalesce(delta, 0) AS BIGINT) AS cached_balance_minor, coalesce(as_of, 0) AS balance_as_of FROM after_account a LEFT JOIN moved m ON a.id = m.account_id")
def import_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts after an import: carried columns set, others kept, placeholders made, balances reckoned."""
    return imported(spark, sf_dir)[0]["account"].select("id", "name", "opening_balance_minor", "note", "is_archived", "cached_balance_minor", "balance_as_of")


@query(IMPORT + "SELECT id, type, amount_minor, account_id, to_account_id, merchant, deleted_at FROM after_txn")
def import_txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir)[0]["txn"].select("id", "type", "amount_minor", "account_id", "to_account_id", "merchant", "deleted_at")


@query(IMPORT + "SELECT id, CAST(NULL AS VARCHAR) AS parent_id, CAST(1 AS BIGINT) AS kind, id AS name, CAST(0 AS BIGINT) AS is_hidden FROM local_category UNION ALL SELECT id, CASE WHEN n % 5 > 1 THEN 'K0' END, CAST(1 AS BIGINT), id, CAST(0 AS BIGINT) FROM rec_category UNION ALL SELECT id, NULL, CAST(CASE WHEN income THEN 2 ELSE 1 END AS BIGINT), 'missing ' || id, CAST(1 AS BIGINT) FROM lost")
def import_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imported(spark, sf_dir)[0]["category"].select("id", "parent_id", "kind", "name", "is_hidden")


@query(
    IMPORT
    + """SELECT 'category' AS entity, id AS record_id, 'parent_id' AS "column", 'promote_to_root' AS kind, CASE n % 5 WHEN 0 THEN 'missing' ELSE 'cycle' END AS reason, parent_id AS referenced_id, CAST(NULL AS VARCHAR) AS placeholder_name FROM rec_category WHERE n % 5 < 2
UNION ALL SELECT 'txn', CAST(id AS VARCHAR), 'account_id', 'placeholder_account', 'missing', account_id, 'missing account' FROM rec_txn WHERE account_id LIKE 'X%'
UNION ALL SELECT 'txn', CAST(id AS VARCHAR), 'category_id', 'placeholder_category', 'missing', category_id, 'missing ' || category_id FROM rec_txn WHERE category_id NOT IN (SELECT id FROM known_category)
UNION ALL SELECT 'budget', id, 'category_id', 'placeholder_category', 'missing', category_id, 'missing ' || category_id FROM rec_budget"""
)
def import_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference that an import repairs."""
    return importer.plan(local_state(spark, sf_dir), incoming(spark, sf_dir), OPTIONS).fixes


COUNTS = """(SELECT count(*) FROM rec_txn WHERE id NOT IN (SELECT id FROM local_txn)) + (SELECT count(*) FROM rec_category) + (SELECT count(*) FROM rec_budget)"""


@query(IMPORT + f"SELECT 'job-1' AS id, 'merge' AS mode, CAST(1 AS INTEGER) AS status, CAST({COUNTS} + (SELECT count(*) FROM lost) + (SELECT count(*) FROM after_account WHERE is_archived = 1) AS BIGINT) AS inserted, CAST((SELECT count(*) FROM rec_txn WHERE id IN (SELECT id FROM local_txn) AND NOT both_deleted) + (SELECT count(*) FROM rec_account WHERE k % 20 = 0) AS BIGINT) AS updated, CAST((SELECT count(*) FROM rec_account WHERE k % 20 <> 0) + (SELECT count(*) FROM rec_txn WHERE both_deleted) AS BIGINT) AS skipped, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS removed")
def import_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import's own row: placeholders count as inserted."""
    _, report = imported(spark, sf_dir)
    return importer.job_record(spark, "job-1", "0" * 64, report, OPTIONS, NOW, 1).select("id", "mode", "status", "inserted", "updated", "skipped", "conflicts", "removed")


@query(IMPORT + "SELECT 'account' AS entity, CASE WHEN k % 20 = 0 THEN 'conflict' ELSE 'skip' END AS outcome, count(*) AS n FROM rec_account GROUP BY ALL UNION ALL SELECT 'category', 'insert', count(*) FROM rec_category UNION ALL SELECT 'budget', 'insert', count(*) FROM rec_budget UNION ALL SELECT 'txn', CASE WHEN id IN (SELECT id FROM local_txn) THEN 'conflict' WHEN deleted_at IS NOT NULL THEN 'insert_tombstone' ELSE 'insert' END, count(*) FROM rec_txn GROUP BY ALL")
def import_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How an aborting import sees the records: new, alike, or different, and what its guard would stop at."""
    state, records = local_state(spark, sf_dir), incoming(spark, sf_dir)
    plan = importer.plan(state, records, importer.Options(now_ms=NOW))
    out = None
    for k, decided in plan.decisions.items():
        part = decided.groupBy("outcome").agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "outcome", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(IMPORT + "SELECT 'account' AS entity, id FROM local_account WHERE ledger_id = '3' AND k % 10 <> 0 AND id NOT IN (SELECT CAST(id AS VARCHAR) FROM rec_txn) UNION ALL SELECT 'txn', CAST(id AS VARCHAR) FROM local_txn WHERE ledger_id = 3 AND deleted_at IS NULL AND id NOT IN (SELECT id FROM rec_txn) AND CAST(id AS VARCHAR) NOT IN (SELECT id FROM rec_account)")
def import_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a replacing import would remove and asks to confirm: a ledger's live rows whose id no record has."""
    options = importer.Options(mode="replace", target_ledger="3", now_ms=NOW)
    found = importer.removals(local_state(spark, sf_dir), incoming(spark, sf_dir), options)
    out = None
    for k, rows in found.items():
        part = rows.select(F.lit(k).alias("entity"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey AS n, row_number() OVER (ORDER BY entity, record_id, c, kind) AS position FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'txn' ELSE 'account' END AS entity, n_name AS record_id, 'x' AS c, 'k' AS kind FROM nation)")
def import_fix_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes in the order of a report."""
    key = F.col("n_nationkey")
    rows = adapter.table(spark, sf_dir, "nation").select(key.alias("n"), F.when(key % 2 == 0, "txn").otherwise("account").alias("entity"), F.col("n_name").alias("record_id"), F.lit("x").alias("column"), F.lit("k").alias("kind"))
    return lists.ranked(rows, repair.FIX_ORDER, "position").select("n", "position")


# statements


@query(T + "SELECT t.id, t.amount_minor, '?' AS mark FROM txn t WHERE t.amount_minor > 20000000 AND t.type = 2 AND t.category_id <> 'K?'")
def raw_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement with arguments in its places."""
    statement = "SELECT id, amount_minor, '?' AS mark FROM txn WHERE amount_minor > ? AND type = ? AND category_id <> 'K?'"
    return raw.query({"txn": adapter.txns(spark, sf_dir)}, statement, [20_000_000, 2])


@query(sql.with_(sql.LEDGER) + f"""SELECT id, CASE WHEN id % 3 = 0 THEN upper(name) || '=, x' ELSE name END AS name, CASE WHEN id % 3 = 0 THEN sort_order + 100 ELSE sort_order END AS sort_order, deleted_at FROM ledger WHERE id <> 5 AND (deleted_at IS NULL OR id < 20)
UNION ALL SELECT id + 1000, 'copy', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM ledger WHERE id < 3""")
def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update, two deletions and two insertions, one of them of ids that are there, as next states."""
    tables = {"ledger": adapter.ledgers(spark, sf_dir).select("id", "name", "sort_order", "deleted_at")}
    tables = raw.run(tables, "UPDATE ledger SET name = upper(name) || ?, sort_order = sort_order + ? WHERE id % 3 = ?", ["=, x", 100, 0])
    tables = raw.run(tables, "DELETE FROM ledger WHERE id = ?", [5])
    tables = raw.run(tables, "DELETE FROM ledger WHERE deleted_at IS NOT NULL AND id >= 20")
    tables = raw.run(tables, "INSERT INTO ledger (id, name) SELECT id + 1000, ? FROM ledger WHERE id < 3", ["copy"])
    return raw.run(tables, "INSERT OR IGNORE INTO ledger (id, name) VALUES (1, 'a'), (2, 'b')")["ledger"]


@query(A + "SELECT CAST(id AS VARCHAR) AS id, CAST(ledger_id AS VARCHAR) AS ledger_id, name, type, currency, opening_balance_minor, credit_limit_minor, CAST(repay_account_id AS VARCHAR) AS repay_account_id, sort_order, deleted_at, row_number() OVER (ORDER BY CAST(id AS VARCHAR)) AS position FROM account")
def stage_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as an export takes them: the type's columns, in order of id."""
    rows = adapter.accounts(spark, sf_dir).withColumns(text("id", "ledger_id", "repay_account_id")).withColumn("other", F.lit(1))
    return lists.ranked(export.stages({"account": rows})["account"], ["id"], "position")


@query(sql.with_(sql.LOCAL, sql.REMOTE, sql.PAIRS, f"decided AS ({sql.decisions()})") + "SELECT id, CASE WHEN write = 'INSERT' THEN 'insert' WHEN outcome = 'skip' THEN 'skip' ELSE 'conflict' END AS state FROM decided")
def merge_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.classify(merge.decide(adapter.replica(spark, sf_dir, "remote"), adapter.replica(spark, sf_dir, "local")))

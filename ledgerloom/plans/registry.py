"""Queries over the driver's tables and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.operators import balance, checks, importer, lists, merge, repair, versions, writes
from ledgerloom.plans import exchange, sql
from ledgerloom.plans.base import QUERIES, SQL, query
from ledgerloom.plans.sql import ulid_sql
from ledgerloom.sources import adapter, changeset, seed
from ledgerloom.sources.store import scratch

NOW = adapter.BASE_MS + 86_400_000

T, A = sql.with_(sql.TXN), sql.with_(sql.ACCOUNT)
TL = sql.with_(sql.TXN, sql.LEGS)
ATL = sql.with_(sql.ACCOUNT, sql.TXN, sql.LEGS, sql.BALANCE)
CACHED = sql.with_(sql.ACCOUNT, sql.TXN, sql.LEGS, sql.BALANCE, sql.CACHED)
PAIRS = sql.with_(sql.LOCAL, sql.REMOTE, sql.PAIRS)


def cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.apply_balances(adapter.accounts(spark, sf_dir), adapter.txns(spark, sf_dir))


# balances


@query(TL + "SELECT txn_id, account_id, delta, occurred_at FROM legs")
def txn_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.legs(adapter.txns(spark, sf_dir))


@query(ATL + "SELECT * FROM balance")
def balance_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balances(adapter.accounts(spark, sf_dir), adapter.txns(spark, sf_dir))


CUTOFF = 852_076_800_000  # 1997-01-01


@query(sql.with_(sql.ACCOUNT, sql.TXN, f"early AS (SELECT * FROM txn WHERE occurred_at < {CUTOFF})", sql.legs("early"), sql.BALANCE) + "SELECT * FROM balance")
def balance_at_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.balances(adapter.accounts(spark, sf_dir), adapter.txns(spark, sf_dir).where(F.col("occurred_at") < CUTOFF))


@query(CACHED + "SELECT id, cached_balance_minor, opening_balance_minor, type FROM cached")
def balance_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cached(spark, sf_dir).select("id", "cached_balance_minor", "opening_balance_minor", "type")


@query(TL + "SELECT *, CAST(sum(delta) OVER (PARTITION BY account_id ORDER BY occurred_at, txn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_minor FROM legs")
def running_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.running(adapter.txns(spark, sf_dir))


SUMS = """'CNY' AS currency, CAST(coalesce(sum(CASE WHEN type = 2 THEN amount_minor END), 0) AS BIGINT) AS income_minor,
  CAST(coalesce(sum(CASE WHEN type = 1 THEN amount_minor WHEN type = 3 THEN fee_minor END), 0) AS BIGINT) AS expense_minor,
  CAST(coalesce(sum(CASE WHEN type = 3 THEN amount_minor END), 0) AS BIGINT) AS transfer_minor,
  CAST(coalesce(sum(CASE WHEN type = 3 THEN fee_minor END), 0) AS BIGINT) AS fee_minor
FROM txn WHERE deleted_at IS NULL AND excluded_from_stats = 0"""


@query(T + f"SELECT {SUMS}")
def ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.summary(adapter.txns(spark, sf_dir))


@query(T + f"SELECT ledger_id, {SUMS} GROUP BY ledger_id")
def summary_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.summary(adapter.txns(spark, sf_dir), ["ledger_id"])


MONTH = "strftime(make_timestamp((occurred_at + tz_offset_min * 60000) * 1000), '%Y-%m')"
DAY = "strftime(make_timestamp((occurred_at + tz_offset_min * 60000) * 1000), '%Y-%m-%d')"


@query(T + f"SELECT ledger_id, {MONTH} AS month_key, {SUMS} GROUP BY ledger_id, {MONTH}")
def summary_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.txns(spark, sf_dir)
    return balance.summary(rows.withColumn("month_key", scalars.month_key(F.col("occurred_at"), F.col("tz_offset_min"))), ["ledger_id", "month_key"])


@query(T + f"SELECT category_id, {SUMS} GROUP BY category_id")
def summary_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.summary(adapter.txns(spark, sf_dir), ["category_id"])


@query(CACHED + "SELECT CAST(sum(cached_balance_minor) AS BIGINT) AS net_worth_minor FROM cached WHERE deleted_at IS NULL")
def net_worth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.net_worth(cached(spark, sf_dir))


@query(CACHED + "SELECT ledger_id, CAST(sum(cached_balance_minor) AS BIGINT) AS net_worth_minor FROM cached WHERE deleted_at IS NULL GROUP BY ledger_id")
def net_worth_by_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.net_worth(cached(spark, sf_dir), ["ledger_id"])


@query(CACHED + "SELECT id, credit_limit_minor + least(0, cached_balance_minor) AS available_minor, greatest(0, -cached_balance_minor) AS debt_minor FROM cached WHERE deleted_at IS NULL AND credit_limit_minor IS NOT NULL")
def available_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.available_credit(cached(spark, sf_dir))


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions after an edit of amounts and some deletions."""
    rows = adapter.txns(spark, sf_dir)
    rows = rows.withColumn("amount_minor", F.when(F.col("id") % 10 == 0, F.col("amount_minor") + 500).otherwise(F.col("amount_minor")))
    return rows.withColumn("deleted_at", F.when(F.col("id") % 31 == 0, F.lit(NOW)).otherwise(F.col("deleted_at")))


EDITED = f"""edited AS (SELECT id, type, CASE WHEN id % 10 = 0 THEN amount_minor + 500 ELSE amount_minor END AS amount_minor, fee_minor, occurred_at, account_id, to_account_id,
  CASE WHEN id % 31 = 0 THEN {NOW} ELSE deleted_at END AS deleted_at FROM txn)"""
DELTA = "CAST(sum(delta) AS BIGINT) AS delta FROM (SELECT account_id AS id, -delta AS delta FROM legs UNION ALL SELECT account_id, delta FROM after_legs) GROUP BY id HAVING sum(delta) <> 0"


@query(sql.with_(sql.TXN, sql.LEGS, EDITED, sql.legs("edited", "after_legs")) + f"SELECT id, {DELTA}")
def incremental_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.delta(adapter.txns(spark, sf_dir), edited(spark, sf_dir))


@query(sql.with_(sql.ACCOUNT, sql.TXN, EDITED, sql.legs("edited"), sql.BALANCE) + "SELECT b.id, balance_minor AS cached_balance_minor, balance_as_of FROM balance b JOIN account a ON a.id = b.id")
def incremental_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incremental way; the SQL recomputes from scratch."""
    return writes.balance_change(cached(spark, sf_dir), adapter.txns(spark, sf_dir), edited(spark, sf_dir))


@query(CACHED + "SELECT id, opening_balance_minor + CASE WHEN id % 4 = 0 THEN 250 ELSE 0 END AS opening_balance_minor, cached_balance_minor + CASE WHEN id % 4 = 0 THEN 250 ELSE 0 END AS cached_balance_minor FROM cached")
def opening_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cached(spark, sf_dir)
    changes = adapter.accounts(spark, sf_dir).where("id % 4 = 0").select("id", F.lit(250).cast("long").alias("opening_delta"))
    return balance.shift_opening(rows, changes).select("id", "opening_balance_minor", "cached_balance_minor")


@query(TL + "SELECT account_id, max(occurred_at) AS last_at, count(*) AS n_legs FROM legs GROUP BY account_id")
def last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.legs(adapter.txns(spark, sf_dir)).groupBy("account_id").agg(F.max("occurred_at").alias("last_at"), F.count("*").alias("n_legs"))


# scalars


@query(T + f"SELECT id, {DAY} AS day_key, {MONTH} AS month_key FROM txn")
def day_month_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, tz = F.col("occurred_at"), F.col("tz_offset_min")
    return adapter.txns(spark, sf_dir).select("id", scalars.day_key(at, tz).alias("day_key"), scalars.month_key(at, tz).alias("month_key"))


SIGNED = "CASE WHEN id % 3 = 0 THEN -amount_minor ELSE amount_minor END"


def signed_amount() -> F.Column:
    return F.when(F.col("id") % 3 == 0, -F.col("amount_minor")).otherwise(F.col("amount_minor"))


@query(T + f"SELECT id, CASE WHEN m < 0 THEN '-' ELSE '' END || regexp_replace(reverse(regexp_replace(reverse(CAST(abs(m) // 100 AS VARCHAR)), '([0-9]{{3}})', '\\1,', 'g')), '^,', '') || '.' || lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0') || ' CNY' AS text FROM (SELECT id, {SIGNED} AS m FROM txn)")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.txns(spark, sf_dir).select("id", scalars.money_format(signed_amount(), 2, True, "CNY").alias("text"))


@query(T + f"SELECT id, {SIGNED} AS parsed FROM txn")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parses what money_format writes; the SQL has the amounts themselves."""
    rows = money_format(spark, sf_dir)
    return rows.select("id", scalars.money_parse(F.col("text"), "CNY").alias("parsed"))


@query(T + "SELECT type, CAST(sum(amount_minor) AS BIGINT) AS sum_minor, 'CNY' AS currency FROM txn GROUP BY type")
def money_sum_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.money_sum(adapter.txns(spark, sf_dir), "amount_minor", "currency", ["type"])


@query(T + f"SELECT id, {ulid_sql('occurred_at', 'h')} AS ulid FROM (SELECT id, occurred_at, sha256(CAST(id AS VARCHAR)) AS h FROM txn)")
def ulid_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.txns(spark, sf_dir).select("id", scalars.ulid_encode(F.col("occurred_at"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 20)).alias("ulid"))


@query(T + "SELECT id, CASE WHEN id % 4 <> 1 THEN occurred_at END AS millis, CASE WHEN id % 4 <> 1 THEN substr(sha256(CAST(id AS VARCHAR)), 1, 20) END AS random_hex, id % 4 <> 1 AS valid FROM txn")
def ulid_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decodes ULIDs in both cases, a quarter of them spoiled."""
    text = F.when(F.col("id") % 4 == 1, F.concat(F.lit("8"), F.substring("ulid", 2, 25))).when(F.col("id") % 4 == 2, F.lower("ulid")).otherwise(F.col("ulid"))
    rows = ulid_encode(spark, sf_dir).select("id", text.alias("t"))
    return rows.select("id", scalars.ulid_millis(F.col("t")).alias("millis"), scalars.ulid_random(F.col("t")).alias("random_hex"), scalars.ulid_valid(F.col("t")).alias("valid"))


@query(sql.with_(sql.REMOTE) + f"SELECT id, {ulid_sql('updated_at', 'h')} AS version_stamp FROM (SELECT id, updated_at, sha256(device_id) AS h FROM remote)")
def version_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.replica(spark, sf_dir, "remote").select("id", scalars.version_stamp(F.col("updated_at"), F.col("device_id")).alias("version_stamp"))


@query(sql.with_(sql.ACCOUNT) + """SELECT id, sha256('{"currency":"' || currency || '","deleted_at":' || coalesce(CAST(deleted_at AS VARCHAR), 'null') || ',"id":' || id || ',"name":"' || name || '","opening_balance_minor":' || opening_balance_minor || ',"repay_account_id":' || coalesce(CAST(repay_account_id AS VARCHAR), 'null') || '}') AS content_hash FROM account""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importer's hash over the columns that a record carries; the columns that differ by device stay out."""
    rows = adapter.accounts(spark, sf_dir).withColumns({"rev": F.col("id"), "updated_at": F.col("id"), "device_id": F.lit("x")})
    return rows.select("id", importer.fingerprint(["name", "id", "currency", "rev", "updated_at", "device_id", "opening_balance_minor", "repay_account_id", "deleted_at"]).alias("content_hash"))


# versions


@query(sql.with_(sql.VERSION) + """, best AS (SELECT id, max(struct_pack(s := version_stamp, h := content_hash, d := deleted)) AS w, count(*) AS merged_count FROM version GROUP BY id),
ms AS (SELECT id, substr(version_stamp, 1, 15) AS m, min(content_hash) <> max(content_hash) AS needs_review FROM version GROUP BY ALL)
SELECT best.id, w.s AS version_stamp, w.h AS content_hash, w.d AS deleted, merged_count, needs_review FROM best JOIN ms ON best.id = ms.id AND substr(w.s, 1, 15) = m""")
def version_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.reduce_versions(adapter.versions(spark, sf_dir), stamp_time=15)


@query(sql.with_(sql.LOCAL, sql.REMOTE) + """, p AS (SELECT r.id, r.updated_at AS ra, l.updated_at AS la, r.content_hash = l.content_hash AS same,
  r.updated_at > l.updated_at OR (r.updated_at = l.updated_at AND substr(sha256(r.device_id), 1, 20) > substr(sha256(l.device_id), 1, 20)) AS later FROM remote r JOIN local l ON r.id = l.id)
SELECT id, CASE WHEN later THEN 'remote' ELSE 'local' END AS side, CASE WHEN same THEN 'metadata_only' ELSE 'newer_stamp' END AS reason, NOT same AND ra = la AS needs_review, FALSE AS is_noop FROM p""")
def version_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    def side(name: str) -> DataFrame:
        rows = adapter.replica(spark, sf_dir, name)
        stamp = scalars.version_stamp(F.col("updated_at"), F.col("device_id"))
        return rows.select("id", F.struct(stamp.alias("version_stamp"), "device_id", "content_hash", F.col("deleted_at").isNotNull().alias("deleted")).alias(name))

    return versions.resolve(side("local").join(side("remote"), "id")).select("id", "side", "reason", "needs_review", "is_noop")


# merges


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return adapter.replica(spark, sf_dir, "remote"), adapter.replica(spark, sf_dir, "local")


def merge_query(name: str, mode: str = "merge", strategy: str = "abort", lww: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return merge.decide(*both(spark, sf_dir), mode, strategy, "edit_wins_by_lww" if lww else "conflict")

    QUERIES[name] = run
    SQL[name] = PAIRS + sql.decisions(mode, strategy, lww)


merge_query("merge_decide_abort")
merge_query("merge_decide_converge", strategy="converge")
merge_query("merge_decide_converge_lww", strategy="converge", lww=True)
merge_query("merge_decide_replace", mode="replace")
merge_query("merge_decide_supplement", mode="supplement_only")
CONVERGED = sql.with_(sql.LOCAL, sql.REMOTE, sql.PAIRS, f"decided AS ({sql.decisions('merge', 'converge')})")


@query(CONVERGED + "SELECT count(*) FILTER (write = 'INSERT') AS inserted, count(*) FILTER (write = 'UPDATE') AS updated, count(*) FILTER (outcome = 'skip') AS skipped, count(*) FILTER (outcome = 'conflict') AS conflicts, count(*) AS records FROM decided")
def merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.counters(merge.decide(*both(spark, sf_dir), "merge", "converge"))


@query(CONVERGED + "SELECT outcome, rule, count(*) AS n FROM decided GROUP BY outcome, rule")
def merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.decide(*both(spark, sf_dir), "merge", "converge").groupBy("outcome", "rule").agg(F.count("*").alias("n"))


@query(CONVERGED + "SELECT * FROM remote WHERE id IN (SELECT id FROM decided WHERE write IS NOT NULL) UNION ALL SELECT * FROM local WHERE id NOT IN (SELECT id FROM decided WHERE write IS NOT NULL)")
def merge_next_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return merge.next_state(local, remote, merge.decide(remote, local, "merge", "converge"))


def version_json(side: str) -> str:
    return f"""'{{"versionStamp":"' || {ulid_sql(f'{side}_at', f'{side}_h')} || '","contentHash":"' || {side}_hash || '","deleted":' || ({side}_gone IS NOT NULL) || '}}'"""


@query(CONVERGED + f"SELECT {ulid_sql(str(NOW), 'h')} AS conflict_id, 'account' AS entity, id AS record_id, conflict_kind AS kind, {version_json('l')} AS local_json, {version_json('r')} AS remote_json FROM (SELECT d.id, conflict_kind, sha256('job-1|account|' || d.id || '|' || conflict_kind) AS h, l.updated_at AS l_at, sha256(l.device_id) AS l_h, l.content_hash AS l_hash, l.deleted_at AS l_gone, r.updated_at AS r_at, sha256(r.device_id) AS r_h, r.content_hash AS r_hash, r.deleted_at AS r_gone FROM decided d JOIN local l ON d.id = l.id JOIN remote r ON d.id = r.id WHERE outcome = 'conflict')")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return merge.conflicts(remote, local, merge.decide(remote, local, "merge", "converge"), "job-1", "account", NOW)


@query(sql.with_(sql.LOCAL, sql.REMOTE) + f"SELECT id, ledger_id, name, balance, CAST({NOW} AS BIGINT) AS updated_at, 'device-a' AS device_id, CAST({NOW} AS BIGINT) AS deleted_at, content_hash FROM local WHERE deleted_at IS NULL AND ledger_id = 7 AND id NOT IN (SELECT id FROM remote)")
def merge_removals(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return merge.removed(merge.removals(local, remote, 7), NOW, "device-a")


@query(sql.with_(sql.REMOTE) + "SELECT id, CASE WHEN ledger_id < 5 THEN ledger_id + 100 ELSE ledger_id END AS ledger_id FROM remote")
def merge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = adapter.ledgers(spark, sf_dir).where("id < 5").select(F.col("id").alias("old"), (F.col("id") + 100).alias("new"))
    return merge.remap_ledgers(adapter.replica(spark, sf_dir, "remote"), mapping).select("id", "ledger_id")


# references and repair


def most_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.accounts(spark, sf_dir).where("id % 10 <> 0")


COMMON = f"CAST({NOW} AS BIGINT) AS created_at, CAST({NOW} AS BIGINT) AS updated_at, CAST(NULL AS BIGINT) AS deleted_at, 'device-a' AS device_id, CAST(1 AS BIGINT) AS rev"
SOME = "most AS (SELECT * FROM account WHERE id % 10 <> 0)"


@query(
    sql.with_(sql.LEDGER, sql.ACCOUNT, sql.CATEGORY, sql.TXN, SOME)
    + " UNION ALL ".join(
        f"SELECT '{child}.{column}' AS rule, count(*) AS n FROM {'most' if child == 'account' else child} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT id FROM {'most' if parent == 'account' else parent})"
        for child, column, parent in (("account", "ledger_id", "ledger"), ("account", "repay_account_id", "account"), ("category", "ledger_id", "ledger"), ("category", "parent_id", "category"), ("txn", "ledger_id", "ledger"), ("txn", "account_id", "account"), ("txn", "to_account_id", "account"), ("txn", "category_id", "category"))
    )
)
def orphan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"ledger": adapter.ledgers(spark, sf_dir), "account": most_accounts(spark, sf_dir), "category": adapter.categories(spark, sf_dir), "txn": adapter.txns(spark, sf_dir)}
    return repair.orphans(tables)


@query(
    sql.with_(sql.ACCOUNT, sql.TXN, SOME)
    + f"""SELECT id, arg_min(ledger_id, k) AS ledger_id, 'missing account' AS name, CAST(1 AS BIGINT) AS type, 'CNY' AS currency, CAST(0 AS BIGINT) AS opening_balance_minor, CAST(NULL AS BIGINT) AS credit_limit_minor, CAST(NULL AS VARCHAR) AS repay_account_id,
  CAST(1 AS BIGINT) AS is_archived, CAST(0 AS BIGINT) AS sort_order, {COMMON}
FROM (SELECT account_id AS id, ledger_id, struct_pack(r := 1, b := id, v := 'account_id') AS k FROM txn
      UNION ALL SELECT to_account_id, ledger_id, struct_pack(r := 1, b := id, v := 'to_account_id') FROM txn WHERE to_account_id IS NOT NULL
      UNION ALL SELECT repay_account_id, ledger_id, struct_pack(r := 0, b := id, v := 'repay_account_id') FROM most WHERE repay_account_id IS NOT NULL)
WHERE id NOT IN (SELECT id FROM most) GROUP BY id"""
)
def placeholder_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.placeholder_accounts(adapter.txns(spark, sf_dir), most_accounts(spark, sf_dir), "device-a", NOW).drop("statement_day", "due_day", "icon", "color", "note")


@query(T + f"SELECT category_id AS id, arg_min(ledger_id, id) AS ledger_id, CAST(CASE WHEN arg_min(type, id) = 2 THEN 2 ELSE 1 END AS BIGINT) AS kind, 'missing ' || right(category_id, 8) AS name, CAST(0 AS BIGINT) AS is_system, CAST(1 AS BIGINT) AS is_hidden, CAST(0 AS BIGINT) AS sort_order, {COMMON} FROM txn WHERE category_id IS NOT NULL GROUP BY category_id")
def placeholder_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.placeholder_categories(adapter.txns(spark, sf_dir), adapter.categories(spark, sf_dir), "device-a", NOW).drop("parent_id", "icon", "color")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts as a category tree with planted faults: chains of 4 and of 12, cycles of 3, missing and deleted parents."""
    key = F.col("c_custkey")
    place = key % 12
    parent = (
        F.when((key % 60 < 12) & (place > 0), key - 1)
        .when((key % 60 >= 24) & (key % 60 < 36), F.when(key % 3 == 2, key - 2).otherwise(key + 1))
        .when((key % 60 >= 36) & (key % 60 < 48), F.when(place % 4 > 0, key - 1))
        .when((key % 60 >= 48) & (place == 1), key + 1_000_000_000)
        .when((key % 60 >= 48) & (place == 2), key + 1)
    )
    gone = (key % 60 >= 48) & (place == 3)
    return adapter.table(spark, sf_dir, "customer").select(key.alias("id"), parent.alias("parent_id"), (key % 2 + 1).alias("kind"), F.concat(F.lit("n"), (key % 6).cast("string")).alias("name"), F.lit(0).cast("long").alias("ledger_id"), F.when(gone, F.lit(NOW)).alias("deleted_at"))


TREE = f"""tree AS (SELECT c_custkey AS id, CASE
  WHEN c_custkey % 60 < 12 AND c_custkey % 12 > 0 THEN c_custkey - 1
  WHEN c_custkey % 60 >= 24 AND c_custkey % 60 < 36 THEN CASE WHEN c_custkey % 3 = 2 THEN c_custkey - 2 ELSE c_custkey + 1 END
  WHEN c_custkey % 60 >= 36 AND c_custkey % 60 < 48 THEN CASE WHEN c_custkey % 12 % 4 > 0 THEN c_custkey - 1 END
  WHEN c_custkey % 60 >= 48 AND c_custkey % 12 = 1 THEN c_custkey + 1000000000
  WHEN c_custkey % 60 >= 48 AND c_custkey % 12 = 2 THEN c_custkey + 1 END AS parent_id,
  c_custkey % 2 + 1 AS kind, 'n' || (c_custkey % 6) AS name, CAST(0 AS BIGINT) AS ledger_id,
  CASE WHEN c_custkey % 60 >= 48 AND c_custkey % 12 = 3 THEN CAST({NOW} AS BIGINT) END AS deleted_at FROM customer)"""


@query(
    "WITH RECURSIVE "
    + TREE
    + """, walk AS (
  SELECT t.id, t.parent_id, CASE WHEN p.deleted_at IS NULL THEN p.parent_id END AS next, [t.id, t.parent_id] AS path, 1 AS depth,
         CASE WHEN t.parent_id = t.id THEN 'cycle' WHEN p.id IS NULL THEN 'missing' WHEN p.deleted_at IS NOT NULL THEN 'deleted' END AS reason
  FROM tree t LEFT JOIN tree p ON t.parent_id = p.id WHERE t.parent_id IS NOT NULL
  UNION ALL
  SELECT w.id, w.parent_id, CASE WHEN p.deleted_at IS NULL THEN p.parent_id END, list_append(w.path, w.next), w.depth + 1, CASE WHEN list_contains(w.path, w.next) THEN 'cycle' WHEN w.depth >= 8 THEN 'too_deep' END
  FROM walk w LEFT JOIN tree p ON w.next = p.id WHERE w.reason IS NULL AND w.next IS NOT NULL)
SELECT id, parent_id, reason FROM walk WHERE reason IS NOT NULL"""
)
def promote_to_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.promotions(tree(spark, sf_dir))


@query(sql.with_(TREE) + "SELECT ledger_id, kind, CAST(coalesce(parent_id, -1) AS VARCHAR) AS parent_key, name, count(*) AS n FROM tree WHERE deleted_at IS NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree(spark, sf_dir).withColumn("parent_id", F.coalesce("parent_id", F.lit(-1)).cast("string"))
    return repair.duplicate_names(rows, roots=True)


# validation


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.txns(spark, sf_dir)
    key = F.col("id")
    rows = rows.withColumn("amount_minor", F.when(key % 101 == 0, F.lit(0)).otherwise(F.col("amount_minor")))
    rows = rows.withColumn("to_account_id", F.when(key % 103 == 0, F.lit(None)).when((key % 107 == 0) & (F.col("type") == 3), F.col("account_id")).otherwise(F.col("to_account_id")))
    return rows.withColumn("fee_minor", F.when(key % 109 == 0, F.lit(7)).otherwise(F.col("fee_minor"))).withColumn("category_id", F.when(key % 113 == 0, F.lit(None)).otherwise(F.col("category_id")))


@query(
    T
    + """, faulty AS (SELECT id, type, CASE WHEN id % 101 = 0 THEN 0 ELSE amount_minor END AS amount_minor, account_id,
  CASE WHEN id % 103 = 0 THEN NULL WHEN id % 107 = 0 AND type = 3 THEN account_id ELSE to_account_id END AS to_account_id,
  CASE WHEN id % 109 = 0 THEN 7 ELSE fee_minor END AS fee_minor, CASE WHEN id % 113 = 0 THEN NULL ELSE category_id END AS category_id FROM txn)
SELECT id, violation FROM (SELECT id, CASE WHEN amount_minor <= 0 THEN 'amount' WHEN type = 3 AND to_account_id IS NULL THEN 'transfer_needs_target'
  WHEN type = 3 AND to_account_id = account_id THEN 'transfer_to_itself' WHEN type <> 3 AND category_id IS NULL THEN 'category_missing'
  WHEN type <> 3 AND fee_minor > 0 THEN 'fee_on_non_transfer' END AS violation FROM faulty) WHERE violation IS NOT NULL"""
)
def txn_shape_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.shape_violations(faulty(spark, sf_dir))


@query(
    sql.with_(sql.ACCOUNT, sql.TXN, SOME, "cat AS (SELECT DISTINCT category_id AS id, CAST(length(category_id) % 2 + 1 AS BIGINT) AS kind, CASE WHEN category_id LIKE '%7' THEN 1 END AS deleted_at FROM txn WHERE category_id NOT LIKE '%9')")
    + """SELECT id, violation FROM (SELECT t.id, CASE WHEN a.id IS NULL THEN 'account_missing' WHEN a.deleted_at IS NOT NULL THEN 'account_deleted'
  WHEN t.to_account_id IS NOT NULL AND b.id IS NULL THEN 'target_missing' WHEN t.to_account_id IS NOT NULL AND b.deleted_at IS NOT NULL THEN 'target_deleted'
  WHEN t.category_id IS NOT NULL AND c.id IS NULL THEN 'category_missing' WHEN c.deleted_at IS NOT NULL THEN 'category_deleted' WHEN c.kind <> t.type THEN 'category_kind' END AS violation
FROM txn t LEFT JOIN most a ON t.account_id = a.id LEFT JOIN most b ON t.to_account_id = b.id LEFT JOIN cat c ON t.category_id = c.id WHERE t.deleted_at IS NULL) WHERE violation IS NOT NULL"""
)
def reference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.txns(spark, sf_dir)
    name = F.col("category_id")
    cats = rows.where("category_id not like '%9'").select(name.alias("id"), (F.length(name) % 2 + 1).cast("long").alias("kind"), F.when(name.endswith("7"), 1).alias("deleted_at")).distinct()
    return checks.reference_violations(rows, most_accounts(spark, sf_dir), cats)


@query(sql.with_(sql.ACCOUNT, sql.TXN) + ", used AS (SELECT DISTINCT id AS t, account_id AS a FROM txn WHERE deleted_at IS NULL UNION SELECT id, to_account_id FROM txn WHERE deleted_at IS NULL AND to_account_id IS NOT NULL) SELECT account.id, count(*) AS n_txns FROM account JOIN used ON account.id = a WHERE account.deleted_at IS NULL GROUP BY account.id")
def account_delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.account_blockers(adapter.accounts(spark, sf_dir), adapter.txns(spark, sf_dir))


@query(sql.with_(sql.CATEGORY) + "SELECT c.id, count(k.id) AS n_children, CAST(0 AS BIGINT) AS n_txns FROM category c JOIN category k ON k.parent_id = c.id AND k.deleted_at IS NULL WHERE c.deleted_at IS NULL GROUP BY c.id")
def category_delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.category_blockers(adapter.categories(spark, sf_dir), adapter.txns(spark, sf_dir))


@query(sql.with_(sql.LEDGER, sql.ACCOUNT, sql.TXN) + "SELECT l.id, CAST(count(*) AS BIGINT) AS n FROM ledger l JOIN (SELECT ledger_id FROM account WHERE deleted_at IS NULL UNION ALL SELECT ledger_id FROM txn WHERE deleted_at IS NULL) x ON x.ledger_id = l.id WHERE l.deleted_at IS NULL GROUP BY l.id")
def ledger_delete_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ledger_blockers(adapter.ledgers(spark, sf_dir), {"account": adapter.accounts(spark, sf_dir), "txn": adapter.txns(spark, sf_dir)})


@query(
    sql.with_(TREE)
    + """SELECT id, violation FROM (SELECT t.id, CASE WHEN t.parent_id = t.id THEN 'own_parent' WHEN p.id IS NULL THEN 'parent_missing' WHEN p.deleted_at IS NOT NULL THEN 'parent_deleted'
  WHEN p.kind <> t.kind THEN 'parent_kind' WHEN p.parent_id IS NOT NULL THEN 'too_deep' END AS violation FROM tree t LEFT JOIN tree p ON t.parent_id = p.id WHERE t.parent_id IS NOT NULL) WHERE violation IS NOT NULL"""
)
def category_parent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.parent_errors(tree(spark, sf_dir))


@query(sql.with_(sql.REMOTE) + "SELECT id, ledger_id FROM remote WHERE ledger_id % 4 <> 0")
def scope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = adapter.ledgers(spark, sf_dir).where("id % 4 = 0").select("id")
    return checks.scope_violations(adapter.replica(spark, sf_dir, "remote").select("id", "ledger_id"), declared)


@query(f"SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'before_epoch' ELSE 'ahead' END AS warning FROM customer WHERE c_custkey % 50 IN (0, 1)")
def clock_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    at = F.when(key % 50 == 0, F.lit(0)).when(key % 50 == 1, NOW + checks.AHEAD_MS + 1).otherwise(F.lit(NOW))
    return checks.clock_warnings(adapter.table(spark, sf_dir, "customer").select(key.alias("id"), at.alias("updated_at")), NOW)


@query("SELECT * FROM (SELECT event_type AS type, count(*) + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS declared, count(*) AS observed FROM events GROUP BY event_type) WHERE declared <> observed")
def changeset_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adapter.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))
    declared = found.select("type", F.when(F.col("type") == "error", F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return checks.count_mismatches(found, declared)


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def changeset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"))


TYPED = "CAST(id AS VARCHAR) AS id, CAST(ledger_id AS VARCHAR) AS ledger_id, name, type, currency, opening_balance_minor, credit_limit_minor, CAST(repay_account_id AS VARCHAR) AS repay_account_id, sort_order, deleted_at"


@query(A + f"SELECT {TYPED}, CAST(0 AS BIGINT) AS n_violations FROM account")
def changeset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts written as a change set, verified, read back and typed; the SQL has the accounts themselves."""
    rows = adapter.accounts(spark, sf_dir)
    text = {c: F.col(c).cast("string") for c in ("id", "ledger_id", "repay_account_id")}
    rows = rows.withColumns(text | {"created_at": F.lit(NOW), "updated_at": F.lit(NOW), "device_id": F.lit("device-a"), "rev": F.lit(1).cast("long")})
    path = f"{scratch(spark)}/changeset-{uuid.uuid4().hex}"
    changeset.write_changeset({"account": rows}, path, NOW)
    changeset.verify(spark, path, None)
    back = changeset.read_records(changeset.read_lines(spark, path), "account")
    return back.select("id", "ledger_id", "name", "type", "currency", "opening_balance_minor", "credit_limit_minor", "repay_account_id", "sort_order", "deleted_at", F.size("violations").cast("long").alias("n_violations"))


@query(sql.with_(sql.LEDGER, sql.ACCOUNT, sql.TXN) + "SELECT 'ledger' AS stage, count(*) AS n FROM ledger UNION ALL SELECT 'account', count(*) FROM account UNION ALL SELECT 'txn', count(*) FROM txn")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table, from the canonical dump."""
    return seed.canonical({"ledger": adapter.ledgers(spark, sf_dir), "account": adapter.accounts(spark, sf_dir), "txn": adapter.txns(spark, sf_dir)}).select("stage", "n")


@query(sql.with_(TREE) + "SELECT kind, name, count(*) AS n FROM tree WHERE deleted_at IS NULL GROUP BY kind, name HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique_violations(tree(spark, sf_dir), ["kind", "name"])


# lists and writes


@query(T + f"SELECT id, ledger_id, {DAY} AS day_key, amount_minor FROM txn WHERE deleted_at IS NULL AND ledger_id = 4 ORDER BY day_key DESC, id DESC LIMIT 50 OFFSET 20")
def list_txns_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.txns(spark, sf_dir).withColumn("day_key", scalars.day_key(F.col("occurred_at"), F.col("tz_offset_min")))
    return lists.txn_page(rows, 4, 50, 20).select("id", "ledger_id", "day_key", "amount_minor")


@query(A + "SELECT id, ledger_id, row_number() OVER (PARTITION BY ledger_id ORDER BY sort_order, id) AS position FROM account WHERE deleted_at IS NULL")
def list_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.accounts(spark, sf_dir).where("deleted_at is null")
    return lists.positions(rows, ["ledger_id"], ["sort_order", "id"]).select("id", "ledger_id", "position")


@query(sql.with_(sql.CATEGORY) + "SELECT id, parent_id, row_number() OVER (PARTITION BY ledger_id ORDER BY parent_id NULLS FIRST, sort_order, id) AS position FROM category WHERE deleted_at IS NULL")
def list_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.categories(spark, sf_dir).where("deleted_at is null")
    return lists.positions(rows, ["ledger_id"], [F.col("parent_id").asc_nulls_first(), "sort_order", "id"]).select("id", "parent_id", "position")


@query(sql.with_(sql.LEDGER) + "SELECT id, code, row_number() OVER (PARTITION BY currency ORDER BY is_default DESC, sort_order, id) AS position FROM ledger WHERE deleted_at IS NULL")
def list_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.ledgers(spark, sf_dir).where("deleted_at is null")
    return lists.positions(rows, ["currency"], [F.desc("is_default"), "sort_order", "id"]).select("id", "code", "position")


@query(sql.with_(sql.LEDGER) + "SELECT id, code FROM ledger WHERE deleted_at IS NULL AND is_default = 1")
def default_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.default_ledger(adapter.ledgers(spark, sf_dir)).select("id", "code")


@query(A + "SELECT id, name FROM account WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 40 = 0)")
def batch_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = adapter.table(spark, sf_dir, "orders").where("o_orderkey % 40 = 0").select(F.col("o_custkey").alias("id"))
    return lists.batch(adapter.accounts(spark, sf_dir), ids).select("id", "name")


@query(sql.with_(sql.LOCAL, sql.REMOTE) + "SELECT * FROM local UNION ALL SELECT * FROM remote WHERE id NOT IN (SELECT id FROM local)")
def merge_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return lists.merge_by_id(local, remote)


@query(sql.with_(sql.LOCAL, sql.REMOTE) + "SELECT id, ledger_id, name, balance, updated_at, device_id, deleted_at, content_hash FROM local UNION ALL SELECT * FROM remote WHERE id NOT IN (SELECT id FROM local)")
def record_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return writes.create(local, remote)[0]


@query(sql.with_(sql.LOCAL, sql.REMOTE) + "SELECT r.id, CASE WHEN l.id IS NULL THEN 'missing' ELSE 'deleted' END AS violation FROM remote r LEFT JOIN local l ON r.id = l.id WHERE l.id IS NULL OR l.deleted_at IS NOT NULL")
def record_update_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote, local = both(spark, sf_dir)
    return writes.update(local, remote, ("ledger_id",))[1]


@query(
    sql.with_(sql.ACCOUNT, sql.TXN)
    + f""", used AS (SELECT account_id AS id FROM txn WHERE deleted_at IS NULL UNION SELECT to_account_id FROM txn WHERE deleted_at IS NULL AND to_account_id IS NOT NULL)
SELECT id, CASE WHEN id % 3 = 0 AND deleted_at IS NULL AND id NOT IN (SELECT id FROM used) THEN CAST({NOW} AS BIGINT) ELSE deleted_at END AS deleted_at FROM account"""
)
def account_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, txns = adapter.accounts(spark, sf_dir), adapter.txns(spark, sf_dir)
    state, _ = writes.soft_delete(rows, rows.where("id % 3 = 0").select("id"), NOW, checks.account_blockers(rows, txns))
    return state.select("id", "deleted_at")


@query(T + f"SELECT ledger_id, id, amount_minor, rank FROM (SELECT ledger_id, id, amount_minor, row_number() OVER (PARTITION BY ledger_id ORDER BY amount_minor DESC, id) AS rank FROM txn WHERE deleted_at IS NULL AND type = 1) WHERE rank <= 10")
def top_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: each ledger's ten largest expenses."""
    rows = adapter.txns(spark, sf_dir).where("deleted_at is null and type = 1")
    rank = F.row_number().over(Window.partitionBy("ledger_id").orderBy(F.desc("amount_minor"), "id")).cast("long")
    return rows.withColumn("rank", rank).where("rank <= 10").select("ledger_id", "id", "amount_minor", "rank")


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(p_name, 'old') AND contains(lower(p_name), 'widget')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search, as a trigram index would answer it."""
    return adapter.table(spark, sf_dir, "part").where(F.contains("p_name", F.lit("old")) & F.contains(F.lower("p_name"), F.lit("widget"))).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


#: The queries of the other module are in the same tables.
__all__ = ["QUERIES", "SQL", "exchange"]

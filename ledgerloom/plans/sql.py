"""The adapter's tables as DuckDB SQL, for the queries' oracles."""

from __future__ import annotations

BASE_MS = 1_758_000_000_000

LEDGER = f"""ledger AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, 'L' || n_nationkey AS code, 'CNY' AS currency,
         CASE WHEN n_nationkey = 3 THEN 1 ELSE 0 END AS is_default, CAST(n_nationkey AS BIGINT) * 7 % 10 AS sort_order,
         CASE WHEN n_nationkey % 11 = 10 THEN CAST({BASE_MS} AS BIGINT) END AS deleted_at
  FROM nation)"""

ACCOUNT = f"""account AS (
  SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS ledger_id, c_name AS name, c_custkey % 5 + 1 AS type, 'CNY' AS currency,
         CAST(round(c_acctbal * 100) AS BIGINT) AS opening_balance_minor,
         CASE WHEN c_custkey % 5 = 2 THEN 500000 + c_custkey * 100 END AS credit_limit_minor,
         CASE WHEN c_custkey % 9 = 4 THEN c_custkey + 1 END AS repay_account_id,
         c_custkey * 3 % 10 AS sort_order,
         CASE WHEN c_custkey % 17 = 5 THEN {BASE_MS} + c_custkey END AS deleted_at
  FROM customer)"""

CATEGORY = f"""category AS (
  SELECT id, parent_id, name, CAST(length(name) % 2 + 1 AS BIGINT) AS kind, CAST(0 AS BIGINT) AS ledger_id,
         CAST(length(id) % 7 AS BIGINT) AS sort_order, CASE WHEN name LIKE '%3' THEN CAST({BASE_MS} AS BIGINT) END AS deleted_at
  FROM (SELECT DISTINCT 'R:' || p_type AS id, CAST(NULL AS VARCHAR) AS parent_id, p_type AS name FROM part
        UNION ALL
        SELECT DISTINCT 'C:' || p_type || ':' || p_brand, 'R:' || p_type, p_brand FROM part))"""

TXN = f"""txn AS (
  SELECT o_orderkey AS id, o_custkey % 25 AS ledger_id, kind AS type, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor, 'CNY' AS currency,
         CASE WHEN kind = 3 THEN o_orderkey % 500 ELSE 0 END AS fee_minor, epoch_us(o_orderdate) // 1000 AS occurred_at,
         (o_orderkey % 29 - 14) * 60 AS tz_offset_min, o_custkey AS account_id,
         CASE WHEN kind = 3 THEN o_custkey + 1 - o_custkey % 2 * 2 END AS to_account_id,
         CASE WHEN kind <> 3 THEN 'K' || (o_orderkey % 150) END AS category_id,
         CASE WHEN o_orderkey % 23 = 0 THEN 1 ELSE 0 END AS excluded_from_stats,
         CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 7 = 0 THEN CAST({BASE_MS} AS BIGINT) END AS deleted_at
  FROM (SELECT *, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS kind FROM orders))"""


def legs(source: str = "txn", name: str = "legs") -> str:
    return f"""{name} AS (
  SELECT id AS txn_id, account_id, CASE WHEN type = 2 THEN amount_minor ELSE -amount_minor - fee_minor END AS delta, occurred_at FROM {source} WHERE deleted_at IS NULL
  UNION ALL
  SELECT id, to_account_id, amount_minor, occurred_at FROM {source} WHERE deleted_at IS NULL AND type = 3)"""


LEGS = legs()

BALANCE = """balance AS (
  SELECT coalesce(a.id, m.account_id) AS id, CAST(coalesce(a.opening_balance_minor, 0) + coalesce(m.delta, 0) AS BIGINT) AS balance_minor, coalesce(m.as_of, 0) AS balance_as_of
  FROM account a FULL JOIN (SELECT account_id, sum(delta) AS delta, max(occurred_at) AS as_of FROM legs GROUP BY account_id) m ON a.id = m.account_id)"""

CACHED = """cached AS (SELECT a.*, b.balance_minor AS cached_balance_minor FROM account a JOIN balance b ON a.id = b.id)"""

VERSION = """version AS (
  SELECT user_id AS id, ms AS updated_at, lpad(CAST(ms AS VARCHAR), 15, '0') || '-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS version_stamp,
         event_type AS device_id, sha256(coalesce(props, '')) AS content_hash, event_type = 'error' AS deleted
  FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events))"""

_SEEN = "sha256(CAST(id AS VARCHAR) || '|' || name || '|' || CAST(balance AS VARCHAR) || '|' || coalesce(CAST(deleted_at AS VARCHAR), '-')) AS content_hash"

LOCAL = f"""local AS (
  SELECT *, {_SEEN} FROM (
    SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS ledger_id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance,
           {BASE_MS} + c_custkey % 7 * 1000 AS updated_at, 'device-a' AS device_id,
           CASE WHEN c_custkey % 13 = 6 THEN {BASE_MS} + c_custkey % 7 * 1000 END AS deleted_at
    FROM customer WHERE c_custkey % 19 <> 1))"""

REMOTE = f"""remote AS (
  SELECT *, {_SEEN} FROM (
    SELECT id, ledger_id, name, CASE WHEN id % 7 = 0 THEN balance + 100 ELSE balance END AS balance, edited_at AS updated_at, 'device-b' AS device_id,
           CASE WHEN id % 13 = 7 OR id % 26 = 6 THEN edited_at END AS deleted_at
    FROM (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS ledger_id, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS balance,
                 {BASE_MS} + c_custkey % 5 * 40000 - CASE WHEN c_custkey % 3 = 0 THEN 90000 ELSE 0 END AS edited_at
          FROM customer WHERE c_custkey % 11 <> 1)))"""

PAIRS = """pairs AS (
  SELECT r.id, l.id IS NULL AS missing, r.deleted_at IS NOT NULL AS rg, l.deleted_at IS NOT NULL AS lg, r.content_hash = l.content_hash AS same,
         abs(r.updated_at - coalesce(l.updated_at, 0)) < 60000 AS near,
         r.updated_at > l.updated_at OR (r.updated_at = l.updated_at AND substr(sha256(r.device_id), 1, 20) > substr(sha256(l.device_id), 1, 20)) AS wins
  FROM remote r LEFT JOIN local l ON r.id = l.id)"""


def decisions(mode: str = "merge", strategy: str = "abort", lww: bool = False) -> str:
    """(id, outcome, rule, conflict_kind, write) as a table expression over pairs; the two devices never tie."""
    ins = "CASE WHEN rg THEN 'insert_tombstone' ELSE 'insert' END"
    rows: list[tuple[str, str, str, str, str]] = []
    if mode == "supplement_only":
        rows = [("missing", ins, "'fill_only_new'", "NULL", "'INSERT'"), ("TRUE", "'skip'", "'fill_only_existing'", "NULL", "NULL")]
    elif mode == "replace":
        rule = "CASE WHEN rg THEN 'overwrite_tombstone' ELSE 'overwrite_by_file' END"
        rows = [("missing", ins, rule, "NULL", "'INSERT'"), ("TRUE", "CASE WHEN rg THEN 'mark_deleted' ELSE 'update' END", rule, "NULL", "'UPDATE'")]
    else:
        rows = [("missing", ins, "CASE WHEN rg THEN 'local_missing_tombstone' ELSE 'local_missing' END", "NULL", "'INSERT'")]
        if strategy == "abort":
            rows += [("same", "'skip'", "'identical_content'", "NULL", "NULL"), ("TRUE", "'conflict'", "'abort_on_divergence'", "CASE WHEN rg <> lg THEN 2 ELSE 1 END", "NULL")]
        else:
            won = "CASE WHEN wins THEN 'UPDATE' END"
            rows += [
                ("same AND rg = lg", "'skip'", "'identical_content'", "NULL", "NULL"),
                ("rg AND lg", "'skip'", "'both_deleted'", "NULL", "NULL"),
                ("rg <> lg AND NOT CASE WHEN lg THEN wins ELSE NOT wins END", "CASE WHEN lg THEN 'skip' ELSE 'mark_deleted' END", "'tombstone_wins'", "NULL", "CASE WHEN lg THEN NULL ELSE 'UPDATE' END"),
                ("rg <> lg", "'resurrect'", "'delete_vs_edit_lww'", "NULL", "'UPDATE'") if lww else ("rg <> lg", "'conflict'", "'delete_vs_edit'", "2", won),
                ("near", "'conflict'", "'ambiguous_window'", "1", won),
                ("wins", "'update'", "'remote_newer'", "NULL", "'UPDATE'"),
                ("TRUE", "'skip'", "'local_newer'", "NULL", "NULL"),
            ]
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rows) + " END"
    return f"SELECT id, {pick(1)} AS outcome, {pick(2)} AS rule, CAST({pick(3)} AS BIGINT) AS conflict_kind, CAST({pick(4)} AS VARCHAR) AS write FROM pairs"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


ULID = "array_to_string(list_transform(range({n}), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(1 + (({v} >> CAST(5 * ({n} - 1 - i) AS INTEGER)) & 31) AS BIGINT), 1)), '')"


def ulid_sql(ms: str, hex20: str) -> str:
    """The text of a ULID from its time and the first 20 hexadecimal digits of a text."""
    half = lambda at: f"CAST('0x' || substr({hex20}, {at}, 10) AS BIGINT)"
    return " || ".join([ULID.format(n=10, v=ms), ULID.format(n=8, v=half(1)), ULID.format(n=8, v=half(11))])

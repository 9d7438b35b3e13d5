"""Known cases that another implementation of the same formats must agree on. Ids, stamps, amounts, texts and
results below."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import identifiers, scalars
from ledgerloom.operators import balance, versions
from ledgerloom.sources import payload

# versions of a record
RECORD, OTHER = "01JGFJFXB00000000000000000", "01JGFJFXB0144GJ289144GJ289"
EARLY, LATE, LATEST = "01JGFJJZ00040G2081040G2081", "01JGFJJZZ8081040G2081040G2", "01JGFJK0YG0C1G60R30C1G60R3"
SAME_MS = ("01JGFJJZ001850M2GA1850M2GA", "01JGFJJZ001C5GP2RB1C5GP2RB")
ONE, TWO = "01JGFJCVP0248H248H248H248H", "01JGFJCVP148H248H248H248H2"
X, Y, Z = "7b3d0a12fb49b07319fc69f17d940ac70c3e8741f39d6a311359ce8205375d31", "0cbfa847619d688226855278706687a40d82dd74d8ab8ba7cef414309ebfb1d6", "9067a4303ee542c96bd4a7c73e81f1a43fbbebcb9a103d739d1be6603cdc6557"
VERSION = "struct<id: string, version_stamp: string, device_id: string, content_hash: string, deleted: boolean>"
FIRST, SECOND = (RECORD, EARLY, ONE, X, False), (RECORD, LATE, TWO, Y, False)
RESOLVED = {
    "identical": (FIRST, FIRST, "none", "identical", False, True, FIRST),
    "remote newer": (FIRST, SECOND, "remote", "newer_stamp", False, False, SECOND),
    "local newer": (SECOND, FIRST, "local", "newer_stamp", False, False, SECOND),
    "metadata only": (FIRST, (RECORD, LATE, TWO, X, False), "remote", "metadata_only", False, False, (RECORD, LATE, TWO, X, False)),
    "one millisecond": ((RECORD, SAME_MS[0], ONE, X, False), (RECORD, SAME_MS[1], TWO, Y, False), "remote", "newer_stamp", True, False, (RECORD, SAME_MS[1], TWO, Y, False)),
    "stamp collision": (FIRST, (RECORD, EARLY, ONE, Y, False), "local", "stamp_collision", True, False, FIRST),
    "tombstone newer": (FIRST, (RECORD, LATE, TWO, X, True), "remote", "newer_stamp", False, False, (RECORD, LATE, TWO, X, True)),
    "edit after deletion": ((RECORD, EARLY, ONE, X, True), SECOND, "remote", "newer_stamp", False, False, SECOND),
}


@pytest.mark.parametrize("name", RESOLVED)
def test_resolve(spark, name):
    local, remote, *expected = RESOLVED[name]
    pairs = spark.createDataFrame([(RECORD, local, remote)], f"id string, local {VERSION}, remote {VERSION}")
    r = versions.resolve(pairs).first()
    assert [r["side"], r["reason"], r["needs_review"], r["is_noop"], tuple(r["winner"])] == expected
    assert pairs.select(versions.pair_error()).first()[0] is None


@pytest.mark.parametrize(("local", "remote", "error"), [(FIRST, (OTHER, LATE, ONE, Y, False), "other_record"), ((RECORD, EARLY, ONE, "abc", False), SECOND, "bad_hash")])
def test_versions_that_cannot_be_compared(spark, local, remote, error):
    pairs = spark.createDataFrame([(local, remote)], f"local {VERSION}, remote {VERSION}")
    assert pairs.select(versions.pair_error()).first()[0] == error


REDUCED = {
    "three": ([FIRST, SECOND, (RECORD, LATEST, ONE, Z, False)], (LATEST, Z, False, 3, False)),
    "tombstone": ([FIRST, (RECORD, LATE, TWO, X, True)], (LATE, X, True, 2, False)),
    "one millisecond": ([(RECORD, SAME_MS[0], ONE, X, False), (RECORD, SAME_MS[1], TWO, Y, False)], (SAME_MS[1], Y, False, 2, True)),
}


@pytest.mark.parametrize("name", REDUCED)
def test_reduce(spark, name):
    rows, expected = REDUCED[name]
    for order in (rows, rows[::-1]):
        got = versions.reduce_versions(spark.createDataFrame(order, VERSION[7:-1])).first()
        assert tuple(got[c] for c in ("version_stamp", "content_hash", "deleted", "merged_count", "needs_review")) == expected


@pytest.mark.parametrize(
    ("version", "error", "millis"),
    [(FIRST, None, 1735689600000), ((RECORD, EARLY, ONE, X, True), None, 1735689600000), (("NOT-A-ULID-AT-ALL-00000000", EARLY, ONE, X, False), "bad_id", 1735689600000), ((RECORD, "NOT-A-ULID-AT-ALL-00000000", ONE, X, False), "bad_stamp", None), ((RECORD, EARLY, ONE, "abc", False), "bad_hash", 1735689600000)],
)
def test_validity(spark, version, error, millis):
    row = spark.createDataFrame([version], VERSION[7:-1]).select(versions.version_error().alias("e"), versions.version_millis().alias("ms")).first()
    assert (row["e"], row["ms"]) == (error, millis)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


# money: minor units, decimals, options and text
FORMATTED = [(123456789, 2, {}, "1,234,567.89"), (-123456789, 2, {}, "-1,234,567.89"), (-1, 2, {}, "-0.01"), (0, 2, {"code": "CNY"}, "0.00 CNY"), (1234, 0, {}, "1,234"), (123456789, 2, {"grouping": False}, "1234567.89"), (9007199254740991, 2, {}, "90,071,992,547,409.91")]
PARSED = [("¥1,234.56", "CNY", 123456, "1,234.56"), ("1234.56 CNY", "CNY", 123456, "1,234.56"), ("-12", "CNY", -1200, "-12.00"), ("+3.5", "CNY", 350, "3.50"), ("0.01", "CNY", 1, "0.01"), ("1234", "JPY", 1234, "1,234"), ("1.234", "CNY", None, None), ("１２３４", "CNY", None, None), ("", "CNY", None, None)]


@pytest.mark.parametrize(("minor", "scale", "options", "text"), FORMATTED)
def test_money_format(spark, minor, scale, options, text):
    assert value(spark, scalars.money_format(F.lit(minor), scale, **options)) == text


@pytest.mark.parametrize(("text", "currency", "minor", "formatted"), PARSED)
def test_money_parse(spark, text, currency, minor, formatted):
    parsed = value(spark, scalars.money_parse(F.lit(text), currency))
    assert parsed == minor
    if minor is not None:
        assert value(spark, scalars.money_format(F.lit(parsed), scalars.SCALES[currency])) == formatted


def test_money_sum(spark):
    rows = lambda x: spark.createDataFrame(x, "amount long, currency string")
    assert balance.money_sum(rows([(100, "CNY"), (250, "CNY"), (-50, "CNY")]), "amount", "currency").first()["sum_minor"] == 300
    assert balance.money_sum(rows([]), "amount", "currency").first()["sum_minor"] == 0
    with pytest.raises(Exception, match="several currencies"):
        balance.money_sum(rows([(100, "CNY"), (100, "USD")]), "amount", "currency").collect()


def test_money_arithmetic(spark):
    cny, usd = F.lit("CNY"), F.lit("USD")
    assert value(spark, scalars.money_add(F.lit(5), F.lit(-7), cny, cny)) == -2 and value(spark, scalars.money_subtract(F.lit(5), F.lit(7), cny, cny)) == -2
    assert value(spark, scalars.money_times(F.lit(-12), F.lit(3))) == -36 and value(spark, scalars.money_compare(F.lit(1), F.lit(2), cny, cny)) == -1
    most = F.lit(2**53 - 1)
    for bad in (scalars.money_add(most, F.lit(1), cny, cny), scalars.money_add(F.lit(1), F.lit(1), cny, usd), scalars.money_times(most, F.lit(2)), scalars.money_compare(F.lit(1), F.lit(1), cny, usd), scalars.money_times(most, F.lit(2**40))):
        with pytest.raises(Exception, match="out of range|different currencies"):
            value(spark, bad)
    text = value(spark, scalars.money_json(F.lit(-350), cny))
    assert text == '{"minorUnits":-350,"currency":"CNY","scale":2}' and tuple(value(spark, scalars.money_from_json(F.lit(text)))) == (-350, "CNY", 2)
    for broken in ('{"minorUnits":"1","currency":"CNY","scale":2}', '{"minorUnits":1.5,"currency":"CNY","scale":2}', '{"currency":"CNY","scale":2}', '{"minorUnits":9007199254740992,"currency":"CNY","scale":2}', "[]"):
        assert value(spark, scalars.money_from_json(F.lit(broken))) is None


# identifiers: milliseconds, random part, text
ENCODED = [(0, "00000000000000000000", "00000000000000000000000000"), (1, "00000000000000000000", "00000000010000000000000000"), (1735689600000, "00010203040506070809", "01JGFJJZ00000G40R40M30E209"), (281474976710655, "ffffffffffffffffffff", "7ZZZZZZZZZZZZZZZZZZZZZZZZZ")]


@pytest.mark.parametrize(("ms", "random", "text"), ENCODED)
def test_ulid(spark, ms, random, text):
    assert value(spark, scalars.ulid_encode(F.lit(ms), F.lit(random))) == text
    assert value(spark, scalars.ulid_millis(F.lit(text))) == ms and value(spark, scalars.ulid_random(F.lit(text))) == random
    assert identifiers.encode(ms, int(random, 16)) == text


@pytest.mark.parametrize(("text", "valid"), [("01JGFJJZ00000G40R40M30E209", True), ("01JGFJJZ00000G40R40M30E2OI", False), ("Z0000000000000000000000000", False), ("01JGFJJZ00000G40R40M30E20", False), ("01jgfjjz00000g40r40m30e2u9", False)])
def test_ulid_valid(spark, text, valid):
    assert value(spark, scalars.ulid_valid(F.lit(text))) is valid


def test_ulids_grow_within_a_millisecond():
    made = identifiers.Ulids(lambda: 1735689600000, lambda: 0)
    got = [made.next() for _ in range(5)]
    assert got[0] == "01JGFJJZ000000000000000000" and got[-1] == "01JGFJJZ000000000000000004" and sorted(set(got)) == got


# replays: accounts with opening balances, transactions in their last state, balances with the last time, sums, day keys
A, B, C = "05TKT1EFPNVBJS07MBR3AHRZ6D", "02TGQY5CKN1SFPX4TBR07E6W3A", "0ATHZ6DTVNVGQY5CKBR8FPX4BJ"
DAY1, DAY2 = 1789000000000, 1789086400000
REPLAYS = {
    "expense and income": ([(A, 100000)], [("t1", 1, 3500, 0, A, None, DAY1, 480, 0, None), ("t2", 2, 20000, 0, A, None, DAY2, 480, 0, None)], {A: (116500, DAY2)}, (20000, 3500, 0, 0), ["2026-09-10", "2026-09-11"]),
    "transfer with fee": ([(A, 100000), (B, 0)], [("t1", 3, 10000, 200, A, B, DAY1, 480, 0, None)], {A: (89800, DAY1), B: (10000, DAY1)}, (0, 200, 10000, 200), ["2026-09-10"]),
    "credit card": ([(A, 100000), (C, 0)], [("t1", 1, 3500, 0, C, None, DAY1, 480, 0, None), ("t2", 3, 1000, 0, A, C, DAY2, 480, 0, None)], {A: (99000, DAY2), C: (-2500, DAY2)}, (0, 3500, 1000, 0), ["2026-09-10", "2026-09-11"]),
    "edited into a transfer": ([(A, 0), (B, 0), (C, 0)], [("t1", 3, 3000, 0, B, C, DAY2, 480, 0, None)], {A: (0, 0), B: (-3000, DAY2), C: (3000, DAY2)}, (0, 0, 3000, 0), ["2026-09-11"]),
    "deleted": ([(A, 50000)], [("t1", 1, 12000, 0, A, None, DAY1, 480, 0, 5)], {A: (50000, 0)}, (0, 0, 0, 0), []),
    "excluded": ([(A, 1000)], [("t1", 1, 700, 0, A, None, DAY1, 480, 1, None)], {A: (300, DAY1)}, (0, 0, 0, 0), ["2026-09-10"]),
    "day keys": ([(A, 0)], [("t1", 1, 100, 0, A, None, 1789028800000, 480, 0, None), ("t2", 1, 100, 0, A, None, 1788985600000, -300, 0, None)], {A: (-200, 1789028800000)}, (0, 200, 0, 0), ["2026-09-10", "2026-09-09"]),
}


@pytest.mark.parametrize("name", REPLAYS)
def test_replay(spark, name):
    accounts, txns, balances, sums, days = REPLAYS[name]
    a = spark.createDataFrame(accounts, "id string, opening_balance_minor long")
    t = spark.createDataFrame([(*x, "CNY") for x in txns], "id string, type long, amount_minor long, fee_minor long, account_id string, to_account_id string, occurred_at long, tz_offset_min long, excluded_from_stats int, deleted_at long, currency string")
    assert {r["id"]: (r["balance_minor"], r["balance_as_of"]) for r in balance.balances(a, t).collect()} == balances
    s = balance.summary(t).first()
    assert (s["income_minor"], s["expense_minor"], s["transfer_minor"], s["fee_minor"]) == sums
    got = t.where("deleted_at is null").orderBy("id").select(scalars.day_key(F.col("occurred_at"), F.col("tz_offset_min"))).collect()
    assert [r[0] for r in got] == days


def test_incremental_export_payload():
    device, ledger = "01J8Z9K2M4P6Q8R0T2V4X6Z8B1", "01J8TESTLEDGER0000000000001"
    manifest = {"type": "manifest", "appVersion": "1.0.0", "deviceId": device, "deviceName": "向量生成器", "platform": "ios", "exportedAt": 1757922500000, "exportKind": "incremental", "sinceExportAt": 1757000000000, "changeLogRange": {"minSeq": 120, "maxSeq": 456}, "includesAttachments": False, "counts": {"txn": 1}}
    txn = {"id": "01J8TESTTXN00000000000002", "ledgerId": ledger, "txnType": 2, "amountMinor": 9900, "currency": "CNY", "occurredAt": 1757920000000, "dayKey": "2026-09-15", "monthKey": "2026-09", "tzOffsetMin": 480, "accountId": "01J8TESTACCNT00000000000001", "toAccountId": None, "categoryId": None, "merchant": None, "note": None, "tags": [], "feeMinor": 0, "isReimbursable": 0, "excludedFromStats": 0, "createdAt": 1757920000000, "updatedAt": 1757920000000, "deletedAt": None, "deviceId": device, "originDeviceId": device, "rev": 3}
    data, n, digest = payload.encode(manifest, {"txn": [txn]}, 1757922500000)
    assert (n, digest) == (1, "a2951bd93ac9d9f1a5f672ada39d0571122a9e77f050f6438bd9dd34a7911ed3")
    assert hashlib.sha256(data).hexdigest() == "e2269b885e56e1ceae435001988f8b4b586e50a88c2e49a3a41fad19282583ad"

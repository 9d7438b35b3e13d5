"""Scalars against known values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("ms", "tz", "day", "month"),
    [(0, 0, "1970-01-01", "1970-01"), (-1, 0, "1969-12-31", "1969-12"), (1_758_000_000_000, 480, "2025-09-16", "2025-09"), (1_735_689_599_999, 0, "2024-12-31", "2024-12"), (1_735_689_599_999, 1, "2025-01-01", "2025-01"), (1_735_689_600_000, -840, "2024-12-31", "2024-12")],
)
def test_day_key(spark, ms, tz, day, month):
    for zone in ("UTC", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert value(spark, scalars.day_key(F.lit(ms), F.lit(tz))) == day
            assert value(spark, scalars.month_key(F.lit(ms), F.lit(tz))) == month
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_key_range(spark):
    with pytest.raises(Exception, match="offset"):
        value(spark, scalars.day_key(F.lit(0), F.lit(841)))


@pytest.mark.parametrize(
    ("text", "currency", "minor"),
    [
        ("1,234,567.89", "CNY", 123456789),
        ("-0.01", "CNY", -1),
        ("¥12", "CNY", 1200),
        ("¥-5", "CNY", -500),
        ("-¥5", "CNY", None),
        ("+7.5", "USD", 750),
        ("12.345", "CNY", None),
        ("100", "JPY", 100),
        ("100.0", "JPY", None),
        ("9 000_000 cny", "CNY", 900000000),
        ("CNY", "CNY", None),
        ("", "CNY", None),
        ("90071992547409.91", "CNY", 2**53 - 1),
        ("90071992547409.92", "CNY", None),
        ("000000000000000000001.00", "CNY", 100),
        ("1e5", "CNY", None),
    ],
)
def test_money_parse(spark, text, currency, minor):
    assert value(spark, scalars.money_parse(F.lit(text), currency)) == minor


@pytest.mark.parametrize(("minor", "scale", "text"), [(123456789, 2, "1,234,567.89"), (-123456789, 2, "-1,234,567.89"), (-1, 2, "-0.01"), (0, 2, "0.00"), (1000, 0, "1,000"), (999, 0, "999"), (2**53 - 1, 2, "90,071,992,547,409.91")])
def test_money_format(spark, minor, scale, text):
    assert value(spark, scalars.money_format(F.lit(minor), scale)) == text
    assert value(spark, scalars.money_format(F.lit(minor), scale, False, "CNY")) == text.replace(",", "") + " CNY"


@pytest.mark.parametrize(("ms", "random", "ulid"), [(0, "0" * 20, "0" * 26), (1, "0" * 20, "0000000001" + "0" * 16), (1735689600000, "00010203040506070809", "01JGFJJZ00000G40R40M30E209"), (2**48 - 1, "f" * 20, "7" + "Z" * 25)])
def test_ulid(spark, ms, random, ulid):
    assert value(spark, scalars.ulid_encode(F.lit(ms), F.lit(random))) == ulid
    for text in (ulid, ulid.lower()):
        assert value(spark, scalars.ulid_millis(F.lit(text))) == ms
        assert value(spark, scalars.ulid_random(F.lit(text))) == random


@pytest.mark.parametrize("text", ["8" + "0" * 25, "0" * 25, "0" * 27, "U" * 26, "", "0" * 25 + "I"])
def test_ulid_invalid(spark, text):
    assert value(spark, scalars.ulid_valid(F.lit(text))) is False
    assert value(spark, scalars.ulid_millis(F.lit(text))) is None


def test_canonical_json(spark):
    assert value(spark, scalars.canonical_json(F.lit('{"b":1,"a":{"d":null,"c":"é/"}}'))) == '{"a":{"c":"é/","d":null},"b":1}'

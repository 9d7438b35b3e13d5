"""Scalar domains as Column expressions: calendar keys, money text, ULIDs, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base 32.
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
#: Decimals of each currency.
SCALES = {"CNY": 2, "EUR": 2, "JPY": 0, "KRW": 0, "USD": 2}
#: Fixed value: the largest amount in minor units, the largest integer that a double holds exactly.
MOST_MINOR = 2**53 - 1
#: Fixed value: a time-zone offset's limit in minutes.
MOST_OFFSET = 840
#: The symbols that may stand before an amount.
SYMBOLS = "¥￥$€£"


def _shifted(ms: Column, tz_offset_min: Column) -> Column:
    bad = F.abs(tz_offset_min) > MOST_OFFSET
    return F.when(bad, F.raise_error(F.lit("time-zone offset out of range")).cast("long")).otherwise(ms + tz_offset_min.cast("long") * 60_000)


def _days(ms: Column, tz_offset_min: Column) -> Column:
    """Local days since the epoch; integer arithmetic, so no session time zone has a part."""
    at = _shifted(ms, tz_offset_min)
    return F.date_from_unix_date(F.floor((at - F.pmod(at, F.lit(86_400_000))) / 86_400_000).cast("int"))


def day_key(ms: Column, tz_offset_min: Column) -> Column:
    """yyyy-MM-dd of an instant (epoch milliseconds) at an offset in minutes."""
    return _days(ms, tz_offset_min).cast("string")


def month_key(ms: Column, tz_offset_min: Column) -> Column:
    return F.substring(day_key(ms, tz_offset_min), 1, 7)


def currency_scale(currency: Column) -> Column:
    """Decimals of a currency; null if it isn't known."""
    out = F.lit(None).cast("int")
    for code, scale in SCALES.items():
        out = F.when(currency == code, F.lit(scale)).otherwise(out)
    return out


def money_parse(text: Column, currency: str) -> Column:
    """Minor units of an amount's text, or null where it isn't one or lies out of range.

    Grouping (comma, space, underscore), one leading symbol and a trailing currency code are taken off, in that order;
    then a sign, digits and at most the currency's decimals must be left. Nothing is rounded.
    """
    scale = SCALES[currency]
    bare = F.regexp_replace(F.trim(text), "[, _]", "")
    bare = F.regexp_replace(bare, f"^[{SYMBOLS}]", "")
    bare = F.when(F.length(bare) > len(currency), F.regexp_replace(bare, f"(?i){currency}$", "")).otherwise(bare)
    pattern = r"^([+-]?)([0-9]+)(?:\.([0-9]+))?$"
    whole, part = F.regexp_extract(bare, pattern, 2), F.regexp_extract(bare, pattern, 3)
    units = F.concat(whole, F.rpad(part, scale, "0")) if scale else whole
    units = F.regexp_replace(units, "^0+(?=[0-9])", "")
    fits = bare.rlike(pattern) & (F.length(part) <= scale) & (F.length(units) <= 16)
    value = F.when(fits, units.try_cast("long"))
    value = F.when(value <= MOST_MINOR, value)
    return F.when(F.regexp_extract(bare, pattern, 1) == "-", -value).otherwise(value)


def money_format(minor: Column, scale: int = 2, grouping: bool = True, code: str | None = None) -> Column:
    """An amount's text: sign, grouped digits, the currency's decimals, and the code if given."""
    size = 10**scale
    positive = F.abs(minor)
    major = ((positive - positive % size) / size).cast("long").cast("string")
    if grouping:
        major = F.regexp_replace(major, "(?<=[0-9])(?=([0-9]{3})+$)", ",")
    parts = [F.when(minor < 0, "-").otherwise(""), major]
    if scale:
        parts += [F.lit("."), F.lpad((positive % size).cast("string"), scale, "0")]
    if code:
        parts.append(F.lit(f" {code}"))
    return F.concat(*parts)


def _digits(value: Column, n: int) -> Column:
    letters = [F.substring(F.lit(ALPHABET), (F.shiftright(value, 5 * i).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for i in range(n - 1, -1, -1)]
    return F.concat(*letters)


def ulid_encode(ms: Column, random_hex: Column) -> Column:
    """The 26 characters of 48 bits of time and 80 random bits (20 hexadecimal digits)."""
    halves = [F.conv(F.substring(random_hex, at, 10), 16, 10).cast("long") for at in (1, 11)]
    return F.concat(_digits(ms.cast("long"), 10), *(_digits(h, 8) for h in halves))


def ulid_valid(text: Column) -> Column:
    """26 characters of the alphabet in either case, the first at most 7."""
    return text.rlike("^[0-7][0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{25}$")


def _value(text: Column, first: int, last: int) -> Column:
    value = F.lit(0).cast("long")
    for i in range(first, last + 1):
        value = value * 32 + F.instr(F.lit(ALPHABET), F.upper(F.substring(text, i, 1))).cast("long") - 1
    return value


def ulid_millis(text: Column) -> Column:
    """The time of a ULID; null if it isn't valid."""
    return F.when(ulid_valid(text), _value(text, 1, 10))


def ulid_random(text: Column) -> Column:
    """The 20 hexadecimal digits of a ULID's random part; null if it isn't valid."""
    halves = [F.lpad(F.lower(F.hex(_value(text, a, a + 7))), 10, "0") for a in (11, 19)]
    return F.when(ulid_valid(text), F.concat(*halves))


def version_stamp(updated_at: Column, device_id: Column) -> Column:
    """A record's version: its time (below 1: 0) and the first 80 bits of its device's SHA-256."""
    return ulid_encode(F.greatest(updated_at, F.lit(0)), F.substring(F.sha2(device_id, 256), 1, 20))


def conflict_id(now_ms: int, job: Column, entity: Column, record_id: Column, kind: Column) -> Column:
    seed = F.concat_ws("|", job, entity, record_id, kind.cast("string"))
    return ulid_encode(F.lit(now_ms), F.substring(F.sha2(seed, 256), 1, 20))


def canonical_json(text: Column) -> Column:
    """JSON text with the keys of every object in order."""
    return F.to_json(F.parse_json(text))


def in_range(minor: Column) -> Column:
    """minor, or an error if it lies beyond MOST_MINOR."""
    bad = F.raise_error(F.lit("amount out of range")).cast("long")
    return F.when(F.abs(minor) > MOST_MINOR, bad).otherwise(minor)


def same_money(value: Column, currency: Column, other: Column) -> Column:
    """value, or an error if the currencies differ."""
    return F.when(~currency.eqNullSafe(other), F.raise_error(F.lit("different currencies")).cast("long")).otherwise(value)


def money_add(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    return same_money(in_range(a + b), a_currency, b_currency)


def money_subtract(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    return same_money(in_range(a - b), a_currency, b_currency)


def money_times(a: Column, factor: Column) -> Column:
    """a times a whole number; products beyond 64 bits are out of range too."""
    wide = a.cast("decimal(20,0)") * factor.cast("decimal(18,0)")
    bad = F.raise_error(F.lit("amount out of range")).cast("long")
    return F.when(F.abs(wide) > MOST_MINOR, bad).otherwise(wide.cast("long"))


def money_compare(a: Column, b: Column, a_currency: Column, b_currency: Column) -> Column:
    """-1, 0 or 1."""
    return same_money(F.signum((a - b).cast("double")).cast("long"), a_currency, b_currency)


def money_json(minor: Column, currency: Column) -> Column:
    return F.to_json(F.struct(minor.alias("minorUnits"), currency.alias("currency"), currency_scale(currency).alias("scale")))


def money_from_json(text: Column) -> Column:
    """(minor, currency, scale) of money_json(); null where a field is missing, of another type or out of range."""
    parsed = F.from_json(text, "minorUnits long, currency string, scale int")
    whole = text.rlike('"minorUnits"\\s*:\\s*-?[0-9]+\\s*[,}]') & text.rlike('"currency"\\s*:\\s*"') & text.rlike('"scale"\\s*:\\s*[0-9]+\\s*[,}]')
    good = whole & parsed["minorUnits"].isNotNull() & (F.abs(parsed["minorUnits"]) <= MOST_MINOR) & parsed["scale"].isNotNull()
    return F.when(good, F.struct(parsed["minorUnits"].alias("minor"), parsed["currency"].alias("currency"), parsed["scale"].alias("scale")))

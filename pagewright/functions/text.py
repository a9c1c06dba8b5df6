"""PostgreSQL's text forms as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote_ident(name: Column) -> Column:
    """An identifier in double quotes, inner ones doubled."""
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def money_text(cents: Column) -> Column:
    """money: `-$1,234.56` from hundredths; works for the lowest int8, whose negative doesn't exist."""
    amount = (F.abs(cents.cast("decimal(20,0)")) / F.lit(100)).cast("decimal(22,2)")
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(amount, 2))


def hms_text(micros: Column) -> Column:
    """time of day from microseconds: HH:MM:SS and a fraction without trailing zeros; 24:00:00 is a value."""
    part = lambda div, mod=None: F.lpad((F.floor(micros / div) % mod if mod else F.floor(micros / div)).cast("string"), 2, "0")
    fraction = (micros % 1_000_000).cast("int")
    digits = F.regexp_replace(F.lpad(fraction.cast("string"), 6, "0"), "0+$", "")
    return F.concat(part(3_600_000_000), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), F.when(fraction == 0, "").otherwise(F.concat(F.lit("."), digits)))


def date_text(days: Column) -> Column:
    """date from days since 2000-01-01; the extreme numbers are the infinities, years before 1 are BC."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), days.cast("int"))
    year = F.year(day)
    shown = F.when(year > 0, year).otherwise(1 - year)
    plain = F.concat(F.lpad(shown.cast("string"), 4, "0"), F.date_format(day, "-MM-dd"), F.when(year > 0, "").otherwise(" BC"))
    return F.when(days == 2147483647, "infinity").when(days == -2147483648, "-infinity").otherwise(plain)


def timestamp_value(micros: Column) -> Column:
    """timestamp from microseconds since 2000-01-01; the extreme numbers, infinities, give NULL."""
    safe = F.when((micros > -(2**63)) & (micros < 2**63 - 1), micros)
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (safe + 946_684_800_000_000).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(20,0)"))


def lsn_text(lsn: Column) -> Column:
    """pg_lsn: two hexadecimal halves."""
    return F.concat(F.hex(F.shiftrightunsigned(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(F.lit(0xFFFFFFFF))))


def array_item(value: Column) -> Column:
    """An array element's text: quoted where it must be, NULL unquoted."""
    risky = value.rlike(r'[{},"\\\s]') | (value == "") | (F.upper(value) == "NULL")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(value.isNull(), "NULL").when(risky, quoted).otherwise(value)


def array_literal(items: Column) -> Column:
    """array: `{a,"b c",NULL}` from an array of texts."""
    return F.concat(F.lit("{"), F.array_join(F.transform(items, array_item), ","), F.lit("}"))


def record_field(value: Column) -> Column:
    """A record field's text: nothing for NULL, quoted where it must be."""
    risky = value.rlike(r'[(),"\\\s]') | (value == "")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").when(risky, quoted).otherwise(value)


def record_literal(fields: Sequence[Column]) -> Column:
    """record: `(a,"b c",)`."""
    return F.concat(F.lit("("), F.concat_ws(",", *[record_field(f) for f in fields]), F.lit(")"))


def range_bound(value: Column) -> Column:
    risky = value.rlike(r'[()\[\],"\\\s]') | (value == "")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.isNull(), "").when(risky, quoted).otherwise(value)


def range_literal(lower: Column, upper: Column, lower_inc: Column, upper_inc: Column, empty: Column) -> Column:
    """range: `[lo,hi)`, open ends empty, `empty`."""
    left = F.when(lower_inc & lower.isNotNull(), "[").otherwise("(")
    right = F.when(upper_inc & upper.isNotNull(), "]").otherwise(")")
    return F.when(empty, "empty").otherwise(F.concat(left, range_bound(lower), F.lit(","), range_bound(upper), right))


def bit_text(value: Column, width: int) -> Column:
    """bit(n) of a number: its binary digits, zeros in front."""
    return F.lpad(F.bin(value), width, "0")


def u32(raw: Column, offset: int) -> Column:
    """Little-endian unsigned 32-bit number at a 0-based offset of a binary column; NULL if the bytes aren't there."""
    return _little(raw, offset, 4)


def u16(raw: Column, offset: int) -> Column:
    return _little(raw, offset, 2)


def u8(raw: Column, offset: int) -> Column:
    return _little(raw, offset, 1)


def _little(raw: Column, offset: int, size: int) -> Column:
    parts = [F.hex(F.substring(raw, offset + 1 + i, 1)) for i in reversed(range(size))]
    return F.when(F.length(raw) >= offset + size, F.conv(F.concat(*parts), 16, 10).cast("bigint"))

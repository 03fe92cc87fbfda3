"""Timestamps: strict ISO parsing, canonical text, precision tolerances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How far each precision may lie from the truth, in seconds.
TOLERANCE_SECONDS = {
    "exact": 0,
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": 86400,
    "approximate": 21600,
}
MICROS = 1_000_000

# The plain profile, which a cast reads correctly (Spark stops at +-18:00).
_PLAIN = (
    r"\A(?!0000)\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?"
    r"(Z|[+-](0\d|1[0-7]):[0-5]\d)\z"
)
# Everything else the ISO reader of the Python standard library takes: basic and
# week dates, any separator character, short times, long fractions, offsets with
# seconds, and one stray character (often a blank) before the offset.
_GENERAL = (
    r"(?s)\A(?!0000)(\d{4})(-?)(?:(\d{2})\2(\d{2})|W(\d{2})(?:\2(\d))?)"
    r"."
    r"(\d{2})(?:(:?)(\d{2})(?:\8(\d{2}))?)?"
    r"(?:[.,](\d{6}[^Z+\-]*|\d{1,5})|[\x00-\x7f&&[^Z+\-]])?"
    r"(?:Z|([+-])(\d{2})(?:(:?)(\d{2})(?:\14(\d{2}))?)?(?:[.,](\d+))?)\z"
)


def tolerance_micros(precision: Column) -> Column:
    """Tolerance of a precision name in microseconds; unknown names give null."""
    out: Column | None = None
    for name, seconds in TOLERANCE_SECONDS.items():
        value = F.lit(seconds * MICROS).cast("bigint")
        out = F.when(precision == name, value) if out is None else out.when(precision == name, value)
    return out


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def canonical_timestamp(ts: Column) -> Column:
    """UTC ISO text with ``Z``; a fraction of six digits only if it is not zero."""
    us = micros(ts)
    utc = F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.pmod(us, F.lit(MICROS))
    return F.when(fraction == 0, F.concat(whole, F.lit("Z"))).otherwise(
        F.concat(whole, F.lit("."), F.lpad(fraction.cast("string"), 6, "0"), F.lit("Z"))
    )


def _general_micros(text: Column) -> Column:
    def group(n: int) -> Column:
        return F.regexp_extract(text, _GENERAL, n)

    def number(n: int) -> Column:
        return F.coalesce(F.nullif(group(n), F.lit("")).cast("int"), F.lit(0))

    def fraction(n: int) -> Column:
        return F.rpad(F.substring(group(n), 1, 6), 6, "0").cast("bigint")

    year = number(1)
    week_start = F.date_sub(F.make_date(year, F.lit(1), F.lit(4)), F.weekday(F.make_date(year, F.lit(1), F.lit(4))))
    week, weekday = number(5), F.when(group(6) == "", 1).otherwise(number(6))
    week_day = F.date_add(week_start, (week - 1) * 7 + weekday - 1)
    week_ok = week.between(1, 53) & weekday.between(1, 7) & (F.weekofyear(week_day) == week)
    month, day = number(3), number(4)
    days_in_month = F.dayofmonth(F.last_day(F.make_date(year, F.greatest(F.lit(1), F.least(month, F.lit(12))), F.lit(1))))
    month_ok = month.between(1, 12) & day.between(1, days_in_month)
    date = F.when(group(5) != "", F.when(week_ok, week_day)).when(
        month_ok, F.make_date(year, month, day)
    )
    hour, minute, second = number(7), number(9), number(10)
    clock_ok = (hour <= 23) & (minute <= 59) & (second <= 59)
    clock = ((hour * 3600 + minute * 60 + second).cast("bigint") * MICROS) + fraction(11)
    offset = (number(13) * 3600 + number(15) * 60 + number(16)).cast("bigint") * MICROS + fraction(17)
    offset_ok = offset < F.lit(86_400 * MICROS)
    signed = F.when(group(12) == "-", -offset).otherwise(offset)
    total = F.unix_date(date).cast("bigint") * F.lit(86_400 * MICROS) + clock - signed
    return F.when(text.rlike(_GENERAL) & clock_ok & offset_ok, total)


def parse_iso(text: Column) -> Column:
    """An ISO 8601 text with an offset as a timestamp.

    Text that is not valid, or names no offset, gives null: a clock time of
    unknown zone is never guessed.
    """
    plain = F.when(text.rlike(_PLAIN), F.try_to_timestamp(text))
    general = F.timestamp_micros(_general_micros(text))
    return F.when(text.rlike(_PLAIN), plain).otherwise(general)


def disagrees(value_a: Column, precision_a: Column, value_b: Column, precision_b: Column) -> Column:
    """True when two claims about one event cannot both hold."""
    return F.abs(micros(value_a) - micros(value_b)) > (
        tolerance_micros(precision_a) + tolerance_micros(precision_b)
    )

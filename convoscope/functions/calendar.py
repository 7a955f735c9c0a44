"""Wall-clock helpers that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000
DAY_MICROS = 86_400 * MICROS

#: Weekday names, Sunday first.
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 00:00 of a wall-clock timestamp, as BIGINT."""
    second = F.date_part(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(DAY_MICROS)
        + F.hour(ts).cast("bigint") * F.lit(3600 * MICROS)
        + F.minute(ts).cast("bigint") * F.lit(60 * MICROS)
        + (second * F.lit(MICROS)).cast("bigint")
    )


def micros_to_ts(us: Column) -> Column:
    """The inverse of :func:`wall_micros`, as TIMESTAMP_NTZ."""
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(20,0)") / F.lit(MICROS)).cast("decimal(18,6)")
    )


def hour_of_day(us: Column) -> Column:
    return (F.pmod(us, F.lit(DAY_MICROS)) / F.lit(3600 * MICROS)).cast("int")


def day_number(us: Column) -> Column:
    """Whole days since 1970-01-01."""
    return ((us - F.pmod(us, F.lit(DAY_MICROS))) / F.lit(DAY_MICROS)).cast("int")


def weekday_number(us: Column) -> Column:
    """0 for Sunday to 6 for Saturday (1970-01-01 was a Thursday)."""
    return F.pmod(day_number(us) + F.lit(4), F.lit(7))


def weekday_name(us: Column) -> Column:
    return F.element_at(F.array(*[F.lit(day) for day in WEEKDAYS]), weekday_number(us) + F.lit(1))


def period_key(us: Column, monthly: Column) -> Column:
    """``2026-05`` or ``2026-W21``; week 0 is what precedes the year's first Monday."""
    date = F.date_from_unix_date(day_number(us))
    week = F.floor((F.dayofyear(date) + F.lit(6) - F.weekday(date)) / F.lit(7)).cast("int")
    year = F.date_format(date, "yyyy")
    return F.when(monthly, F.date_format(date, "yyyy-MM")).otherwise(
        F.concat(year, F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    )

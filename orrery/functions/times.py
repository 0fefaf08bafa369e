"""Times as columns.  Timestamps have no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts.cast("timestamp_ntz"))


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, exact to the microsecond."""
    return F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz")) / F.lit(1e6)


def days_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a.cast("timestamp_ntz"), b.cast("timestamp_ntz")) / F.lit(86_400e6)


def parse_time(text: Column) -> Column:
    """ISO time with T or a space, with or without a fraction; null for anything else."""
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
    return F.when(text.rlike(form), text.try_cast("timestamp_ntz"))


def julian(ts: Column) -> tuple[Column, Column]:
    """Julian date as midnight and fraction of the day, so that no digit of the time is lost."""
    us = micros(ts)
    day = F.floor(us / F.lit(DAY_US))
    return day + F.lit(2440587.5), (us - day * F.lit(DAY_US)) / F.lit(float(DAY_US))


def gmst(jd: Column, fr: Column) -> Column:
    """Greenwich mean sidereal time, radians (IAU 1982)."""
    t = (jd + fr - F.lit(2451545.0)) / F.lit(36525.0)
    seconds = F.lit(67310.54841) + F.lit(876600.0 * 3600.0 + 8640184.812866) * t + F.lit(0.093104) * t * t - F.lit(6.2e-6) * t * t * t
    return F.radians(F.pmod(seconds / F.lit(240.0), F.lit(360.0)))


def two_digit_year(yy: Column) -> Column:
    """57 to 99 are of the twentieth century."""
    return F.when(yy < 57, yy + 2000).otherwise(yy + 1900)


def tle_epoch(line1: Column) -> Column:
    """Epoch of a first line: YYDDD.DDDDDDDD in columns 19 to 32; null if it is none."""
    field = F.trim(F.substring(line1, 19, 14))
    year = two_digit_year(F.substring(field, 1, 2).try_cast("int"))
    day = F.substring(field, 3, 12).try_cast("double")
    us = F.round((day - 1) * F.lit(float(DAY_US))).cast("long")
    return F.timestamp_add("MICROSECOND", us, F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def until_end_of(day: str, text: Column) -> Column:
    """The text comparison `text <= day || 'T23:59:59'`, which leaves out fractions of the day's last second."""
    return text <= F.lit(f"{day}T23:59:59")


def age_hours(epoch: Column, at: Column) -> Column:
    return seconds_between(epoch, at) / F.lit(3600.0)


def half_hours(hours: Column) -> Column:
    """To the nearest half hour, ties to even."""
    return F.rint(hours * 2) / 2


def shift_days(day: Column, n: int) -> Column:
    return F.date_add(day, n)

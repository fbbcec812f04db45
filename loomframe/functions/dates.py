"""Date functions over RFC 3339 strings, whose offsets stay as written."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"
OFFSET = r"(Z|[+-]\d\d:\d\d)$"


def offset(s: Column) -> Column:
    """The zone as written at the end: Z, +hh:mm, -hh:mm or nothing."""
    end = F.right(s, F.lit(6))
    return F.when(F.endswith(s, F.lit("Z")), F.lit("Z")).when(end.like("+__:__") | end.like("-__:__"), end).otherwise(F.lit(""))


def local(s: Column) -> Column:
    """The date and time as written; the cast leaves the zone out."""
    return s.cast("timestamp_ntz")


def instant(s: Column) -> Column:
    return s.cast("timestamp")


def truncated(s: Column, unit: str) -> Column:
    at = F.date_trunc("day", F.date_sub(local(s).cast("date"), F.dayofweek(local(s)) - 1)) if unit == "week" else F.date_trunc(unit, local(s))
    return F.concat(F.date_format(at, ISO), offset(s))


def at_beginning_of_day(s: Column) -> Column:
    return truncated(s, "day")


def at_beginning_of_hour(s: Column) -> Column:
    return truncated(s, "hour")


def at_beginning_of_month(s: Column) -> Column:
    return truncated(s, "month")


def at_beginning_of_week(s: Column) -> Column:
    """Weeks start on Sunday."""
    return truncated(s, "week")


def at_beginning_of_year(s: Column) -> Column:
    return truncated(s, "year")


def day_of_week(s: Column) -> Column:
    """Monday is 1."""
    return F.weekday(local(s)) + 1


def day_of_year(s: Column) -> Column:
    return F.dayofyear(local(s))


def days_between(a: Column, b: Column) -> Column:
    """Days from `b` to `a`, rounded, halves away from zero."""
    return F.round((F.unix_micros(instant(a)) - F.unix_micros(instant(b))) / F.lit(86_400_000_000.0)).cast("long")


def is_leap_year(when: Column) -> Column:
    """Of a year, or of a date string."""
    text = when.cast("string")
    year = F.coalesce(text.try_cast("double").cast("int"), F.year(local(text)))
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def day(y: Column, m: Column, d: Column) -> Column:
    """Months and days beyond their range run on into the next."""
    return F.date_add(F.add_months(F.make_date(y, F.lit(1), F.lit(1)), m - 1), d - 1)


def date(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(day(y, m, d), "yyyy-MM-dd")


def moment(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return day(y, m, d).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, mi, s.cast("decimal(18,6)"))


def local_date_time(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    return F.date_format(moment(y, m, d, h, mi, s), ISO)


def date_time(y: Column, m: Column, d: Column, h: Column, mi: Column, s: Column, zone: str = "Z") -> Column:
    """`zone` is an offset, Z, or the name of a region, whose offset at that time is written."""
    at = moment(y, m, d, h, mi, s)
    return F.concat(F.date_format(at, ISO), offset_of(at, zone))


def offset_of(at: Column, zone: str) -> Column:
    """The offset text of a zone at a local time."""
    if re.fullmatch(OFFSET[:-1], zone):
        return F.lit(zone)
    wall = at.cast("timestamp")
    minutes = ((F.unix_micros(wall) - F.unix_micros(F.to_utc_timestamp(wall, zone))) / 60_000_000).cast("int")
    size = F.abs(minutes)
    text = F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), (size / 60).cast("int"), size % 60)
    return F.when(minutes == 0, F.lit("Z")).otherwise(text)


def local_time(h: Column, mi: Column, s: Column) -> Column:
    return F.date_format(moment(F.lit(2000), F.lit(1), F.lit(1), h, mi, s), "HH:mm:ss")


def time(h: Column, mi: Column, s: Column, zone: str = "Z") -> Column:
    """`zone` is an offset or Z; a region has none without a date."""
    if not re.fullmatch(OFFSET[:-1], zone):
        raise ValueError(f"time: {zone} is no offset")
    return F.concat(local_time(h, mi, s), F.lit(zone))


def now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def tomorrow() -> Column:
    return F.date_format(F.date_add(F.current_date(), 1), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")

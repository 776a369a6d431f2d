"""The historic calendar: years before 0, minutes since the start of year 0, its own leap rule.

All of it is closed arithmetic on Columns, so dates convert inside codegen
without a lookup table or a loop over years.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The leap years of the early Julian calendar, and the month lengths.
TRIENNIAL = (-45, -42, -39, -36, -33, -30, -27, -24, -21, -18, -15, -12, -9)
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
DAY = 1440

_EXTRA = [y for y in TRIENNIAL if y % 4]  # those that the usual rule does not have already


def _div(a: Column, n: int) -> Column:
    return F.floor(a / n).cast("bigint")


def is_leap(year: Column) -> Column:
    return year.isin(*TRIENNIAL) | ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def year_start(year: Column) -> Column:
    """Days from the start of year 0 to that of `year`, negative before it."""
    y = year.cast("bigint")
    last = y - 1
    after = _div(last, 4) - _div(last, 100) + _div(last, 400) + 1
    before = _div(-y, 4) - _div(-y, 100) + _div(-y, 400) + F.size(F.filter(F.array(*map(F.lit, _EXTRA)), lambda e: e >= y))
    return y * 365 + F.when(y > 0, after).otherwise(-before)


def month_start(year: Column, month: Column) -> Column:
    """Days of the year before the month."""
    total, column = 0, F.lit(0)
    starts = []
    for d in MONTH_DAYS:
        starts.append(total)
        total += d
    column = F.get(F.array(*map(F.lit, starts)), month.cast("int") - 1)
    return column + F.when(is_leap(year) & (month > 2), 1).otherwise(0)


def timestamp(year: Column, month: Column, day: Column, hour: Column = None, minute: Column = None) -> Column:
    """Minutes since the start of year 0; months, hours and minutes may overflow."""
    hour, minute = F.lit(0) if hour is None else hour, F.lit(0) if minute is None else minute
    months = year.cast("bigint") * 12 + month - 1
    y, m = _div(months, 12), F.pmod(months, F.lit(12)) + 1
    return (year_start(y) + month_start(y, m) + day.cast("bigint") - 1) * DAY + hour.cast("bigint") * 60 + minute.cast("bigint")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_date(ts: Column) -> Column:
    """struct(year, month, day, hour, minute) of minutes since year 0."""

    def in_year(days: Column, year: Column, rest: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: month_start(year, m))
        with_month = lambda day: let(starts, lambda s: let(F.size(F.filter(s, lambda m: m <= day)), lambda month: _date(year, month, day - F.get(s, month - 1) + 1, rest)))
        return let(days - year_start(year), with_month)

    def with_year(days: Column, rest: Column) -> Column:
        guess = F.floor(days / 365.2425).cast("bigint")
        near = F.filter(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda i: guess + i), lambda y: year_start(y) <= days)
        return let(F.array_max(near), lambda year: in_year(days, year, rest))

    return let(ts.cast("bigint"), lambda v: with_year(_div(v, DAY), F.pmod(v, F.lit(DAY))))


def _date(year: Column, month: Column, day: Column, rest: Column) -> Column:
    parts = {"year": year, "month": month, "day": day, "hour": _div(rest, 60), "minute": rest % 60}
    return F.struct(*[v.cast("int").alias(k) for k, v in parts.items()])


def days_in_months(year: Column, month: Column) -> Column:
    """Days elapsed before the month."""
    return month_start(year, month)


def leap_years_before(year: Column) -> Column:
    return year / 4 - year / 100 + year / 400 - 1


def leap_years_between(start: Column, end: Column) -> Column:
    return leap_years_before(end) - leap_years_before(start + 1)


def month_of(name: Column) -> Column:
    """1 … 12 of a month's name or its beginning; 1 for others."""
    out = F.when(F.lit(False), 0)
    for i, m in enumerate(MONTH_NAMES):
        out = out.when((F.length(name) > 0) & F.lit(m.lower()).startswith(F.lower(name)), i + 1)
    return out.otherwise(1)


def parse(text: Column, delimiter: str = ".") -> Column:
    """"Y.M.D.h.m" as a date struct; null if any part is no number."""
    names = ("year", "month", "day", "hour", "minute")
    parts = F.split(text, "\\" + delimiter)
    values = [F.coalesce(F.get(parts, F.lit(i)).try_cast("int"), F.when(F.size(parts) <= i, F.lit(int(0 < i < 3)))) for i in range(5)]
    whole = F.forall(parts, lambda p: p.try_cast("int").isNotNull())
    return F.when(whole, F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)]))


def strip_key(key: Column) -> Column:
    """The number in a stored key: t_ or tz_ prefix off, letters a-j back to digits."""
    return F.translate(F.regexp_replace(key, "^tz?_", ""), "abcdefghij", "0123456789").try_cast("bigint")


def describe(date: Column) -> Column:
    """"1st January 1900AD - 00:00"."""
    from .maths import ordinal

    era = F.concat(F.abs(date["year"]).cast("string"), F.when(date["year"] < 0, "BC").otherwise("AD"))
    clock = F.concat(F.lpad(date["hour"].cast("string"), 2, "0"), F.lit(":"), F.lpad(date["minute"].cast("string"), 2, "0"))
    return F.concat(ordinal(date["day"]), F.lit(" "), F.get(F.array(*map(F.lit, MONTH_NAMES)), date["month"] - 1), F.lit(" "), era, F.lit(" - "), clock)


def parse_years(years: Column) -> Column:
    """A fractional year as (year, month, day) in a 365-day year."""
    whole = F.floor(years)
    day = F.floor((years - whole) * 365).cast("int")
    month = F.size(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda m: month_start(F.lit(1), m) <= day))
    return F.struct(whole.cast("int").alias("year"), month.cast("int").alias("month"), (day - month_start(F.lit(1), month) + 1).alias("day"))


def ago(seconds: Column, now: Column, unit: str = "days") -> Column:
    """Whole units between an epoch-seconds value and `now` (a timestamp)."""
    per = {"milliseconds": 1, "seconds": 1000, "minutes": 60_000, "hours": 3_600_000, "days": 86_400_000}[unit]
    return F.floor((F.unix_millis(now) - seconds * 1000) / per)


def as_span(a: Column, b: Column | None = None) -> Column:
    b = a if b is None else b
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))

"""Date columns.  Today is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def london_date(instant: Column) -> Column:
    """The day in London of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(instant.cast("timestamp"), "Europe/London"))


def _by_name(c: Column) -> Column:
    """A day from texts with the month's name before or after it, with a time in UTC where there is one."""
    names = "janfebmaraprmayjunjulaugsepoctnovdec"
    month = r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b"
    plain = F.regexp_replace(c, r"(?i)\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1")
    time = F.regexp_extract(plain, r"\b([0-9]{2}:[0-9]{2}:[0-9]{2})\b", 1)
    bare = F.regexp_replace(plain, r"[0-9]{2}:[0-9]{2}:[0-9]{2}", " ")
    number = F.floor((F.position(F.lower(F.regexp_extract(bare, month, 1)), F.lit(names)) + 2) / 3)
    day, year = F.regexp_extract(bare, r"(?<![0-9])([0-9]{1,2})(?![0-9])", 1), F.regexp_extract(bare, r"(?<![0-9])([0-9]{4})(?![0-9])", 1)
    written = F.concat_ws("-", year, number.cast("string"), day)
    instant = F.try_to_timestamp(F.concat_ws(" ", written, F.when(time == "", "00:00:00").otherwise(time)), F.lit("yyyy-M-d HH:mm:ss"))
    return F.when(bare.rlike(month) & (day != "") & (year != ""), F.when(time == "", F.to_date(instant)).otherwise(london_date(instant)))


def ago_to_date(c: Column, today: Column) -> Column:
    """A day from "3 days ago" and the like; hours are the same day, a month has 30 days."""
    n = F.regexp_extract(c, r"(?i)([0-9]+)\+?\s*(?:hour|day|week|month)s?\s*ago", 1)
    unit = F.lower(F.regexp_extract(c, r"(?i)[0-9]+\+?\s*(hour|day|week|month)s?\s*ago", 1))
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30).otherwise(0)
    return F.when(n != "", F.date_sub(today, n.try_cast("int") * days))


def _numbered(c: Column, order: str) -> Column:
    return F.when(c.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), F.to_date(F.try_to_timestamp(c, F.lit(order))))


def parse_date(c: Column, today: Column) -> Column:
    """A day from ISO dates and instants, words relative to ``today``, M/D/Y, or a month's name; null if it is none.

    An instant gives the day in London.
    """
    c = F.trim(c)
    iso, first = c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))
    relative = F.when(c.rlike("(?i)today|just posted"), today).when(c.rlike("(?i)yesterday"), F.date_sub(today, 1)).when(~c.rlike("(?i)hour"), ago_to_date(c, today))
    return F.when(iso & (F.length(c) == 10), first).when(iso, F.coalesce(london_date(F.try_to_timestamp(c)), first)).otherwise(F.coalesce(relative, _numbered(c, "M/d/yyyy"), _by_name(c)))


def parse_day_first(c: Column, today: Column) -> Column:
    """The same for feeds that write D/M/Y."""
    return F.coalesce(_numbered(F.trim(c), "d/M/yyyy"), F.when(~F.trim(c).rlike("^[0-9]+/[0-9]+/[0-9]+$"), parse_date(c, today)))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def plausible_deadline(c: Column, today: Column) -> Column:
    """A deadline of at most two years ahead, or null."""
    return F.when(F.datediff(c, today) <= 730, c)


def months_ahead(month: Column, now: Column) -> Column:
    return F.pmod(month - now, F.lit(12))


def period_end(day: Column, precision: Column) -> Column:
    """The last day of what a start date stands for: its day, month or year."""
    return F.when(precision == "year", F.last_day(F.date_add(F.trunc(day, "year"), 340))).when(precision == "month", F.last_day(day)).otherwise(day)

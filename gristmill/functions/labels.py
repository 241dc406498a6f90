"""Texts for display: pay, dates, deadlines, levels, places, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gristmill.functions.numbers import round_half_up

#: A pay text longer than this is not shown.
PAY_CHARS = 40
# Words of training providers' names that stay in capitals.
ACRONYMS = ("qa", "bpp", "cms", "it", "uk", "nhs")


def _pounds(c: Column) -> Column:
    return F.concat(F.lit("£"), F.format_number(c, 0))


def salary_label(least: Column, most: Column, text: Column) -> Column:
    """A range, one amount, a short text, or null; 0 counts as unknown."""
    least, most = F.nullif(least, F.lit(0)), F.nullif(most, F.lit(0))
    return F.coalesce(F.concat(_pounds(least), F.lit("–"), _pounds(most)), _pounds(least), F.when((F.length(text) <= PAY_CHARS) & (text != ""), text))


def date_label(day: Column, today: Column) -> Column:
    """Day and month, with the year if it isn't this one; a dash for null."""
    return F.coalesce(F.when(F.year(day) == F.year(today), F.date_format(day, "d MMM")).otherwise(F.date_format(day, "d MMM yyyy")), F.lit("—"))


def start_label(day: Column, precision: Column) -> Column:
    return F.when(precision == "year", F.date_format(day, "yyyy")).when(precision == "month", F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))


def closing_label(days: Column) -> Column:
    """What is said of a deadline so many days ahead; null beyond thirty."""
    return F.when(days < 0, "Closed").when(days == 0, "Closes today").when(days == 1, "Closes tomorrow").when(days <= 30, F.concat(F.lit("Closes in "), days.cast("string"), F.lit(" days")))


def level_label(level: Column, is_degree: Column) -> Column:
    degree = F.coalesce(is_degree, F.lit(False))
    return F.when(level.isNull(), F.when(degree, "Degree").otherwise("Level ?")).otherwise(F.concat(F.lit("L"), level.cast("string"), F.when(degree, " · Degree").otherwise("")))


def place_label(cities: Column, city: Column, nation: Column, is_national: Column) -> Column:
    """Nationwide, the first of several towns and how many more, the town, the nation, or that nothing is known."""
    known = F.array_distinct(F.filter(F.coalesce(cities, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != "")))
    several = F.when(F.size(known) > 1, F.concat(F.get(known, F.lit(0)), F.lit(" +"), (F.size(known) - 1).cast("string")))
    return F.when(F.coalesce(is_national, F.lit(False)), "Nationwide").otherwise(F.coalesce(several, city, F.when(nation != "Unknown", nation), F.lit("Location unknown")))


def miles_label(miles: Column) -> Column:
    return F.when(miles < 1, "<1 mi").otherwise(F.concat(round_half_up(miles).cast("string"), F.lit(" mi")))


def ago_label(day: Column, today: Column) -> Column:
    days = F.datediff(today, day)
    return F.when(day.isNull(), "never").when(days <= 0, "today").when(days == 1, "yesterday").when(days < 14, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(date_label(day, today))


def provider_label(name: Column) -> Column:
    """A training provider's name without company words, its acronyms in capitals."""
    bare = F.regexp_replace(F.regexp_replace(name, r"(?i)\s*\(uk\)\s*", " "), r"(?i)\s+(?:limited|ltd\.?|plc|llp)$", "")
    return F.trim(F.array_join(F.transform(F.split(bare, " "), lambda w: F.when(F.lower(w).isin(*ACRONYMS), F.upper(w)).otherwise(w)), " "))

"""Dates as ISO text (§2.8); what is no date is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1990, 2012


def iso(year: Column, month: Column, day: Column, first: int = FIRST_YEAR, last: int = LAST_YEAR) -> Column:
    """Two-digit years below 50 are of 2000; outside [first, last] null."""
    y = F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int"))
    made = F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(F.year(made).between(first, last), F.date_format(made, "yyyy-MM-dd"))


def us_date(c: Column) -> Column:
    """m/d/y with two or four digits of year."""
    part = lambda i: F.nullif(F.regexp_extract(c, r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s*$", i), F.lit("")).cast("int")
    return iso(part(3), part(1), part(2))


def month_of(day: Column) -> Column:
    return F.substring(day, 1, 7)


def month_index(index: Column, first_year: int) -> Column:
    """Months since January of a year, as YYYY-MM."""
    return F.format_string("%04d-%02d", (F.floor(index / 12) + first_year).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"))


def is_date(c: Column) -> Column:
    return F.try_to_timestamp(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c), F.lit("yyyy-MM-dd")).isNotNull()

"""Dates of mixed grain.  Whatever depends on today takes `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, filled


def month_name_date(c: Column, as_of: Column) -> Column:
    """ "July 2026" as the first of that month; anything else as `as_of`."""
    return F.coalesce(F.try_to_date(F.trim(filled(c)), "MMMM yyyy"), as_of)


def parts_to_iso(parts: Column) -> Column:
    """[year, month, day] as text, missing month and day as 1; empty without a year."""
    def part(i: int) -> Column:
        return F.coalesce(F.get(parts, F.lit(i)), F.lit(1))
    return F.when(F.coalesce(F.get(parts, F.lit(0)), F.lit(0)) > 0, F.format_string("%04d-%02d-%02d", part(0), part(1), part(2))).otherwise("")


def parts_year(parts: Column) -> Column:
    return F.coalesce(F.get(parts, F.lit(0)), F.lit(0))


def month_bounds(month: Column) -> Column:
    """struct(first, last) of a month given as yyyy-MM."""
    first = F.try_to_date(F.concat(month, F.lit("-01")))
    return F.struct(first.alias("first"), F.last_day(first).alias("last"))


def previous_month(month: Column) -> Column:
    return F.date_format(F.add_months(F.try_to_date(F.concat(month, F.lit("-01"))), -1), "yyyy-MM")


def month_of(date: Column, seen: Column) -> Column:
    return F.substring(F.coalesce(F.when(~blank(date), date), seen), 1, 7)


def months_between(first: Column, last: Column) -> Column:
    """All months from first to last, both yyyy-MM, as an array."""
    day = lambda m: F.to_date(F.concat(m, F.lit("-01")))
    return F.transform(F.sequence(day(first), day(last), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))


def age_years(pub_year: Column, date: Column, as_of: Column) -> Column:
    """Whole calendar years since publication, 0 for the future, null if unknown."""
    from_date = F.expr("null") if date is None else F.when(filled(date).rlike("^[0-9]{4}"), F.substring(date, 1, 4).try_cast("int"))
    year = F.coalesce(F.when(pub_year > 0, pub_year), from_date)
    return F.when(year.isNotNull(), F.greatest(F.lit(0), F.year(as_of) - year))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))

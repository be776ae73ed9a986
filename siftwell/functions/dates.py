"""Dates kept as integers of the form YYYYMMDD, and expressions on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How month names begin.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def date_int(c: Column) -> Column:
    """A date, or a string of the form YYYY-MM-DD, as YYYYMMDD."""
    return F.replace(F.substring(c.cast("string"), 1, 10), F.lit("-"), F.lit("")).cast("int")


def int_date(c: Column) -> Column:
    return F.to_date(c.cast("string"), "yyyyMMdd")


def repaired(c: Column) -> Column:
    """Unknown months and days, written 00, become 01."""
    return F.regexp_replace(c, "-00", "-01")


def years_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / F.lit(365.25)


def month_number(c: Column) -> Column:
    """The first month, in calendar order, whose name a text holds; January if none."""
    out = F.lit(1)
    for i in range(len(MONTHS), 0, -1):
        out = F.when(F.contains(F.lower(c), F.lit(MONTHS[i - 1])), F.lit(i)).otherwise(out)
    return F.when(c.isNull(), F.lit(1)).otherwise(out)


def or_today(c: Column) -> Column:
    """A date given as date, timestamp or text; today where it is null. Text that is no date is an error."""
    return F.coalesce(F.to_date(F.substring(c.cast("string"), 1, 10)), F.current_date())

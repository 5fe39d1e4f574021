"""The 48-week calendar: four weeks a month, the last of 7 to 10 days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS = 48
SEASON_WEEKS = (1, 13, 26, 39)
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def week_of(day: Column, month: Column) -> Column:
    """Week 1 to 48 of a day of a month; null where either is null or out of range."""
    quarter = F.least(F.ceil(day / F.lit(7)), F.lit(4))
    ok = day.between(1, 31) & month.between(1, 12)
    return F.when(ok, (month - 1) * 4 + quarter).cast("int")


def week_of_date(date: Column) -> Column:
    return week_of(F.dayofmonth(date), F.month(date))


def week_text(week: Column) -> Column:
    """For example ``Week 6 (mid Feb)``."""
    part = F.element_at(F.array(*map(F.lit, ("early", "mid", "late", "late"))), F.pmod(week - 1, F.lit(4)).cast("int") + 1)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.floor((week - 1) / 4).cast("int") + 1)
    return F.concat(F.lit("Week "), week.cast("string"), F.lit(" ("), part, F.lit(" "), month, F.lit(")"))

"""Calendar arithmetic on dates and on month numbers (year * 12 + month)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_number(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def month_start(m: Column) -> Column:
    return F.make_date(F.floor((m - 1) / 12).cast("int"), ((m - 1) % 12 + 1).cast("int"), F.lit(1))


def months_between(a: Column, b: Column) -> Column:
    """Month ends crossed from a to b, whatever the days."""
    return month_number(b) - month_number(a)


def iso_date(raw: Column, day_first: bool = True) -> Column:
    """A date from text: ISO as it stands, else day first (or month first), else null."""
    s = F.trim(raw)
    pattern = "d/M/yyyy" if day_first else "M/d/yyyy"
    other = F.replace(F.replace(s, F.lit("-"), F.lit("/")), F.lit("."), F.lit("/"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(s, 1, 10).try_cast("date")).otherwise(F.try_to_date(other, pattern))


def months_back(d: Column, n: int) -> Column:
    return F.add_months(d, -n)

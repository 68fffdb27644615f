"""Arithmetic with stated rules for nulls, zeros and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(c: Column, scale: int = 2) -> Column:
    """A sum of doubles that does not depend on the order of rows."""
    return F.sum(c.cast(f"decimal(18,{scale})")).cast("double")


def exact_avg(c: Column, scale: int = 2) -> Column:
    return F.try_divide(F.sum(c.cast(f"decimal(18,{scale})")).cast("double"), F.count(c).cast("double"))


def ratio(part: Column, whole: Column, digits: int | None = 2) -> Column:
    """part / whole, 0 where there is no whole, rounded half up."""
    r = F.when(whole > 0, part.cast("double") / whole).otherwise(0.0)
    return F.round(r, digits) if digits is not None else r


def clipped_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.greatest(whole, F.lit(1)), F.lit(0.0))


def age_years(at: Column, start: Column) -> Column:
    return F.round(F.datediff(at, start) / 365.25, 1)


def no_sentinel(value: Column, name: str) -> Column:
    """Null for values beyond what months (1200) or days (36525) in a column of that name can be."""
    most = 1200 if "months" in name else 36525 if "days" in name else None
    return value if most is None else F.when(F.abs(value) <= most, value)


def odds(p: Column) -> Column:
    return p / (1 - p)


def recalibrated(p: Column, keep_rate: Column) -> Column:
    """The probability on unsampled data, where negatives were kept at keep_rate."""
    return p * keep_rate / (1 - p + p * keep_rate)


def bucket_share(*parts: Column) -> Column:
    """A number from 0 up to 1 that is fixed by the parts: the first 8 hex digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)

"""Faceted filtering with three-valued logic, counted in one pass.

A filter turns a request value into a condition. Counting every facet while its own filter is left out would be a scan
for each facet; here each row carries how many filters it fails, and an option of facet k counts rows that fail none, or
only k. A condition that is null fails, as in WHERE.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_STATED = "__notstated__"
YES, NO = ("yes", "true", "1"), ("no", "false", "0")


class FilterError(ValueError):
    """A request that names no known filter, or a value it does not have. Raised before any plan is built."""


@dataclass(frozen=True)
class Filter:
    key: str
    kind: str  # in, bool, tri, choice, range
    column: Column
    options: dict[str, Column] | None = None
    nullable: bool = True  # of a choice: whether "not stated" is an option

    def condition(self, value) -> Column:
        return getattr(self, f"_{self.kind}")(value)

    def _in(self, value) -> Column:
        values = [value] if isinstance(value, str) else list(value)
        if not values:
            raise FilterError(f"{self.key}: no value")
        stated = [v for v in values if v != NOT_STATED]
        parts = [self.column.isin(*stated)] * bool(stated) + [self.column.isNull()] * (NOT_STATED in values)
        return reduce(or_, parts)

    def _bool(self, value) -> Column:
        said = value.lower() if isinstance(value, str) else ""
        if said not in (*YES, *NO):
            raise FilterError(f"{self.key}: yes or no")
        return self.column if said in YES else ~self.column

    def _tri(self, value) -> Column:
        states = {"yes": self.column.eqNullSafe(True), "no": self.column.eqNullSafe(False), NOT_STATED: self.column.isNull(), "notstated": self.column.isNull()}
        values = [value] if isinstance(value, str) else list(value)
        if not values or any(v not in states for v in values):
            raise FilterError(f"{self.key}: yes, no or {NOT_STATED}")
        return reduce(or_, [states[v] for v in values])

    def _choice(self, value) -> Column:
        values = [value] if isinstance(value, str) else list(value)
        known = (self.options or {}) | ({NOT_STATED: self.column.isNull()} if self.nullable else {})
        if not values or any(v not in known for v in values):
            raise FilterError(f"{self.key}: one of {', '.join(known)}")
        return reduce(or_, [known[v] for v in values])

    def _range(self, value) -> Column:
        low, high = value
        for x in (low, high):
            if x is not None and (isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x)):
                raise FilterError(f"{self.key}: finite numbers or None")
        if low is None and high is None:
            raise FilterError(f"{self.key}: no bound")
        out = F.lit(True)
        if low is not None:
            out = out & (self.column >= low)
        return out & (self.column <= high) if high is not None else out


def conditions(filters: list[Filter], request: dict) -> dict[str, Column]:
    by = {f.key: f for f in filters}
    if unknown := set(request) - set(by):
        raise FilterError(f"no such filter: {', '.join(sorted(unknown))}")
    return {k: by[k].condition(v) for k, v in request.items()}


def where(filters: list[Filter], request: dict, skip: str | None = None, base: Column | None = None) -> Column:
    """All conditions but that of `skip`, and `base`."""
    parts = [c for k, c in conditions(filters, request).items() if k != skip] + [base] * (base is not None)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def facet_counts(df: DataFrame, filters: list[Filter], request: dict, facets: dict[str, Column], base: Column | None = None) -> DataFrame:
    """facet, option (null: not stated), n for every option of every facet, in one scan and one shuffle of counts. An
    option whose count is 0 under the other filters is left out."""
    found = conditions(filters, request)
    d = df.filter(base) if base is not None else df
    fails = {k: F.when(F.coalesce(c, F.lit(False)), 0).otherwise(1) for k, c in found.items()}
    d = d.select(*[v.alias(f"f_{k}") for k, v in fails.items()], *[v.cast("string").alias(f"o_{k}") for k, v in facets.items()])
    total = reduce(lambda a, b: a + b, [F.col(f"f_{k}") for k in fails]) if fails else F.lit(0)
    own = lambda k: F.col(f"f_{k}") if k in fails else F.lit(0)
    entries = F.array(*[F.when(total - own(k) == 0, F.struct(F.lit(k).alias("facet"), F.col(f"o_{k}").alias("option"))) for k in facets])
    return d.select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e")).groupBy("e.facet", "e.option").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: str, descending: bool, key: str, allowed: list[str], limit: int = 100, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of a total order: the column, nulls last, then the key. limit is held within 0 and `most`."""
    if order not in allowed:
        raise FilterError(f"order by one of {', '.join(allowed)}")
    c = F.col(order)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(key).asc()).offset(max(0, offset)).limit(min(max(0, limit), most))


def search(df: DataFrame, text: str, number: str, name: str, limit: int = 20) -> DataFrame:
    """By number where the text looks like one (letters and digits, a digit among them, 8 at most), else by name: any
    place, any case; the shortest names first."""
    q = text.strip().upper()
    if q.isalnum() and len(q) <= 8 and any(ch.isdigit() for ch in q):
        return df.filter(F.upper(F.col(number).cast("string")) == q).limit(limit)
    return df.filter(F.contains(F.upper(name), F.lit(q))).orderBy(F.length(name), name, number).limit(limit)


def top(df: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n rows of highest score with their rank; ties by key. The limit comes before the numbering, so no task sorts
    the whole table."""
    from pyspark.sql import Window

    best = df.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc()).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), F.col(key).asc())).cast("long"))

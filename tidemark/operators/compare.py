"""Tables compared with each other and with what they should hold."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GuardError(ValueError):
    """A table breaks a rule that a later stage counts on."""


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of only one table, counted as a multiset; `side` says which."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def changed_rows(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, change (only_a, only_b, differs) of keys whose rows are not equal; null equals null."""
    rest = [c for c in a.columns if c not in key]
    x = a.select(*key, F.struct(*rest).alias("_a"))
    y = b.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct(*rest).alias("_b"))
    on = [x[k].eqNullSafe(y[f"_{k}"]) for k in key]
    j = x.join(y, on, "full")
    change = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(~F.col("_a").eqNullSafe(F.col("_b")), "differs")
    return j.select(*[F.coalesce(k, f"_{k}").alias(k) for k in key], change.alias("change")).filter("change IS NOT NULL")


def require_unique(df: DataFrame, key: list[str]) -> DataFrame:
    if df.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise GuardError(f"{', '.join(key)} is not unique")
    return df


def require_known(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    odd = [r[0] for r in df.select(column).filter(~F.col(column).isin(*known)).distinct().limit(5).collect()]
    if odd:
        raise GuardError(f"{column} has unknown values: {odd}")
    return df


def require_share(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    share = df.agg(F.avg(F.col(column).cast("double"))).first()[0]
    if share is None or not low <= share <= high:
        raise GuardError(f"the mean of {column} is {share}, not within {low} and {high}")
    return df


def require_complete(origins: list[int], last_complete: int) -> list[int]:
    """The origins (month numbers), none of them past the last month that every source has in whole."""
    late = [m for m in origins if m > last_complete]
    if late:
        raise GuardError(f"months {late} are past the last complete month {last_complete}: harvest again or shorten the grid")
    return origins


def coverage(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, dtype, non_null share of each column, in one scan."""
    columns = columns or df.columns
    kinds = dict(df.dtypes)
    one = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("dtype"), F.try_divide(F.col(f"_{i}"), F.col("_n")).alias("non_null")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def any_of(*conditions):
    return reduce(or_, conditions)

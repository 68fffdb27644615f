"""Market structure: shares, concentration, histograms, crosstabs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(df: DataFrame, by: str, weight: Column | None = None, digits: int | None = None) -> DataFrame:
    """by, n, share (of 100), rank and cumulative share. The windows run over one row a group."""
    g = df.groupBy(by).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    order = Window.orderBy(F.desc("n"), F.asc_nulls_last(by))
    g = g.withColumn("share", F.round(share, digits) if digits is not None else share)
    return g.withColumns({"rank": F.row_number().over(order).cast("long"), "n_cumulative": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})


def concentration(shared: DataFrame) -> DataFrame:
    """One row: the four largest shares together, and the sum of squared shares."""
    return shared.agg(F.sum(F.when(F.col("rank") <= 4, F.col("share"))).alias("top4"), F.sum(F.col("share") * F.col("share")).alias("hhi"), F.count("*").alias("groups"))


def histogram(df: DataFrame, value: Column, width: float, most: int) -> DataFrame:
    """bin, n: whole bins of a width, all beyond the last in the last one."""
    return df.select(F.least(F.floor(value / width), F.lit(most)).cast("long").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def crosstab_share(df: DataFrame, row: str, column: str, rows: int = 8) -> DataFrame:
    """Cells of the `rows` rows with the largest totals, as a share of their column's total over all rows."""
    cells = df.groupBy(row, column).agg(F.count("*").alias("n"))
    largest = df.groupBy(row).agg(F.count("*").alias("_total")).orderBy(F.desc("_total"), F.asc_nulls_last(row)).limit(rows).select(F.col(row).alias("_row"))
    cells = cells.withColumn("share", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(column)))
    return cells.join(F.broadcast(largest), F.col(row).eqNullSafe(F.col("_row"))).drop("_row")


METRICS = {"count": F.count, "avg": F.avg, "min": F.min, "max": F.max}


def group_metric(df: DataFrame, by: str, metric: str, column: str, allowed: list[str]) -> DataFrame:
    """by, value for an allowed metric of an allowed column."""
    if metric not in METRICS or column not in allowed:
        raise ValueError(f"metric is one of {', '.join(METRICS)}, column one of {', '.join(allowed)}")
    return df.groupBy(by).agg(METRICS[metric](column).alias("value"))


def quantile_bins(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    """`bin` by the exact quantiles of a column, equal edges merged, right-closed; null where the value is null."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("edges"))
    e = df.crossJoin(F.broadcast(edges))  # one row
    return e.withColumn("bin", F.when(F.col(column).isNotNull(), F.size(F.filter(F.array_distinct("edges"), lambda x: x < F.col(column))).cast("long"))).drop("edges")

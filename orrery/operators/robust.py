"""Robust statistics of groups: median, deviation, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value, or null if it is NaN or infinite (which medians would count)."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def mad_threshold(rows: DataFrame, by: list[str], value: str, k: float = 5.0, name: str = "threshold") -> DataFrame:
    """Rows with median_<name>, mad_<name> and <name> = median + k * median distance from it.

    Two windowed medians over one shuffle: joining an aggregate back would
    compute what stands below twice.
    """
    w = Window.partitionBy(*by)
    v = finite(F.col(value))
    out = rows.withColumn(f"median_{name}", F.median(v).over(w))
    out = out.withColumn(f"mad_{name}", F.median(F.abs(v - F.col(f"median_{name}"))).over(w))
    return out.withColumn(name, F.col(f"median_{name}") + F.lit(k) * F.col(f"mad_{name}"))


def drag_threshold(rows: DataFrame, by: list[str], value: str, k: float = 5.0, fixed: float = 5e-5, enough: int = 10, name: str = "bstar_threshold") -> DataFrame:
    """`mad_threshold` over the values above zero if there are enough of them, else the fixed value."""
    w = Window.partitionBy(*by)
    rows = rows.withColumn("__v", F.when(F.col(value) > 0, F.col(value)))
    rows = mad_threshold(rows, by, "__v", k, "__d")
    there = F.count("__v").over(w)
    return rows.withColumn(name, F.when(there >= enough, F.col("__d")).otherwise(F.lit(fixed))).drop("__v", "__d", "median___d", "mad___d")


def noise_filter(rows: DataFrame, by: list[str], value: str, fixed: float = 1e-3, share: float = 0.5, quantile: float = 0.95) -> DataFrame:
    """Rows whose |value| is at most fixed; for groups that would lose more than half, at most the quantile of |value|."""
    w = Window.partitionBy(*by)
    size = F.abs(F.col(value))
    rows = rows.withColumn("__keep", F.sum((size <= fixed).cast("int")).over(w)).withColumn("__n", F.count("*").over(w)).withColumn("__q", F.percentile(size, F.lit(quantile)).over(w))
    limit = F.when(F.coalesce(F.col("__keep"), F.lit(0)) < F.col("__n") * share, F.col("__q")).otherwise(F.lit(fixed))
    return rows.filter(F.col(value).isNotNull() & (size <= limit)).drop("__keep", "__n", "__q")


def coverage(rows: DataFrame, by: list[str], time: str, least_days: int = 30) -> DataFrame:
    """(by, coverage_days, short): whole days between the first and last time, and whether they are too few."""
    from ..functions.times import days_between

    days = F.floor(days_between(F.min(time), F.max(time))).cast("long")
    return rows.groupBy(*by).agg(days.alias("coverage_days")).withColumn("short", F.col("coverage_days") < least_days)

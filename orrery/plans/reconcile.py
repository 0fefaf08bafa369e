"""Two sources of element sets against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import within_tolerance
from ..operators.lookups import duplicates


def reconcile(left: DataFrame, right: DataFrame, by: list[str], time: str = "epoch", seconds: float = 1.0) -> dict[str, DataFrame]:
    """matched: left rows with a partner; missing_right and missing_left: rows without one, with how often each time occurs."""
    return {
        "matched": within_tolerance(left, right, by, time, time, seconds),
        "missing_right": within_tolerance(left, right, by, time, time, seconds, anti=True).groupBy(*by, time).agg(F.count("*").alias("n")),
        "missing_left": within_tolerance(right, left, by, time, time, seconds, anti=True).groupBy(*by, time).agg(F.count("*").alias("n")),
        "duplicate_left": duplicates(left, [*by, time]),
        "duplicate_right": duplicates(right, [*by, time]),
    }


def summary(left: DataFrame, right: DataFrame, by: list[str], time: str = "epoch", seconds: float = 1.0) -> DataFrame:
    """One row of counts: records, distinct times and matches of both sides."""
    one = lambda rows, name: rows.agg(F.count("*").alias(name), F.countDistinct(*by, time).alias(f"{name}_distinct"))
    parts = [one(left, "left"), one(right, "right"), one(within_tolerance(left, right, by, time, time, seconds), "left_matched"), one(within_tolerance(right, left, by, time, time, seconds), "right_matched")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out

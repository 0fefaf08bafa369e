"""Which of several equal rows stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep(rows: DataFrame, key: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order, which has to be total."""
    w = Window.partitionBy(*[F.col(k) if isinstance(k, str) else k for k in key]).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def keep_last(rows: DataFrame, by: list[str], time: str, version: str) -> DataFrame:
    """Of element sets of one epoch the one issued last."""
    return keep(rows, [*by, time], [F.col(version).desc()])


def keep_first_second(rows: DataFrame, by: list[str], time: str, order: list[Column]) -> DataFrame:
    """Of sets within one second the first."""
    return keep(rows, [*by, F.date_trunc("SECOND", F.col(time))], order)


def keep_first_text(rows: DataFrame, by: list[str], text: str, order: list[Column]) -> DataFrame:
    """Of sets with the same text of the epoch the first."""
    return keep(rows, [*by, text], order)


def claim_buckets(rows: DataFrame, by: list[str], bucket: str, order: list[Column], ok: str) -> DataFrame:
    """The first row claims a bucket, and the bucket stays empty if that row failed."""
    return keep(rows, [*by, bucket], order).filter(F.col(ok))

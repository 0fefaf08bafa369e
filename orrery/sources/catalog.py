"""Landed JSON of the catalogue service: arrays of records whose values are all text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import parse_time
from ..operators.store import insert_counts, insert_ignore
from ..schemas import GP, SATCAT


def _typed(name: str, kind: T.DataType) -> Column:
    """A typed value; blank is null, malformed numbers raise (ANSI)."""
    raw = F.nullif(F.col(f"`{name}`"), F.lit(""))
    if isinstance(kind, T.TimestampNTZType):
        return parse_time(raw).alias(name)
    return raw.cast(kind).alias(name)


def records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Raw records, all text, with the error a service may have sent in their place."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema if f.name != "ingested_at"] + [T.StructField("error", T.StringType())])
    return spark.read.schema(text).json(path, multiLine=True, primitivesAsString=True)


def check(raw: DataFrame, context: str = "") -> DataFrame:
    """Raise, when rows are computed, if the service answered with an error."""
    where = f" ({context})" if context else ""
    guard = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit(f"the catalogue service answered with an error{where}: "), F.col("error"))).cast("string"))
    return raw.withColumn("error", guard).filter(F.col("error").isNull()).drop("error")


def read(spark: SparkSession, path: str, schema: T.StructType, context: str = "") -> DataFrame:
    """Typed rows of landed files."""
    return typed(records(spark, path, schema), schema, context)


def typed(raw: DataFrame, schema: T.StructType, context: str = "") -> DataFrame:
    """Typed rows of a schema from records that are all text; GP_ID_ORIG is the same as GP_ID, ingested_at is now."""
    rows = check(raw, context)
    columns = []
    for f in schema:
        if f.name == "ingested_at":
            columns.append(F.current_timestamp().cast("timestamp_ntz").alias(f.name))
        elif f.name == "GP_ID_ORIG":
            columns.append(F.nullif(F.col("GP_ID"), F.lit("")).cast("long").alias(f.name))
        else:
            columns.append(_typed(f.name, f.dataType))
    return rows.select(*columns)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Element sets of a full pull: objects that have not decayed, by object."""
    return flying(read(spark, path, GP, "elements")).orderBy("NORAD_CAT_ID")


def flying(rows: DataFrame) -> DataFrame:
    """Objects that have not decayed."""
    return rows.filter(F.col("DECAY_DATE").isNull())


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path, SATCAT, "metadata")


def newer(spark: SparkSession, path: str, watermark: str) -> DataFrame:
    """Element sets of an incremental pull: epochs after the last."""
    return after(read(spark, path, GP, "update"), watermark)


def after(rows: DataFrame, watermark: str) -> DataFrame:
    return rows.filter(F.col("EPOCH") > F.lit(watermark).cast("timestamp_ntz"))


def newer_by_object(spark: SparkSession, path: str, gp: DataFrame) -> DataFrame:
    """Landed element sets that are `ahead` of gp."""
    return ahead(read(spark, path, GP, "update"), gp)


def ahead(rows: DataFrame, gp: DataFrame) -> DataFrame:
    """Element sets newer than the one that gp has of the same object, and those of objects it does not have.

    One object whose epoch runs ahead holds back no other.
    """
    latest = gp.groupBy("NORAD_CAT_ID").agg(F.max("EPOCH").alias("__latest"))
    return rows.join(latest, "NORAD_CAT_ID", "left").filter(F.col("__latest").isNull() | (F.col("EPOCH") > F.col("__latest"))).select(rows.columns)


def between(spark: SparkSession, path: str, norad: int, start: str, end: str) -> DataFrame:
    """Element sets of one object from one day through another."""
    return of_days(read(spark, path, GP, "history"), norad, start, end)


def of_days(rows: DataFrame, norad: int, start: str, end: str) -> DataFrame:
    return rows.filter((F.col("NORAD_CAT_ID") == norad) & F.to_date("EPOCH").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def backfill(spark: SparkSession, history: DataFrame, path: str, norad: int, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """(history with the new sets, one row of inserted and skipped)."""
    found = between(spark, path, norad, start, end)
    return insert_ignore(history, found, ["GP_ID"]), insert_counts(history, found, ["GP_ID"])


def backfill_if_needed(spark: SparkSession, history: DataFrame, path: str, norad: int, start: str, end: str) -> DataFrame:
    """As `backfill`, but only where the history has nothing of the object in the window."""
    text = F.date_format("EPOCH", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    have = history.filter((F.col("NORAD_CAT_ID") == norad) & (text >= start) & (text <= f"{end}T23:59:59"))
    return backfill(spark, history, path, norad, start, end)[0] if have.isEmpty() else history

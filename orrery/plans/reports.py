"""Status reports as DataFrames, and the command line that prints them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import shown
from ..operators.lookups import counts, epoch_range, range_by


def catalog_status(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows of each table, types of objects, the range of epochs, and the watermarks."""
    sizes = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        sizes = one if sizes is None else sizes.unionByName(one)
    return {"tables": sizes, "by_type": counts(tables["gp"], "OBJECT_TYPE", 15), "by_country": counts(tables["satcat"], "COUNTRY", 10), "epochs": epoch_range(tables["gp"]), "watermarks": tables["sync_meta"].orderBy("key")}


def catalog_stats(gp: DataFrame, history: DataFrame, satcat: DataFrame) -> dict[str, DataFrame]:
    n = lambda rows, name: rows.agg(F.count("*").alias(name))
    totals = n(gp, "gp_count").crossJoin(n(history, "gp_history_count")).crossJoin(n(satcat, "satcat_count")).crossJoin(epoch_range(gp))  # rows of one
    return {"totals": totals, "gp_by_type": counts(gp, "OBJECT_TYPE"), "satcat_by_country": counts(satcat, "COUNTRY", 20)}


def recent_maneuvers(maneuvers: DataFrame, gp: DataFrame, n: int = 20) -> DataFrame:
    """The last detections with names for show."""
    last = maneuvers.orderBy(F.col("EPOCH_AFTER").desc_nulls_last(), "NORAD_CAT_ID", "EPOCH_BEFORE").limit(n)
    named = last.join(gp.select("NORAD_CAT_ID", "OBJECT_NAME"), "NORAD_CAT_ID", "left")
    return named.select("NORAD_CAT_ID", shown(F.col("OBJECT_NAME"), 20).alias("name"), "EPOCH_BEFORE", "EPOCH_AFTER", "DELTA_SMA", "VEL_RESIDUAL_MS", shown(F.col("CLASSIFICATION"), default="-").alias("classification"), "KP").orderBy(F.col("EPOCH_AFTER").desc_nulls_last(), "NORAD_CAT_ID")


def sensor_status(sensors: DataFrame) -> dict[str, DataFrame]:
    return {"n": sensors.agg(F.count("*").alias("n")), "by_type": counts(sensors, "TYPE"), "by_country": counts(sensors, "COUNTRY", 15), "ranges": range_by(sensors, "TYPE", "MAX_RANGE_KM")}


def sensor_list(sensors: DataFrame) -> DataFrame:
    return sensors.select("SENSOR_ID", "NAME", "COUNTRY", "TYPE", "LAT", "LON", "MIN_RANGE_KM", "MAX_RANGE_KM", "MIN_EL_DEG").orderBy("SENSOR_ID")


def maneuver_details(pairs: DataFrame) -> DataFrame:
    """What is flagged, with the flags as text."""
    flags = F.concat_ws("+", F.when(F.col("od_flag"), "OD"), F.when(F.col("bstar_flag"), "B*"))
    return pairs.filter("likely_maneuver").select("NORAD_CAT_ID", "epoch_from", "epoch_to", "gap_days", "vel_residual_ms", "delta_sma", "delta_bstar", "kp", F.upper("classification").alias("class"), flags.alias("flags")).orderBy("class", "NORAD_CAT_ID", "epoch_from")

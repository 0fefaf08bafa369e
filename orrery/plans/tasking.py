"""Sensor tasking: access windows, the best schedule, and the reports on it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..functions.tle import usable
from ..operators.propagate import access, time_grid
from ..operators.schedule import audit, choose, weights
from ..operators.windows import concurrent, fleet_age, revisit_gaps
from ..sources.parameters import stations

COUNTRIES = ("SING", "MALA", "INDO", "THAI")


def _at(t: datetime) -> Column:
    return F.lit(t.replace(tzinfo=None)).cast("timestamp_ntz")


def fleet(gp: DataFrame, countries: tuple[str, ...] = COUNTRIES, since: str = "2026-01-01") -> DataFrame:
    """Objects of some countries with a recent element set."""
    kept = gp.filter(F.col("COUNTRY_CODE").isin(*countries) & usable(F.trim("TLE_LINE1"), F.trim("TLE_LINE2")) & (F.col("EPOCH") >= F.lit(since).cast("timestamp_ntz")))
    name = F.coalesce(F.nullif(F.trim("OBJECT_NAME"), F.lit("")), F.col("NORAD_CAT_ID").cast("string"))
    return kept.select(F.col("NORAD_CAT_ID").alias("norad_id"), name.alias("name"), F.trim("TLE_LINE1").alias("TLE_LINE1"), F.trim("TLE_LINE2").alias("TLE_LINE2"))


def schedule(objects: DataFrame, start: datetime, end: datetime, sensors: list[dict] | None = None) -> DataFrame:
    """All access windows with their weight and whether they are tracked; sensors are those of `stations` if not given."""
    n = max(objects.sparkSession.sparkContext.defaultParallelism, int(objects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    windows = access(objects.repartition(n, "norad_id"), stations() if sensors is None else sensors, start, end)
    return choose(weights(windows, _at(start)))


def contacts(windows: DataFrame) -> DataFrame:
    """Windows and minutes of each sensor."""
    return windows.groupBy("sensor").agg(F.count("*").alias("contacts"), F.sum(seconds_between(F.col("t_aos"), F.col("t_los")) / 60.0).alias("minutes")).orderBy("sensor")


def selection(chosen: DataFrame) -> DataFrame:
    """Windows of each sensor that are tracked, skipped, and there."""
    return chosen.groupBy("sensor").agg(F.count_if("selected").alias("scheduled"), F.count_if(~F.col("selected")).alias("skipped"), F.count("*").alias("available")).orderBy("sensor")


def revisits(chosen: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return revisit_gaps(chosen, "norad_id", "t_aos", "selected", _at(start), _at(end))


def fleet_average(stats: DataFrame) -> DataFrame:
    """One row: the mean over objects of their mean gap."""
    return stats.agg(F.avg("avg_gap_min").alias("fleet_avg_gap_min"))


def conflicts(chosen: DataFrame, start: datetime) -> DataFrame:
    return audit(chosen, _at(start))


def simultaneous(windows: DataFrame) -> DataFrame:
    return concurrent(windows, ["sensor"], "t_aos", "t_los", "norad_id")


def revisit_series(chosen: DataFrame, start: datetime, end: datetime, step_s: float = 60.0) -> DataFrame:
    """Mean age of the fleet's last tracks, in hours, at each minute."""
    tracks = chosen.filter("selected").select("norad_id", F.col("t_aos").alias("track"))
    return fleet_age(tracks, "norad_id", "track", time_grid(chosen.sparkSession, start, end, step_s), "t")

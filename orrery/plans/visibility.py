"""Which objects sensors can see: passes, and the reports on them."""

from __future__ import annotations

import math
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import shown
from ..operators.joins import in_all
from ..operators.lookups import first_objects
from ..operators.propagate import visibility

FIELDS = ["SENSOR_ID", "NAME", "LAT", "LON", "ALT_M", "MIN_EL_DEG", "MIN_RANGE_KM", "MAX_RANGE_KM"]


def passes(gp: DataFrame, sensors: DataFrame, start: datetime, end: datetime, step_s: float = 30.0) -> DataFrame:
    """Passes of all objects with element sets over the sensors asked for (a stated set: a command line or a table of stations)."""
    asked = [r.asDict() for r in sensors.select(*FIELDS).dropDuplicates(["SENSOR_ID"]).orderBy("SENSOR_ID").collect()]
    flying = gp.filter(F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull())
    if not asked:
        return visibility(flying.limit(0), [], start, end, step_s)
    least = min(max(0.0, s["MIN_RANGE_KM"] * math.sin(math.radians(s["MIN_EL_DEG"]))) for s in asked)
    near = flying.filter((F.col("PERIAPSIS") <= max(s["MAX_RANGE_KM"] for s in asked)) & (F.col("APOAPSIS") >= least))
    n = max(gp.sparkSession.sparkContext.defaultParallelism, int(gp.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return visibility(near.repartition(n, "NORAD_CAT_ID"), asked, start, end, step_s)


def matrix(found: DataFrame, gp: DataFrame, sensors: list[int]) -> DataFrame:
    """A row for each object; for each sensor the number of passes, total minutes and best elevation."""
    wide = found.groupBy("NORAD_CAT_ID").pivot("sensor", sensors).agg(F.count(F.lit(1)).alias("passes"), F.round(F.sum("duration_s") / 60.0, 6).alias("minutes"), F.max("max_el_deg").alias("best_el_deg"))
    who = gp.select("NORAD_CAT_ID", shown(F.col("OBJECT_NAME"), 24).alias("name"), shown(F.col("OBJECT_TYPE"), 12).alias("object_type"), shown(F.col("RCS_SIZE"), 6).alias("rcs"))
    return wide.join(who, "NORAD_CAT_ID", "left").orderBy("NORAD_CAT_ID")


def totals(found: DataFrame, sensors: list[int]) -> DataFrame:
    """One row: objects seen by some sensor, and by all of them."""
    every = in_all(found, "NORAD_CAT_ID", "sensor", len(set(sensors)))
    return found.agg(F.countDistinct("NORAD_CAT_ID").alias("objects")).crossJoin(every.agg(F.count("*").alias("by_all")))


def by_sensor(found: DataFrame) -> DataFrame:
    return found.groupBy("sensor").agg(F.countDistinct("NORAD_CAT_ID").alias("objects"), F.count("*").alias("passes")).orderBy("sensor")


def details(found: DataFrame, objects: int = 50) -> DataFrame:
    """Passes of the first objects, and how many objects there are besides."""
    return first_objects(found, "NORAD_CAT_ID", objects).orderBy("NORAD_CAT_ID", "sensor", "aos")

"""Conjunction screening: candidates by altitude, approaches by propagation, reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import sub_point, track_bearing
from ..functions.labels import severity, shown
from ..functions.times import gmst, julian
from ..operators.joins import overlaps
from ..operators.lookups import candidates
from ..operators.propagate import conjunctions

PAD_KM, WARN_KM, RED_KM = 50.0, 25.0, 5.0


def _tasks(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def screen(gp: DataFrame, primary: int, start: datetime, end: datetime, warn_km: float = WARN_KM, red_km: float = RED_KM, pad_km: float = PAD_KM, dense: bool = False) -> DataFrame:
    """Approaches of one object by all whose altitudes come near its own, nearest first."""
    own = gp.filter(F.col("NORAD_CAT_ID") == primary).limit(1).select(F.col("NORAD_CAT_ID").alias("id1"), F.col("TLE_LINE1").alias("line11"), F.col("TLE_LINE2").alias("line12"))
    other = candidates(gp, primary, pad_km).select(F.col("NORAD_CAT_ID").alias("id2"), F.col("TLE_LINE1").alias("line21"), F.col("TLE_LINE2").alias("line22"))
    pairs = other.repartition(_tasks(gp), "id2").crossJoin(F.broadcast(own))  # one row
    return report(conjunctions(pairs, start, end, warn_km, dense=dense), gp, red_km, warn_km)


def fleet_pairs(gp: DataFrame, pad_km: float = PAD_KM, width_km: float = 100.0) -> DataFrame:
    """(id1, lines, id2, lines) of all pairs of objects whose padded altitudes overlap, each once."""
    flying = gp.filter(F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull()).select("NORAD_CAT_ID", "TLE_LINE1", "TLE_LINE2", (F.col("PERIAPSIS") - pad_km / 2).alias("lo"), (F.col("APOAPSIS") + pad_km / 2).alias("hi"))
    pairs = overlaps(flying, flying, ("lo", "hi"), ("lo", "hi"), width_km).filter("l.NORAD_CAT_ID < r.NORAD_CAT_ID")
    return pairs.select(*[F.col(f"{s}.{c}").alias(n) for s, k in (("l", "1"), ("r", "2")) for c, n in (("NORAD_CAT_ID", f"id{k}"), ("TLE_LINE1", f"line{k}1"), ("TLE_LINE2", f"line{k}2"))])


def report(events: DataFrame, gp: DataFrame, red_km: float = RED_KM, warn_km: float = WARN_KM) -> DataFrame:
    """Events with the other object's name, country and type, and their severity, by miss distance."""
    who = gp.select(F.col("NORAD_CAT_ID").alias("id2"), shown(F.col("OBJECT_NAME")).alias("name"), F.upper(shown(F.col("OBJECT_TYPE"), default="UNKNOWN")).alias("object_type"), shown(F.trim("COUNTRY_CODE"), default="(unknown)").alias("country"))
    return events.join(who, "id2", "left").withColumn("severity", severity(F.col("miss_dist_km"), red_km, warn_km)).orderBy("miss_dist_km", "id2", "tca")


def by_country(events: DataFrame) -> DataFrame:
    """Events of each country as columns for the types, most events first; known types come before others."""
    known = ["PAYLOAD", "ROCKET BODY", "DEBRIS", "UNKNOWN"]
    extra = [r[0] for r in events.select("object_type").distinct().filter(~F.col("object_type").isin(known)).orderBy("object_type").limit(1000).collect()]  # columns of a report
    out = events.groupBy("country").pivot("object_type", known + extra).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in known + extra), F.lit(0))
    return out.withColumn("total", total).orderBy(F.col("total").desc(), "country")


def miss_series(events: DataFrame) -> DataFrame:
    """What the plot of miss distance over time shows."""
    return events.select("tca", "miss_dist_km", "rel_speed_km_s", "object_type", "severity").orderBy("tca")


def map_series(events: DataFrame) -> DataFrame:
    """Where events are on the ground, and in which direction the other object moves there (degrees from north)."""
    angle = gmst(*julian(F.col("tca")))
    r, v = (tuple(F.col(c)[i] for i in range(3)) for c in ("r2", "v2"))
    lat, lon = sub_point(r, angle)
    return events.select("id2", "tca", "miss_dist_km", lat.alias("lat"), lon.alias("lon"), F.degrees(track_bearing(r, v, angle)).alias("bearing_deg"))


def ground_track(trajectory: DataFrame, key: str = "NORAD_CAT_ID") -> DataFrame:
    """(key, t, lat, lon, segment) of a trajectory, parted where it crosses the antimeridian."""
    from ..operators.windows import segments

    lat, lon = sub_point((F.col("x"), F.col("y"), F.col("z")), gmst(*julian(F.col("t"))))
    return segments(trajectory.select(key, "t", lat.alias("lat"), lon.alias("lon")), [key], "t", "lon")

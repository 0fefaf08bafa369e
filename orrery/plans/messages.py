"""Conjunction messages against our own propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import sub_point
from ..functions.times import age_hours, gmst, half_hours, julian, micros, seconds_between
from ..operators.dedupe import claim_buckets, keep_first_text
from ..operators.joins import asof_else_next, nearest
from ..operators.propagate import distance_profile, pair_approach


def _sets(history: DataFrame, side: str) -> DataFrame:
    kept = history.filter(F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull())
    return kept.select(F.col("NORAD_CAT_ID").alias(f"{side}_norad"), F.col("EPOCH").alias("__e"), F.col("TLE_LINE1").alias("__1"), F.col("TLE_LINE2").alias("__2"))


def with_elements(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Messages with the lines of both objects: the last set up to the approach, else the nearest."""
    out = messages
    for k, side in (("1", "sat1"), ("2", "sat2")):
        out = asof_else_next(out, _sets(history, side), [f"{side}_norad"], "tca", "__e", ["__1", "__2"])
        out = out.withColumn(f"epoch{k}", F.col("match.time")).withColumn(f"line{k}1", F.col("match.__1")).withColumn(f"line{k}2", F.col("match.__2")).drop("match")
    return out


def verify(messages: DataFrame, history: DataFrame) -> DataFrame:
    """Messages with our approach, its place, and how it differs from theirs."""
    found = pair_approach(with_elements(messages, history))
    angle = gmst(*julian(F.col("sgp4_tca")))
    for k in ("1", "2"):
        lat, lon = sub_point(tuple(F.col(f"r{k}")[i] for i in range(3)), angle)
        found = found.withColumn(f"sat{k}_lat", lat).withColumn(f"sat{k}_lon", lon)
    return compare(found)


def compare(found: DataFrame) -> DataFrame:
    """tca_offset_s, miss_error_km and miss_ratio of rows with both results."""
    miss = F.col("miss_distance_km")
    return found.withColumn("tca_offset_s", seconds_between(F.col("tca"), F.col("sgp4_tca"))).withColumn("miss_error_km", F.col("sgp4_miss_km") - miss).withColumn("miss_ratio", F.when(miss > 0, F.col("sgp4_miss_km") / miss))


def profile(messages: DataFrame, history: DataFrame) -> DataFrame:
    return distance_profile(with_elements(messages, history).select("cdm_id", "tca", "line11", "line12", "line21", "line22"))


def series(messages: DataFrame, history: DataFrame, side: str, days: float = 5.0) -> DataFrame:
    """(cdm_id, tca, epoch, lines, seq) of the sets of one object up to the approach, each text of an epoch once, oldest first."""
    rows = messages.select("cdm_id", "tca", F.col(f"{side}_norad").alias("__n")).join(history, F.col("__n") == F.col("NORAD_CAT_ID"))
    age = age_hours(F.col("EPOCH"), F.col("tca"))
    rows = rows.filter((age >= 0) & (age <= 24.0 * days) & F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull())
    rows = keep_first_text(rows.withColumn("__text", F.col("EPOCH").cast("string")), ["cdm_id"], "__text", [F.col("GP_ID")])
    return rows.select("cdm_id", "tca", F.col("EPOCH").alias("epoch"), F.col("TLE_LINE1").alias("line1"), F.col("TLE_LINE2").alias("line2"), age.alias("age_h"))


def age_sensitivity(messages: DataFrame, history: DataFrame, days: float = 5.0) -> DataFrame:
    """How the result moves as element sets get older, a point for each half hour of the greater age.

    Three sweeps: the first object's sets against the second's freshest, the
    other way round, and each first set with the second set nearest in age.
    The first pair of a half hour claims it, even if it cannot be propagated.
    """
    one, two = series(messages, history, "sat1", days), series(messages, history, "sat2", days)
    fresh = lambda s: s.groupBy("cdm_id").agg(F.max_by(F.struct("epoch", "line1", "line2", "age_h"), "epoch").alias("f"))
    a = one.join(fresh(two), "cdm_id").select("cdm_id", "tca", F.lit(1).alias("sweep"), F.struct("epoch", "line1", "line2", "age_h").alias("p"), F.col("f").alias("q"))
    b = two.join(fresh(one), "cdm_id").select("cdm_id", "tca", F.lit(2).alias("sweep"), F.col("f").alias("p"), F.struct("epoch", "line1", "line2", "age_h").alias("q"))
    close = nearest(one, two.select("cdm_id", "epoch", "line1", "line2", "age_h").withColumnRenamed("line1", "o1").withColumnRenamed("line2", "o2").withColumnRenamed("age_h", "oa").withColumnRenamed("epoch", "oe"), ["cdm_id"], "epoch", "oe", ["o1", "o2", "oa"])
    c = close.filter(F.col("match").isNotNull()).select("cdm_id", "tca", F.lit(3).alias("sweep"), F.struct("epoch", "line1", "line2", "age_h").alias("p"), F.struct(F.col("match.time").alias("epoch"), F.col("match.o1").alias("line1"), F.col("match.o2").alias("line2"), F.col("match.oa").alias("age_h")).alias("q"))
    pairs = a.unionByName(b).unionByName(c).withColumn("max_age_h", F.greatest("p.age_h", "q.age_h"))
    pairs = pairs.withColumn("bucket", half_hours(F.col("max_age_h"))).withColumn("ok", F.lit(True))
    own = F.when(F.col("sweep") == 2, micros(F.col("q.epoch"))).otherwise(micros(F.col("p.epoch")))
    firsts = claim_buckets(pairs, ["cdm_id"], "bucket", [F.col("sweep"), own], "ok")
    ready = firsts.select("cdm_id", "tca", "max_age_h", F.col("p.age_h").alias("sat1_age_h"), F.col("q.age_h").alias("sat2_age_h"), F.col("p.line1").alias("line11"), F.col("p.line2").alias("line12"), F.col("q.line1").alias("line21"), F.col("q.line2").alias("line22"))
    found = pair_approach(ready).filter(F.col("sgp4_miss_km").isNotNull())
    theirs = messages.select("cdm_id", "miss_distance_km")
    out = found.join(theirs, "cdm_id").select("cdm_id", "max_age_h", "sat1_age_h", "sat2_age_h", F.col("sgp4_miss_km").alias("miss_km"), seconds_between(F.col("tca"), F.col("sgp4_tca")).alias("tca_offset_s"), ((F.col("sgp4_miss_km") - F.col("miss_distance_km")) * 1000.0).alias("miss_error_m"))
    return out.orderBy("cdm_id", "max_age_h")

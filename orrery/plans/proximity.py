"""Monitoring of rendezvous missions: maneuvers, distance, phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dedupe import keep_last
from ..operators.propagate import separation
from ..sources.parameters import window
from .maneuver import sgp4_only


def history_of(history: DataFrame, norad: int, phases: DataFrame) -> DataFrame:
    """Sets of an object in the window of some phases (its last day up to the last whole second), the last of each epoch."""
    span = F.broadcast(window(phases).select(F.col("begin").alias("__begin"), F.col("end").alias("__end")))  # one row
    own = history.filter(F.col("NORAD_CAT_ID") == norad).crossJoin(span)
    return keep_last(own.filter(F.col("EPOCH").between(F.col("__begin"), F.col("__end"))).drop("__begin", "__end"), ["NORAD_CAT_ID"], "EPOCH", "GP_ID")


def phase_of(rows: DataFrame, time: str, phases: DataFrame, default: str = "Gap/unphased") -> DataFrame:
    """Rows with `phase`: the first phase whose days hold the time; phases are a mission's few rows."""
    spans = F.broadcast(phases.agg(F.sort_array(F.collect_list(F.struct("ordinal", "phase", "first", "last"))).alias("__p")))
    held = F.filter("__p", lambda p: (p["first"] <= F.col(time)) & (F.col(time) <= p["last"]))
    return rows.crossJoin(spans).withColumn("phase", F.coalesce(F.get(held, F.lit(0))["phase"], F.lit(default))).drop("__p")


def distances(history: DataFrame, chaser: int, target: int, phases: DataFrame, step_s: int = 300) -> DataFrame:
    """(t, sep_km) of two objects over the window of some phases."""
    spark = history.sparkSession
    one, two = (history_of(history, n, phases).select(F.lit(1).alias("pair"), "EPOCH", "TLE_LINE1", "TLE_LINE2") for n in (chaser, target))
    grid = window(phases).filter("begin IS NOT NULL").select(F.lit(1).alias("pair"), F.explode(F.sequence("begin", "end", F.expr(f"INTERVAL {int(step_s)} SECOND"))).alias("t"))
    n = max(spark.sparkContext.defaultParallelism, 8)
    return separation(grid.repartition(n, "t"), one, two).drop("pair")


def closest(series: DataFrame) -> DataFrame:
    """One row: the time and distance of the closest approach, the first of equal ones."""
    return series.agg(F.min_by(F.struct("t", "sep_km"), F.struct("sep_km", "t")).alias("m")).select("m.*")


def closest_by_phase(series: DataFrame, phases: DataFrame) -> DataFrame:
    """The closest approach of each phase; a time in two phases counts in both, a phase without data has infinity."""
    p = F.broadcast(phases)
    held = p.join(series, (F.col("t") >= F.col("first")) & (F.col("t") <= F.col("last")), "left")
    out = held.groupBy("ordinal", "phase").agg(F.min_by(F.struct("t", "sep_km"), F.when(F.col("t").isNotNull(), F.struct("sep_km", "t"))).alias("m"))
    return out.select("ordinal", "phase", F.col("m.t").alias("t"), F.coalesce("m.sep_km", F.lit(float("inf"))).alias("sep_km")).orderBy("ordinal")


def detections_by_phase(history: DataFrame, chaser: int, phases: DataFrame) -> DataFrame:
    """How many maneuvers of an object fall in each phase."""
    found = sgp4_only(history_of(history, chaser, phases)).filter("is_maneuver")
    return phase_of(found, "epoch_after", phases).groupBy("phase").agg(F.count("*").alias("n")).orderBy("phase")


def noise_floor(history: DataFrame, target: int, phases: DataFrame) -> DataFrame:
    """One row: the 95th percentile of an object's residuals."""
    found = sgp4_only(history_of(history, target, phases))
    return found.agg(F.percentile("vel_residual_ms", F.lit(0.95)).alias("p95_ms"))

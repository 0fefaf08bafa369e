"""Maneuver detection for all objects in one job.

history -> last set of an epoch -> noise filter -> pairs of neighbours ->
residuals -> thresholds of each object -> space weather -> classification.
The history is parted by object once, and every step up to the thresholds
reuses that; the residuals are the only Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import above, classification, disturbed
from ..functions.times import seconds_between
from ..functions.tle import bstar, usable
from ..operators.dedupe import keep_last
from ..operators.joins import covering_else_nearest
from ..operators.propagate import residual
from ..operators.robust import drag_threshold, mad_threshold, noise_filter
from ..operators.windows import drag_change, gap_ok, lead_pairs

SIGMA, KP_DISTURBED, MAX_GAP_DAYS, DRAG_NOISE, DRAG_FIXED, MIN_HISTORY_DAYS = 5.0, 5.0, 10.0, 1e-3, 5e-5, 30

# The older detector's least changes of elements between two sets.
ELEMENT_CHANGES = {"SEMIMAJOR_AXIS": 1.0, "ECCENTRICITY": 0.001, "INCLINATION": 0.05, "RA_OF_ASC_NODE": 0.5, "PERIOD": 0.05}

_KEPT = ["SEMIMAJOR_AXIS", "ECCENTRICITY", "INCLINATION", "TLE_LINE1", "TLE_LINE2", "__drag"]


def clean_history(history: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Sets of the objects, the last of each epoch, without those whose drag term is noise."""
    rows = history if ids is None else history.join(ids.select("NORAD_CAT_ID").distinct(), "NORAD_CAT_ID", "left_semi")
    last = keep_last(rows.repartition("NORAD_CAT_ID"), ["NORAD_CAT_ID"], "EPOCH", "GP_ID").withColumn("__drag", bstar(F.col("TLE_LINE1")))
    return noise_filter(last, ["NORAD_CAT_ID"], "__drag", DRAG_NOISE)


def analyse(history: DataFrame, kp: DataFrame | None = None, ids: DataFrame | None = None, sigma: float = SIGMA, kp_threshold: float = KP_DISTURBED, physical_drag: bool = False, include_latest: DataFrame | None = None) -> DataFrame:
    """A row for each pair of neighbouring sets that can be compared.

    kp: (datetime, kp), or None; without an index nothing counts as disturbed.
    include_latest: the table of latest sets, which the history does not have.
    """
    rows = history if include_latest is None else history.unionByName(include_latest, allowMissingColumns=True)
    pairs = lead_pairs(clean_history(rows, ids), ["NORAD_CAT_ID"], "EPOCH", _KEPT)
    lines = [F.col(c) for c in ("TLE_LINE1", "TLE_LINE2", "next_TLE_LINE1", "next_TLE_LINE2")]
    pairs = pairs.filter(gap_ok(F.col("gap_days"), 1e-4, MAX_GAP_DAYS) & usable(*lines[:2]) & usable(*lines[2:]))
    gap = seconds_between(F.col("EPOCH"), F.col("next_EPOCH"))
    found = pairs.withColumn("__r", residual(lines[0], lines[1], F.col("__drag"), gap, lines[2], lines[3], "wgs84", True, physical_drag))
    found = found.filter(F.col("__r.km").isNotNull() & ~F.isnan("__r.km") & ~F.isnan("__r.m_s"))
    out = found.select(
        "NORAD_CAT_ID", F.col("EPOCH").alias("epoch_from"), F.col("next_EPOCH").alias("epoch_to"), F.round("gap_days", 3).alias("gap_days"), F.round("__r.km", 3).alias("pos_residual_km"),
        F.round("__r.m_s", 4).alias("vel_residual_ms"), F.round(F.col("__r.m_s") / F.greatest("gap_days", F.lit(1e-6)), 4).alias("vel_res_per_day"), F.col("next___drag").alias("bstar"),
        F.round(drag_change(F.col("__drag"), F.col("next___drag")), 8).alias("delta_bstar"), F.round(F.col("next_SEMIMAJOR_AXIS") - F.col("SEMIMAJOR_AXIS"), 3).alias("delta_sma"),
        F.round(F.col("next_ECCENTRICITY") - F.col("ECCENTRICITY"), 6).alias("delta_ecc"), F.round(F.col("next_INCLINATION") - F.col("INCLINATION"), 4).alias("delta_inc"),
    )
    out = mad_threshold(out, ["NORAD_CAT_ID"], "vel_res_per_day", sigma, "vr_threshold").drop("median_vr_threshold", "mad_vr_threshold")
    out = drag_threshold(out, ["NORAD_CAT_ID"], "delta_bstar", sigma, DRAG_FIXED)
    out = covering_else_nearest(out, kp, "epoch_from", "datetime", "kp") if kp is not None else out.withColumn("kp", F.lit(None).cast("double"))
    return classify(out, kp_threshold)


def classify(pairs: DataFrame, kp_threshold: float = KP_DISTURBED) -> DataFrame:
    """Flags and the class of pairs that have their thresholds and the index."""
    out = pairs.withColumn("bad_space_weather", disturbed(F.col("kp"), kp_threshold)).withColumn("od_flag", above(F.col("vel_res_per_day"), F.col("vr_threshold"))).withColumn("bstar_flag", above(F.col("delta_bstar"), F.col("bstar_threshold")))
    out = out.withColumn("likely_maneuver", F.col("od_flag") | F.col("bstar_flag"))
    out = out.withColumn("confirmed_maneuver", F.col("likely_maneuver") & ~F.col("bad_space_weather")).withColumn("uncertain_maneuver", F.col("likely_maneuver") & F.col("bad_space_weather"))
    return out.withColumn("classification", classification(F.col("likely_maneuver"), F.col("bad_space_weather")))


def sgp4_only(history: DataFrame, by: str = "NORAD_CAT_ID", sigma: float = SIGMA, max_gap_days: float = MAX_GAP_DAYS) -> DataFrame:
    """The detector of proximity monitoring: SGP4 against SGP4, threshold on the raw residual."""
    last = keep_last(history.repartition(by), [by], "EPOCH", "GP_ID")
    pairs = lead_pairs(last, [by], "EPOCH", ["SEMIMAJOR_AXIS", "TLE_LINE1", "TLE_LINE2"])
    lines = [F.col(c) for c in ("TLE_LINE1", "TLE_LINE2", "next_TLE_LINE1", "next_TLE_LINE2")]
    pairs = pairs.filter(gap_ok(F.col("gap_days"), 0.0, max_gap_days, open_at_least=True) & usable(*lines[:2]) & usable(*lines[2:]))
    gap = seconds_between(F.col("EPOCH"), F.col("next_EPOCH"))
    found = pairs.withColumn("__r", residual(lines[0], lines[1], F.lit(0.0), gap, lines[2], lines[3], "wgs72", False)).filter(F.col("__r.m_s").isNotNull() & ~F.isnan("__r.m_s"))
    change = F.when((F.col("SEMIMAJOR_AXIS") != 0) & (F.col("next_SEMIMAJOR_AXIS") != 0), F.col("next_SEMIMAJOR_AXIS") - F.col("SEMIMAJOR_AXIS"))
    out = found.select(by, F.col("next_EPOCH").alias("epoch_after"), F.col("__r.m_s").alias("vel_residual_ms"), change.alias("delta_sma"))
    out = mad_threshold(out, [by], "vel_residual_ms", sigma, "threshold").drop("median_threshold", "mad_threshold")
    return out.withColumn("is_maneuver", above(F.col("vel_residual_ms"), F.col("threshold")))


def element_changes(history: DataFrame, limits: dict[str, float] = ELEMENT_CHANGES) -> DataFrame:
    """The older detector: pairs in which some element moved by more than its limit."""
    pairs = lead_pairs(keep_last(history, ["NORAD_CAT_ID"], "EPOCH", "GP_ID"), ["NORAD_CAT_ID"], "EPOCH", list(limits))
    moved = [F.abs(F.col(f"next_{c}") - F.col(c)) > F.lit(x) for c, x in limits.items()]
    test: Column = moved[0]
    for m in moved[1:]:
        test = F.coalesce(test, F.lit(False)) | F.coalesce(m, F.lit(False))
    return pairs.filter(test).select("NORAD_CAT_ID", F.col("EPOCH").alias("epoch_from"), F.col("next_EPOCH").alias("epoch_to"), *[(F.col(f"next_{c}") - F.col(c)).alias(f"delta_{c.lower()}") for c in limits])


def totals(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of a report: pairs, flags, classes, and the thresholds."""
    flags = ("od_flag", "bstar_flag", "confirmed_maneuver", "uncertain_maneuver")
    return pairs.groupBy(*(by or ["NORAD_CAT_ID"])).agg(F.count("*").alias("pairs"), *[F.count_if(c).alias(c) for c in flags], F.max("vr_threshold").alias("vr_threshold"), F.max("bstar_threshold").alias("bstar_threshold"))

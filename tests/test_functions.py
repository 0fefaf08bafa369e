from __future__ import annotations

import math
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from orrery.functions import atmosphere, frames, labels, sensors, times, tle


def _one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_times_in_four_forms_and_none_else(spark):
    rows = [("2024-01-02T03:04:05",), ("2024-01-02T03:04:05.25",), ("2024-01-02 03:04:05",), ("2024-01-02 03:04:05.000001",), ("2024-01-02",), ("x",), (None,), ("2024-13-02T00:00:00",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(times.parse_time(F.col("t"))).collect()]
    assert got == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 250000), datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 1), None, None, None, None]


def test_fraction_of_the_last_second_is_after_the_text_bound(spark):
    got = _one(spark, times.until_end_of("2024-01-05", F.lit("2024-01-05T23:59:59")), times.until_end_of("2024-01-05", F.lit("2024-01-05T23:59:59.5")))
    assert got == (True, False)


def test_julian_keeps_microseconds(spark):
    jd, fr = times.julian(F.lit("2000-01-01 12:00:00.000001").cast("timestamp_ntz"))
    got = _one(spark, jd, fr)
    assert got[0] == 2451544.5 and got[1] * 86400e6 == 43200e6 + 1


def test_two_digit_years_turn_at_57(spark):
    line = "1 00005U 58002B   {}.50000000  .00000023  00000-0  28098-4 0  4753"
    got = _one(spark, *[times.tle_epoch(F.lit(line.format(x))) for x in ("56001", "57001", "00179", "xx179")])
    assert got == (datetime(2056, 1, 1, 12), datetime(1957, 1, 1, 12), datetime(2000, 6, 27, 12), None)


def test_drag_field(spark):
    line = lambda x: F.lit("1" + " " * 52 + x + " 0    1")
    got = _one(spark, tle.bstar(line(" 28098-4")), tle.bstar(line("-11606-4")), tle.bstar(line(" 00000-0")), tle.bstar(line(" 2xx98-4")), tle.bstar(F.lit(None).cast("string")), tle.bstar(F.lit("1")))
    assert np.allclose(got[:4], [0.28098e-4, -0.11606e-4, 0, 0]) and got[4] is None and got[5] == 0.0


def test_aperture_takes_the_first_length_only(spark):
    got = _one(spark, *[sensors.aperture_m(F.lit(x)) for x in ("0.5m telescope", "64m dish, 2.6m", "2.6 m", "10m", "0.05m", None)])
    assert got == (0.5, None, 2.6, 10.0, None, None)


def test_azimuth_mask_through_north(spark):
    lit = lambda *x: [F.lit(float(v)) for v in x]
    got = _one(spark, sensors.azimuth_open(*lit(350, 300, 20)), sensors.azimuth_open(*lit(10, 300, 20)), sensors.azimuth_open(*lit(100, 300, 20)), sensors.azimuth_open(*lit(100, 20, 300)))
    assert got == (True, True, False, True)


def test_zero_counts_as_not_given(spark):
    assert _one(spark, sensors.or_default(F.lit(0.0), -180.0), sensors.or_default(F.lit(None).cast("double"), 90.0), sensors.or_default(F.lit(5.0), 1.0)) == (-180.0, 90.0, 5.0)


def test_a_missing_index_is_not_disturbed(spark):
    nan, none = F.lit(float("nan")), F.lit(None).cast("double")
    assert _one(spark, labels.disturbed(nan), labels.disturbed(none), labels.disturbed(F.lit(5.0)), labels.above(nan, F.lit(1.0)), labels.above(F.lit(float("inf")), F.lit(1.0))) == (False, False, True, False, False)


def test_classification(spark):
    t, f = F.lit(True), F.lit(False)
    assert _one(spark, labels.classification(t, f), labels.classification(t, t), labels.classification(f, t)) == ("confirmed", "uncertain", None)


def test_density_columns_equal_arrays(spark):
    alts = [-5.0, 0.0, 24.9, 25.0, 99.0, 399.0, 400.0, 1500.0]
    rows = spark.createDataFrame([(a,) for a in alts], "a double").select(atmosphere.density(F.col("a"))).collect()
    assert np.allclose([r[0] for r in rows], atmosphere.density_array(np.array(alts)), rtol=1e-12)


def test_overhead_is_ninety_degrees(spark):
    lat, lon = F.lit(40.0), F.lit(-75.0)
    site = frames.geodetic(lat, lon, F.lit(0.0))
    above = frames.geodetic(lat, lon, F.lit(500_000.0))
    az, el, slant = frames.look(above, site, lat, lon)
    got = _one(spark, el, slant)
    assert abs(got[0] - 90) < 1e-4 and abs(got[1] - 500) < 1e-6


def test_orbit_frame_is_orthonormal(spark):
    v = lambda *x: tuple(F.lit(float(c)) for c in x)
    r, t, n = frames.radial_along_cross(v(7000, 100, 5), v(0.1, 7.5, 1.0), v(3, -4, 12))
    assert math.isclose(sum(x * x for x in _one(spark, r, t, n)), 169.0, rel_tol=1e-12)

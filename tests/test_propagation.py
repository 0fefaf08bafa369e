"""Propagation against published vectors (AIAA 2006-6753) and invariants."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.kernels import kepler, rk4
from orrery.kernels.sgp4 import UNREADABLE, elements
from orrery.operators import propagate

NEAR = ("1 00005U 58002B   00179.78495062  .00000023  00000-0  28098-4 0  4753", "2 00005  34.2682 348.7242 1859667 331.7664  19.3264 10.82419157413667")
LOW = ("1 88888U          80275.98708465  .00073094  13844-3  66816-4 0    8 ", "2 88888  72.8435 115.9689 0086731  52.6988 110.5714 16.05824518  105")
DEEP = ("1 11801U          80230.29629788  .01431103  00000-0  14311-1      13", "2 11801  46.7916 230.4354 7318036  47.4722  10.4117  2.28537848    13")


@pytest.mark.parametrize(
    ("lines", "minutes", "position", "velocity"),
    [
        (NEAR, 0.0, (7022.46529266, -1400.08296755, 0.03995155), (1.893841015, 6.405893759, 4.534807250)),
        (NEAR, 360.0, (-7154.03120202, -3783.17682504, -3536.19412294), (4.741887409, -4.151817765, -2.093935425)),
        (LOW, 0.0, (2328.96975262, -5995.22051338, 1719.97297192), (2.912073281, -0.983417956, -7.090816210)),
        (DEEP, 0.0, (7473.37102491, 428.94748312, 5828.74846783), (5.107155391, 6.444680305, -0.186133297)),
        (DEEP, 1440.0, (9787.87836256, 33753.32249667, -15030.79874625), (-1.094251553, 0.923589906, -1.522311008)),
    ],
)
def test_published_vectors(lines, minutes, position, velocity):
    error, r, v = elements([lines[0]], [lines[1]]).propagate(np.array([minutes]))
    assert error[0, 0] == 0 and np.allclose(r[0, 0], position, atol=1e-6) and np.allclose(v[0, 0], velocity, atol=1e-8)


def test_many_at_once_equal_one_at_a_time():
    lines = [NEAR, LOW, DEEP]
    t = np.linspace(-2000, 4000, 13)
    _, r, v = elements(*map(list, zip(*lines, strict=True))).propagate(t)
    for i, (a, b) in enumerate(lines):
        _, r1, v1 = elements([a], [b]).propagate(t)
        assert np.allclose(r[i], r1[0], atol=1e-9, equal_nan=True) and np.allclose(v[i], v1[0], atol=1e-12, equal_nan=True)


def test_resonant_orbits_stay_bound():
    """Synchronous and half-day orbits, ten days both ways."""
    sync = ("1 00001U 24001A   24001.50000000  .00000000  00000-0  00000-0 0    1", "2 00001   0.0500  75.0000 0003000  10.0000  20.0000  1.00270000    1")
    half = ("1 00002U 24001A   24001.50000000  .00000000  00000-0  00000-0 0    1", "2 00002  63.4000  75.0000 7200000 270.0000  20.0000  2.00600000    1")
    error, r, _ = elements([sync[0], half[0]], [sync[1], half[1]]).propagate(np.linspace(-14400, 14400, 97))
    d = np.linalg.norm(r, axis=-1)
    assert (error == 0).all() and (np.abs(d[0] - 42165) < 60).all() and (d[1] > 6900).all() and (d[1] < 46500).all()


def test_unreadable_lines_are_errors_not_exceptions():
    error, r, _ = elements([None, "1 x", NEAR[0]], ["2", "2 y", None]).propagate(np.array([0.0]))
    assert (error == UNREADABLE).all() and np.isnan(r).all()


def test_kepler_keeps_energy_and_period():
    a, e = 7000.0, 0.1
    t = np.linspace(0, 2 * np.pi * np.sqrt(a**3 / kepler.MU), 50)
    s = kepler.states(a, e, 0.5, 1.0, 2.0, 0.3, t)
    energy = (s[:, 3:] ** 2).sum(1) / 2 - kepler.MU / np.linalg.norm(s[:, :3], axis=1)
    assert np.allclose(energy, -kepler.MU / 2 / a, rtol=1e-12) and np.allclose(s[0], s[-1], atol=1e-6)


def test_numerical_orbit_without_perturbations_is_kepler(monkeypatch):
    monkeypatch.setattr(rk4, "J2", 0.0)
    s0 = kepler.states(7000.0, 0.01, 0.9, 0.1, 0.2, 0.3, np.zeros(2))
    out = rk4.propagate(s0, np.zeros(2), np.array([600.0, 3000.0]))
    want = np.stack([kepler.states(7000.0, 0.01, 0.9, 0.1, 0.2, 0.3, t) for t in (600.0, 3000.0)])
    assert np.allclose(out[:, :3], want[:, :3], atol=1e-3)


def test_node_turns_as_the_flattening_says():
    """Mean rate of the node over a day: -1.5 J2 (R/p)^2 n cos i."""
    a, i = 7000.0, 0.9
    n = np.sqrt(rk4.MU / a**3)
    period = 2 * np.pi / n
    turns = 12
    s0 = kepler.states(a, 1e-4, i, 0.5, 0.0, 0.0, np.zeros(1))
    s1 = rk4.propagate(s0, np.zeros(1), np.array([turns * period]))
    node = lambda s: np.arctan2(*(np.cross(s[0, :3], s[0, 3:])[[0, 1]] * [1, -1]))
    rate = -1.5 * rk4.J2 * (rk4.RADIUS / a) ** 2 * n * np.cos(i)
    assert abs((node(s1) - node(s0)) / (turns * period) / rate - 1) < 0.02


def test_zero_time_is_the_identity(spark):
    rows = spark.createDataFrame([(*NEAR, 0.0), (*LOW, 0.0), ("x", None, 0.0)], "a string, b string, s double")
    got = rows.select(propagate.residual(F.col("a"), F.col("b"), F.lit(1e-4), F.col("s"), F.col("a"), F.col("b"), "wgs84").alias("r")).collect()
    assert [(r.r.km, r.r.m_s) for r in got[:2]] == [(0.0, 0.0)] * 2
    assert got[2].r.km is None or np.isnan(got[2].r.km)


START = datetime(2024, 1, 1, 12)


def _objects(spark, n=30):
    from orrery.plans.tables import element_lines

    return element_lines(spark, "/root/testdata/sf0.001").filter(f"NORAD_CAT_ID <= {n}")


def test_state_at_a_time_is_the_state_after_it(spark):
    at = F.lit(START + timedelta(minutes=90)).cast("timestamp_ntz")
    rows = _objects(spark).select(propagate.state_after(F.col("TLE_LINE1"), F.col("TLE_LINE2"), F.lit(5400.0)).alias("a"), propagate.state_at(F.col("TLE_LINE1"), F.col("TLE_LINE2"), at).alias("b")).collect()
    assert rows and all(np.allclose(tuple(r.a), tuple(r.b), atol=1e-4) for r in rows)


def test_passes_equal_those_of_columns(spark):
    """The kernel's passes are the islands of elevations computed with column functions."""
    from orrery.functions import frames, times
    from orrery.operators import windows

    sensor = {"SENSOR_ID": 1, "LAT": 40.0, "LON": 10.0, "ALT_M": 100.0, "MIN_EL_DEG": 5.0, "MIN_RANGE_KM": 0.0, "MAX_RANGE_KM": 3000.0}
    objects, end = _objects(spark), START + timedelta(hours=3)
    got = propagate.visibility(objects, [sensor], START, end).collect()
    t = propagate.trajectories(objects, START, end, 30.0)
    lat, lon = F.lit(40.0), F.lit(10.0)
    e = frames.rotate((F.col("x"), F.col("y"), F.col("z")), times.gmst(*times.julian(F.col("t"))))
    _, el, slant = frames.look(e, frames.geodetic(lat, lon, F.lit(100.0)), lat, lon)
    seen = t.select("NORAD_CAT_ID", "t", el.alias("el"), slant.alias("sl"), ((el >= 5) & (slant <= 3000)).alias("v"))
    want = windows.passes(seen, ["NORAD_CAT_ID"], "t", "v", "el", "sl", 30.0).collect()
    key = lambda rows: sorted((r.NORAD_CAT_ID, r.aos, r.los, round(r.max_el_deg, 4), round(r.min_range_km, 3)) for r in rows)
    assert key(got) == key(want) and len(got) > 5


def test_an_object_meets_its_twin(spark):
    rows = _objects(spark, 1).filter("NORAD_CAT_ID = 1").select(F.lit(1).alias("id1"), F.col("TLE_LINE1").alias("line11"), F.col("TLE_LINE2").alias("line12"), F.lit(2).alias("id2"), F.col("TLE_LINE1").alias("line21"), F.col("TLE_LINE2").alias("line22"))
    [e] = propagate.conjunctions(rows, START, START + timedelta(minutes=30)).collect()
    assert e.miss_dist_km == 0.0 and e.tca == START - timedelta(seconds=60)
    near = propagate.pair_approach(rows.withColumn("tca", F.lit(START + timedelta(minutes=5)).cast("timestamp_ntz"))).first()
    assert near.sgp4_miss_km == 0.0 and near.sgp4_rel_speed_km_s == 0.0


def test_closest_approach_equals_dense_sampling(spark):
    lines = {r.NORAD_CAT_ID: (r.TLE_LINE1, r.TLE_LINE2) for r in _objects(spark, 60).collect()}
    one = lines[1]
    rows = spark.createDataFrame([(1, *one, k, *v) for k, v in lines.items() if k != 1], "id1 long, line11 string, line12 string, id2 long, line21 string, line22 string")
    end = START + timedelta(hours=6)
    got = {(r.id2, r.tca): r.miss_dist_km for r in propagate.conjunctions(rows, START, end, warn_km=300.0, dense=True).collect()}
    assert got
    for (k, tca), miss in got.items():
        t = np.arange(-600.0, 600.0, 1.0)
        minutes = ((tca - START).total_seconds() + t) / 60.0
        a, b = (elements([x[0]], [x[1]]).propagate(minutes)[1][0] for x in (one, lines[k]))
        assert np.sqrt(((a - b) ** 2).sum(-1)).min() <= miss + 1e-6


def test_access_equals_a_search_one_by_one(spark):
    """The windows of a batch are those of each object and sensor alone, with bisections in floats."""
    from orrery.kernels import geometry
    from orrery.sources.parameters import stations

    sensors = stations([("A", 40.0, 10.0), ("B", -20.0, 100.0)], MAX_RANGE_KM=2500.0, AZ_MIN_DEG=300.0, AZ_MAX_DEG=120.0)
    end = START + timedelta(hours=5)
    objects = _objects(spark).selectExpr("NORAD_CAT_ID AS norad_id", "OBJECT_NAME AS name", "TLE_LINE1", "TLE_LINE2")
    got = sorted((r.sensor, r.norad_id, r.t_aos, r.t_los) for r in propagate.access(objects.repartition(2), sensors, START, end).collect())
    want = []
    for o in objects.collect():
        one = elements([o.TLE_LINE1], [o.TLE_LINE2])
        for s in sensors:
            place = geometry.site(s["LAT"], s["LON"], s["ALT_M"])

            def look(t, one=one, place=place, s=s):
                jd, fr = propagate._julian(np.asarray(t, np.int64))
                return [x[0] for x in geometry.look(geometry.fixed(one.at(jd[None, :], fr[None, :])[1], jd, fr), place, s["LAT"], s["LON"])]

            grid = np.arange(propagate._us(START), propagate._us(end) + 1, 30_000_000)
            up = look(grid)[1] >= 5.0
            for first, after in geometry.runs(up):
                if not first or after == len(grid):
                    continue
                edges = []
                for lo, hi, begun in ((grid[first - 1], grid[first], False), (grid[after - 1], grid[after], True)):
                    while hi - lo > 1000:
                        mid = (lo + hi) // 2
                        lo, hi = (mid, hi) if (look([mid])[1][0] >= 5.0) == begun else (lo, mid)
                    edges.append(int(hi))
                us = np.linspace(*edges, max(2, int((edges[1] - edges[0]) / 15e6) + 1)).round().astype(np.int64)
                az, el, slant = look(us)
                for i, j in geometry.runs((slant <= 2500.0) & ((az >= 300.0) | (az <= 120.0)) & (el >= 5.0 - 1e-6)):
                    at = lambda t: datetime(1970, 1, 1) + timedelta(microseconds=int(t))
                    want.append((s["NAME"], o.norad_id, at(us[i]), at(us[j - 1] if j - 1 > i else us[i] + 15_000_000)))
    near = lambda a, b: a[:2] == b[:2] and all(abs(x - y) < timedelta(milliseconds=2) for x, y in zip(a[2:], b[2:], strict=True))
    assert len(got) > 10 and len(got) == len(want) and all(near(a, b) for a, b in zip(got, sorted(want), strict=True))

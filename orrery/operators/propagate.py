"""Propagation of element sets as DataFrame operators.

What filters and joins can say stays in Spark; only the propagation itself runs
in Arrow batches of numpy.  Filter before calling these: Spark cannot push a
filter through them.  An element set that cannot be read or propagated gives
null states, never an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import micros, seconds_between
from ..kernels import geometry, kepler, rk4
from ..kernels.sgp4 import elements
from .joins import asof

STATE = "struct<x:double,y:double,z:double,vx:double,vy:double,vz:double>"
_NAMES = ["x", "y", "z", "vx", "vy", "vz"]
#: Samples of a batch of trajectories held at once.
AT_ONCE = 2_000_000


def _julian(us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    day = np.floor_divide(us, 86_400_000_000)
    return day + 2440587.5, (us - day * 86_400_000_000) / 86_400e6


def _frame(r: np.ndarray, v: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame(np.concatenate([r, v], 1), columns=_NAMES)


def state_after(line1: Column, line2: Column, seconds: Column, model: str = "wgs72") -> Column:
    """State at an offset from the set's epoch; fields are null where propagation fails."""

    @F.pandas_udf(STATE)
    def run(a: pd.Series, b: pd.Series, s: pd.Series) -> pd.DataFrame:
        _, r, v = elements(a.tolist(), b.tolist(), model).propagate(s.to_numpy(float)[:, None] / 60.0)
        return _frame(r[:, 0], v[:, 0])

    return run(line1, line2, seconds)


def state_at(line1: Column, line2: Column, time: Column, model: str = "wgs72") -> Column:
    """State at an absolute time."""

    @F.pandas_udf(STATE)
    def run(a: pd.Series, b: pd.Series, us: pd.Series) -> pd.DataFrame:
        jd, fr = _julian(us.fillna(0).to_numpy(np.int64))
        _, r, v = elements(a.tolist(), b.tolist(), model).at(jd[:, None], fr[:, None])
        gone = us.isna().to_numpy()
        r[gone], v[gone] = np.nan, np.nan
        return _frame(r[:, 0], v[:, 0])

    return run(line1, line2, micros(time))


def residual(line1: Column, line2: Column, bstar: Column, seconds: Column, next1: Column, next2: Column, model: str = "wgs84", numerical: bool = True, physical: bool = False) -> Column:
    """How far a set, carried to the next set's epoch, is from it: struct of km and m_s, null if either fails.

    numerical: carried by Runge-Kutta from its state at epoch; else by SGP4.
    """

    @F.pandas_udf("struct<km:double,m_s:double>")
    def run(a: pd.Series, b: pd.Series, drag: pd.Series, s: pd.Series, c: pd.Series, d: pd.Series) -> pd.DataFrame:
        now, then = elements(a.tolist(), b.tolist(), model), elements(c.tolist(), d.tolist(), model)
        zero, t = np.zeros((len(a), 1)), s.to_numpy(float)
        if numerical:
            _, r, v = now.propagate(zero)
            moved = rk4.propagate(np.concatenate([r[:, 0], v[:, 0]], 1), drag.fillna(0).to_numpy(float) / rk4.RADIUS / 1000.0, np.nan_to_num(t), physical)
        else:
            _, r, v = now.propagate(t[:, None] / 60.0)
            moved = np.concatenate([r[:, 0], v[:, 0]], 1)
        _, r, v = then.propagate(zero)
        return pd.DataFrame({"km": np.linalg.norm(moved[:, :3] - r[:, 0], axis=1), "m_s": np.linalg.norm(moved[:, 3:] - v[:, 0], axis=1) * 1000})

    return run(line1, line2, bstar, seconds, next1, next2)


def ellipse_state(a_km: Column, eccentricity: Column, inclination: Column, node: Column, perigee: Column, mean: Column, seconds: Column) -> Column:
    """State on a fixed ellipse after some seconds; angles in radians."""

    @F.pandas_udf(STATE)
    def run(a: pd.Series, e: pd.Series, i: pd.Series, o: pd.Series, w: pd.Series, m: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(kepler.states(*(x.to_numpy(float) for x in (a, e, i, o, w, m, t))), columns=_NAMES)

    return run(*[c.cast("double") for c in (a_km, eccentricity, inclination, node, perigee, mean, seconds)])


def numerical_state(state: Column, drag: Column, seconds: Column, physical: bool = False) -> Column:
    """A state (a struct of six) carried by Runge-Kutta; drag is B* in 1 / Earth radii."""

    @F.pandas_udf(STATE)
    def run(s: pd.DataFrame, d: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(rk4.propagate(s[_NAMES].to_numpy(float), d.fillna(0).to_numpy(float) / rk4.RADIUS / 1000.0, t.to_numpy(float), physical), columns=_NAMES)

    return run(state, drag.cast("double"), seconds.cast("double"))


def _us(t: datetime) -> int:
    return round((t.replace(tzinfo=None) - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def trajectories(objects: DataFrame, start: datetime, end: datetime, step_s: float, line1: str = "TLE_LINE1", line2: str = "TLE_LINE2", key: str = "NORAD_CAT_ID", model: str = "wgs72") -> DataFrame:
    """(key, t, x .. vz) of every object at every step, ends included; objects are dealt out in batches."""
    grid = np.arange(_us(start), _us(end) + 1, round(step_s * 1e6))
    jd, fr = _julian(grid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, AT_ONCE // max(1, len(grid)))
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                error, r, v = elements(part.column(1).to_pylist(), part.column(2).to_pylist(), model).at(jd[None, :], fr[None, :])
                good = error == 0
                owner, when = np.nonzero(good)
                both = np.concatenate([r[good], v[good]], 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), pa.array(grid[when]).cast(pa.timestamp("us")), *[pa.array(np.ascontiguousarray(both[:, i])) for i in range(6)]], ["key", "t", *_NAMES])

    rows = objects.select(F.col(key).alias("key"), line1, line2)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, t timestamp_ntz, x double, y double, z double, vx double, vy double, vz double").withColumnRenamed("key", key)


def visibility(objects: DataFrame, sensors: list[dict], start: datetime, end: datetime, step_s: float = 30.0, least_s: float = 10.0, line1: str = "TLE_LINE1", line2: str = "TLE_LINE2", key: str = "NORAD_CAT_ID", model: str = "wgs72") -> DataFrame:
    """Passes of every object over every sensor that reaches its altitudes.

    An object is propagated once for all sensors (a stated, small set) and only
    passes leave the task: (key, sensor, aos, los, max_el_deg, max_el_time,
    min_range_km, duration_s).  los is one step after the last visible sample.
    """
    steps = int((end - start).total_seconds() / step_s) + 1
    grid = _us(start) + (np.arange(steps) * round(step_s * 1e6)).astype(np.int64)
    jd, fr = _julian(grid)
    places = [(s, geometry.site(s["LAT"], s["LON"], s["ALT_M"]), max(0.0, s["MIN_RANGE_KM"] * np.sin(np.radians(s["MIN_EL_DEG"])))) for s in sensors]
    kinds = [pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.float64(), pa.timestamp("us"), pa.float64(), pa.float64()]
    names = ["sensor", "aos", "los", "max_el_deg", "max_el_time", "min_range_km", "duration_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, AT_ONCE // steps)
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                peri, apo = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                error, r, _ = elements(part.column(1).to_pylist(), part.column(2).to_pylist(), model).at(jd[None, :], fr[None, :])
                ground = geometry.fixed(r, jd, fr)
                owner, rows = [], []
                for s, place, least in places:
                    _, el, slant = geometry.look(ground, place, s["LAT"], s["LON"])
                    seen = (error == 0) & (el >= s["MIN_EL_DEG"]) & (slant <= s["MAX_RANGE_KM"])
                    seen &= ((peri <= s["MAX_RANGE_KM"]) & (apo >= least))[:, None]
                    for i in np.flatnonzero(seen.any(1)).tolist():
                        for a, b in geometry.runs(seen[i]):
                            if (b - a) * step_s < least_s:
                                continue
                            best = a + int(np.argmax(el[i, a:b]))
                            owner.append(i)
                            rows.append((s["SENSOR_ID"], grid[a], grid[a] + (b - a) * round(step_s * 1e6), el[i, best], grid[best], slant[i, a:b].min(), (b - a) * step_s))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *[pa.array([int(x[j]) if pa.types.is_timestamp(k) else x[j] for x in rows], k) for j, k in enumerate(kinds)]], ["key", *names])

    rows = objects.select(F.col(key).alias("key"), line1, line2, F.col("PERIAPSIS").cast("double"), F.col("APOAPSIS").cast("double"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, sensor long, aos timestamp_ntz, los timestamp_ntz, max_el_deg double, max_el_time timestamp_ntz, min_range_km double, duration_s double").withColumnRenamed("key", key)


def _refine(one, two, lo: int, hi: int, step: int) -> tuple | None:
    """The closest of the samples from lo to hi: time, distance, relative speed, both states."""
    grid = np.arange(lo, hi + 1, step)
    jd, fr = _julian(grid)
    (e1, r1, v1), (e2, r2, v2) = one.at(jd[None, :], fr[None, :]), two.at(jd[None, :], fr[None, :])
    gap = np.sqrt(((r1 - r2) ** 2).sum(-1))[0]
    gap[(e1[0] != 0) | (e2[0] != 0)] = np.inf
    if not len(gap) or not np.isfinite(gap).any():
        return None
    k = int(np.argmin(gap))
    return int(grid[k]), float(gap[k]), float(np.linalg.norm(v1[0, k] - v2[0, k])), r1[0, k].tolist(), r2[0, k].tolist(), v2[0, k].tolist()


def conjunctions(pairs: DataFrame, start: datetime, end: datetime, warn_km: float = 25.0, trigger_km: float = 100.0, coarse_s: int = 60, fine_s: int = 5, dense: bool = False, model: str = "wgs72") -> DataFrame:
    """Close approaches of pairs (id1, line11, line12, id2, line21, line22).

    Coarse samples within the trigger form windows (a failed sample does not
    end one); each window, a coarse step wider on both sides, is searched in
    fine steps.  (id1, id2, tca, miss_dist_km, rel_speed_km_s, r1, r2, v2).

    dense: widen the trigger to what two objects can cover in half a coarse
    step, so that no approach falls between two samples.
    """
    reach = trigger_km + (16.0 * coarse_s / 2 if dense else 0.0)
    grid = np.arange(_us(start), _us(end) + 1, coarse_s * 1_000_000)
    jd, fr = _julian(grid)
    vector = pa.list_(pa.float64())

    def events(a1: str, a2: str, b1: str, b2: str, known: dict) -> list[tuple]:
        if (a1, a2) not in known:
            known.clear()  # pairs of a primary come together
            primary = elements([a1], [a2], model)
            known[a1, a2] = primary, *primary.at(jd[None, :], fr[None, :])[:2]
        primary, e1, r1 = known[a1, a2]
        other = elements([b1], [b2], model)
        e2, r2, _ = other.at(jd[None, :], fr[None, :])
        good = np.flatnonzero((e1[0] == 0) & (e2[0] == 0))
        near = np.sqrt(((r1[0, good] - r2[0, good]) ** 2).sum(-1)) < reach
        out = []
        for a, b in geometry.runs(near):
            last = grid[good[b]] if b < len(good) else grid[-1]
            found = _refine(primary, other, int(grid[good[a]]) - coarse_s * 1_000_000, int(last) + coarse_s * 1_000_000, fine_s * 1_000_000)
            if found and found[1] < warn_km:
                out.append(found)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            owner, rows = [], []
            for i, (a1, a2, b1, b2) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 4, 5)), strict=True)):
                found = events(a1, a2, b1, b2, known)
                owner += [i] * len(found)
                rows += found
            take = pa.array(owner, pa.int64())
            kinds = [pa.timestamp("us"), pa.float64(), pa.float64(), vector, vector, vector]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(3).take(take), *[pa.array([x[j] for x in rows], k) for j, k in enumerate(kinds)]], ["id1", "id2", "tca", "miss_dist_km", "rel_speed_km_s", "r1", "r2", "v2"])

    rows = pairs.select("id1", "line11", "line12", "id2", "line21", "line22").sortWithinPartitions("id1")
    k1, k2 = (rows.schema[c].dataType.simpleString() for c in ("id1", "id2"))
    return rows.mapInArrow(run, f"id1 {k1}, id2 {k2}, tca timestamp_ntz, miss_dist_km double, rel_speed_km_s double, r1 array<double>, r2 array<double>, v2 array<double>")


def pair_approach(pairs: DataFrame, window_min: float = 10.0, coarse_s: int = 5, around_s: int = 30, fine_s: int = 1, model: str = "wgs72") -> DataFrame:
    """The closest approach of each pair around its `tca`: all columns, and sgp4_tca, sgp4_miss_km, sgp4_rel_speed_km_s, r1, r2 (null if it cannot be had)."""
    own = pairs.columns
    half = round(window_min * 60e6)
    fields = [("sgp4_tca", pa.timestamp("us")), ("sgp4_miss_km", pa.float64()), ("sgp4_rel_speed_km_s", pa.float64()), ("r1", pa.list_(pa.float64())), ("r2", pa.list_(pa.float64()))]

    def search(a1, a2, b1, b2, at) -> tuple:
        none = (None,) * 5
        if at is None:
            return none
        one, two = elements([a1], [a2], model), elements([b1], [b2], model)
        rough = _refine(one, two, at - half, at + half, coarse_s * 1_000_000)
        middle = at - half if rough is None else rough[0]
        best = _refine(one, two, middle - around_s * 1_000_000, middle + around_s * 1_000_000, fine_s * 1_000_000)
        return best[:5] if best else none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [batch.column(len(own) + i).to_pylist() for i in range(5)]
            rows = [search(*x) for x in zip(*lines, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *[pa.array([x[j] for x in rows], k) for j, (_, k) in enumerate(fields)]], [*own, *[n for n, _ in fields]])

    rows = pairs.select("*", F.col("line11").alias("__a"), F.col("line12").alias("__b"), F.col("line21").alias("__c"), F.col("line22").alias("__d"), micros(F.col("tca")).alias("__t"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
    return rows.mapInArrow(run, f"{kinds}, sgp4_tca timestamp_ntz, sgp4_miss_km double, sgp4_rel_speed_km_s double, r1 array<double>, r2 array<double>")


def distance_profile(pairs: DataFrame, window_min: float = 10.0, step_s: float = 5.0, model: str = "wgs72") -> DataFrame:
    """(columns of pairs, offset_s, km): distance at each step around `tca`."""
    n = int(window_min * 60 / step_s)
    grid = pairs.withColumn("offset_s", F.explode(F.array(*[F.lit(float(i * step_s)) for i in range(-n, n + 1)])))
    at = F.timestamp_add("MICROSECOND", F.round(F.col("offset_s") * 1e6).cast("long"), F.col("tca"))
    both = grid.withColumn("__1", state_at(F.col("line11"), F.col("line12"), at, model)).withColumn("__2", state_at(F.col("line21"), F.col("line22"), at, model))
    return both.withColumn("km", _apart(F.col("__1"), F.col("__2"))).filter(F.col("km").isNotNull()).drop("__1", "__2")


def _apart(a: Column, b: Column) -> Column:
    d = F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2) + F.pow(a["z"] - b["z"], 2))
    return F.when(~F.isnan(d), d)


def separation(grid: DataFrame, one: DataFrame, two: DataFrame, by: str = "pair", time: str = "t", refine_km: float = 1.0, step_s: int = 300, fine_s: int = 10, model: str = "wgs72") -> DataFrame:
    """(by, time, sep_km): distance of two objects, each from its most recent element set.

    grid: (by, time); one, two: (by, EPOCH, TLE_LINE1, TLE_LINE2).  Where the
    distance is below refine_km the coarse step before is sampled finely, too.
    """

    def apart(points: DataFrame) -> DataFrame:
        held = points
        for k, rows in (("1", one), ("2", two)):
            held = asof(held, rows, [by], time, "EPOCH", ["TLE_LINE1", "TLE_LINE2"]).withColumnRenamed("prev", f"__{k}")
        held = held.filter(F.col("__1").isNotNull() & F.col("__2").isNotNull())
        states = [state_at(F.col(f"__{k}.TLE_LINE1"), F.col(f"__{k}.TLE_LINE2"), F.col(time), model) for k in ("1", "2")]
        return held.withColumn("__s1", states[0]).withColumn("__s2", states[1]).withColumn("sep_km", _apart(F.col("__s1"), F.col("__s2"))).filter(F.col("sep_km").isNotNull()).select(by, time, "sep_km")

    coarse = apart(grid.select(by, time))
    near = coarse.filter(F.col("sep_km") < refine_km)
    offsets = F.array(*[F.lit(i) for i in range(-step_s + fine_s, 0, fine_s)])
    between = near.select(by, time, F.explode(offsets).alias("__off")).select(by, F.timestamp_add("SECOND", F.col("__off"), F.col(time)).alias(time))
    return coarse.unionByName(apart(between)).dropDuplicates([by, time])


def time_grid(spark, start: datetime, end: datetime, step_s: float) -> DataFrame:
    """Times from start to end, both included, as column t."""
    n = int((end - start).total_seconds() / step_s) + 1
    first = F.lit(start.replace(tzinfo=None)).cast("timestamp_ntz")
    return spark.range(n).select(F.timestamp_add("MICROSECOND", (F.col("id") * round(step_s * 1e6)).cast("long"), first).alias("t"))


def access(objects: DataFrame, sensors: list[dict], start: datetime, end: datetime, scan_s: float = 30.0, sample_s: float = 15.0, line1: str = "TLE_LINE1", line2: str = "TLE_LINE2", key: str = "norad_id", name: str = "name", model: str = "wgs72") -> DataFrame:
    """Windows (sensor, key, name, t_aos, t_los) in which a sensor can track an object.

    Rises and sets of the least elevation are bracketed by a scan and found by
    bisection; within a pass samples decide on range, azimuth mask and
    elevation.  Objects must be usable; sensors are a stated, small set.  An
    object is propagated over the scan once for all sensors, and all brackets
    and all passes of a batch of objects are worked on together.
    """
    grid = np.arange(_us(start), _us(end) + 1, round(scan_s * 1e6))
    jd, fr = _julian(grid)
    places = [(s, geometry.site(s["LAT"], s["LON"], s["ALT_M"])) for s in sensors]
    Lines = list[tuple[str, str]]

    def seen(lines: Lines, place: np.ndarray, s: dict, us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Elevation, azimuth and range of each object at its row of times."""
        day, part = _julian(us)
        error, r, _ = elements([x[0] for x in lines], [x[1] for x in lines], model).at(day, part)
        az, el, slant = geometry.look(geometry.fixed(r, day, part), place, s["LAT"], s["LON"])
        return np.where(error == 0, el, -90.0), az, np.where(error == 0, slant, np.inf)

    def crossings(lines: Lines, place: np.ndarray, s: dict, lo: np.ndarray, hi: np.ndarray, up: bool) -> np.ndarray:
        """Between lo, where an object is up or not, and hi, where that has changed, to a millisecond."""
        while len(lo) and (hi - lo).max() > 1000:
            mid = (lo + hi) // 2
            still = ((seen(lines, place, s, mid[:, None])[0][:, 0] >= s["MIN_EL_DEG"]) == up) & (hi - lo > 1000)
            lo, hi = np.where(still, mid, lo), np.where(still | (hi - lo <= 1000), hi, mid)
        return hi

    def passes(up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(object, last sample before it rises, last sample before it sets); a pass that is under way at either end has no rise or no set."""
        change = np.diff(up.astype(np.int8), axis=1)
        (i, rise), (j, fall) = np.nonzero(change == 1), np.nonzero(change == -1)
        whole = ~(np.append(i[1:] != i[:-1], True)[: len(i)] & up[i, -1])
        begun = ~(np.append(True, j[1:] != j[:-1])[: len(j)] & up[j, 0])
        return i[whole], rise[whole], fall[begun]

    def tracked(lines: Lines, place: np.ndarray, s: dict, rise: np.ndarray, fall: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(pass, from, to) of what range, mask and elevation leave of each pass."""
        count = np.maximum(2, ((fall - rise) / 1e6 / sample_s).astype(np.int64) + 1)
        width = max(1, AT_ONCE // max(1, int(count.max(initial=2))))
        for at in range(0, len(rise), width):
            part = slice(at, at + width)
            n = count[part, None]
            j = np.arange(n.max())
            us = np.where(j < n - 1, (rise[part, None] + (fall - rise)[part, None] / (n - 1) * j).round().astype(np.int64), fall[part, None])
            el, az, slant = seen(lines[part], place, s, us)
            lo, hi = s["AZ_MIN_DEG"], s["AZ_MAX_DEG"]
            mask = ((az >= lo) & (az <= hi)) if lo <= hi else ((az >= lo) | (az <= hi))
            good = (slant <= s["MAX_RANGE_KM"]) & mask & (el >= s["MIN_EL_DEG"] - 1e-6) & (j < n)
            for k in np.flatnonzero(good.any(1)).tolist():
                for a, b in geometry.runs(good[k]):
                    yield at + k, int(us[k, a]), int(us[k, b - 1]) if b - 1 > a else int(us[k, a]) + round(sample_s * 1e6)

    def windows(lines: Lines) -> Iterator[tuple[int, str, int, int]]:
        error, r, _ = elements([x[0] for x in lines], [x[1] for x in lines], model).at(jd[None, :], fr[None, :])
        ground = geometry.fixed(r, jd, fr)
        for s, place in places:
            el = np.where(error == 0, geometry.look(ground, place, s["LAT"], s["LON"])[1], -90.0)
            who, rise, fall = passes(el >= s["MIN_EL_DEG"])
            own = [lines[i] for i in who.tolist()]
            up, down = (crossings(own, place, s, grid[t], grid[t + 1], begun) for t, begun in ((rise, False), (fall, True)))
            for k, a, b in tracked(own, place, s, up, down):
                yield int(who[k]), s["NAME"], a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, AT_ONCE // max(1, len(grid)))
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = list(windows(list(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))))
                take = pa.array([x[0] for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows], pa.string()), part.column(0).take(take), part.column(1).take(take), pa.array([x[2] for x in rows], pa.timestamp("us")), pa.array([x[3] for x in rows], pa.timestamp("us"))], ["sensor", key, name, "t_aos", "t_los"])

    rows = objects.select(key, name, line1, line2)
    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"sensor string, `{key}` {kind}, `{name}` string, t_aos timestamp_ntz, t_los timestamp_ntz")


def gap_seconds(a: str, b: str) -> Column:
    return seconds_between(F.col(a), F.col(b))

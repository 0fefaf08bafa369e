from __future__ import annotations

import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from orrery.schemas import GP, GP_HISTORY
from orrery.sources import catalog, orbits, parameters, sensors, weather


def _land(tmp_path, name, value):
    path = tmp_path / name
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def _record(i, **more):
    return {"GP_ID": str(i), "NORAD_CAT_ID": str(100 + i), "EPOCH": "2024-01-02T03:04:05.123456", "BSTAR": "", "ECCENTRICITY": "0.001", "OBJECT_NAME": f"O{i}", "DECAY_DATE": None, "LAUNCH_DATE": "2020-05-06", **more}


def test_records_are_typed_and_blank_is_null(spark, tmp_path):
    path = _land(tmp_path, "gp.json", [_record(2), _record(1), _record(3, DECAY_DATE="2024-01-01")])
    a, b = catalog.elements(spark, path).collect()
    assert (a.GP_ID, b.GP_ID) == (1, 2) and a.BSTAR is None and a.ECCENTRICITY == 0.001 and a.GP_ID_ORIG == 1
    assert a.EPOCH == datetime(2024, 1, 2, 3, 4, 5, 123456) and a.LAUNCH_DATE == date(2020, 5, 6)


def test_a_malformed_number_raises(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|x1"):
        catalog.elements(spark, _land(tmp_path, "bad.json", [_record(1, ECCENTRICITY="x1")])).collect()


def test_an_error_in_place_of_records_raises(spark, tmp_path):
    with pytest.raises(Exception, match="over the limit"):
        catalog.elements(spark, _land(tmp_path, "err.json", [{"error": "over the limit"}])).collect()


def test_backfill_counts_and_only_if_needed(spark, tmp_path):
    path = _land(tmp_path, "h.json", [_record(1, NORAD_CAT_ID="7"), _record(2, NORAD_CAT_ID="7", EPOCH="2024-02-01T00:00:00"), _record(3)])
    empty = spark.createDataFrame([], GP_HISTORY)
    rows, counts = catalog.backfill(spark, empty, path, 7, "2024-01-01", "2024-01-31")
    assert [r.GP_ID for r in rows.collect()] == [1] and tuple(counts.first()) == (1, 0)
    assert tuple(catalog.backfill(spark, rows, path, 7, "2024-01-01", "2024-01-31")[1].first()) == (0, 1)
    assert catalog.backfill_if_needed(spark, rows, path, 7, "2024-01-01", "2024-02-28").count() == 1
    assert catalog.newer(spark, path, "2024-01-15 00:00:00").count() == 1


HEAD = "Sensor Name,Sensor Type,Lat,Lon,Elevation Min,Elevation Max,Azimuth Min,Azimuth Max,Orientation,Country,Organisation,Org Type,Remarks"


def _check_sensors(kept, counts):
    a, b = kept.orderBy("NAME").collect()
    assert tuple(counts.first()) == (2, 1)
    assert (a.NAME, a.TYPE, a.MAX_RANGE_KM, a.MIN_EL_DEG, a.AZ_MIN_DEG, a.MAX_EL_DEG) == ("Big", "RADAR", 5000.0, 10.0, -180.0, 90.0)
    assert (b.NAME, b.TYPE, b.SENSITIVITY, b.AZ_MIN_DEG, b.AZ_MAX_DEG) == ("Eye", "OPTICAL", 18.0, 10.0, 20.0)


ROWS = [["Big", "radar", "1", "2", "", "0", "0", "", "", "X", "", "", "64m dish"], ["", "radar", "1", "2"], ["Lost", "radar", "", "2"], ["Eye", " Optical", "3.5", "-4", "15", "80", "10", "20", "5", "Y", "o", "Civil", "0.5m"]]


def test_sensor_sheet(spark, tmp_path):
    text = "\n".join([HEAD, *(",".join(r + [""] * (13 - len(r))) for r in ROWS)])
    _check_sensors(*sensors.sensors(sensors.read_csv(spark, _land(tmp_path, "s.csv", text))))


def test_sensor_workbook(spark, tmp_path):
    def cell(i, j, v):
        return f'<c r="{chr(65 + j)}{i}" t="inlineStr"><is><t>{v}</t></is></c>' if v else ""

    body = "".join(f"<row>{''.join(cell(i + 1, j, v) for j, v in enumerate(r))}</row>" for i, r in enumerate([HEAD.split(","), *ROWS]))
    path = tmp_path / "s.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{sensors._NS["m"]}"><sheetData>{body}</sheetData></worksheet>')
    _check_sensors(*sensors.sensors(sensors.read_workbook(spark, str(path))))


KP = """# head
2024 01 02 00.0 01.50 33603.0 33603.06 2.333 9 0
2024 01 02 03.0 04.50 33603.1 33603.18 -1.0 9 0
2024 01 02 06.5 07.50 33603.2 33603.31 5.667 9 0
broken line
"""


def test_index_of_three_hours(spark, tmp_path):
    lines = weather.read_text(spark, _land(tmp_path, "kp.txt", KP))
    assert [tuple(r) for r in weather.kp(lines).orderBy("datetime").collect()] == [(datetime(2024, 1, 2), 2.333), (datetime(2024, 1, 2, 6, 30), 5.667)]


def _days(n=100):
    out = ["# daily"]
    for i in range(n):
        d = date.fromordinal(date(2024, 1, 1).toordinal() + i)
        out.append(" ".join(map(str, [d.year, d.month, d.day, 0, 0, 0, 0, *[1.0 + k / 10 for k in range(8)], *[i + k for k in range(8)], 7 + i, 50, 100.0 + i, 1, 2])))
    return "\n".join(out)


def test_daily_file(spark, tmp_path):
    lines = weather.read_text(spark, _land(tmp_path, "d.txt", _days() + "\n2024 05 01 short\n"))
    kp = weather.kp(lines, "daily")
    assert kp.count() == 800 and kp.orderBy("datetime").first().kp == 1.0
    days = weather.daily(lines).orderBy("date").collect()
    assert len(days) == 100 and days[50].f107 == 150.0 and days[50].ap8 == [50.0 + k for k in range(8)] and days[50].ap_daily == 57.0
    assert abs(days[50].f107_81 - 150.0) < 1e-9 and abs(days[0].f107_81 - 120.0) < 1e-9


def test_atmosphere_inputs(spark, tmp_path):
    days = weather.daily(weather.read_text(spark, _land(tmp_path, "d.txt", _days())))
    at = spark.createDataFrame([(datetime(2024, 1, 11, 7),), (datetime(2030, 1, 1),)], "t timestamp_ntz")
    a, b = weather.atmosphere_inputs(at, days, "t").orderBy("t").collect()
    series = {(d, k): d + k for d in range(100) for k in range(8)}
    slot = lambda h: series[(10 * 24 + 7 - h) // 24, (10 * 24 + 7 - h) % 24 // 3]
    want = [17.0, slot(0), slot(3), slot(6), slot(9), sum(slot(h) for h in range(12, 36, 3)) / 8, sum(slot(h) for h in range(36, 60, 3)) / 8]
    assert a.flux == 109.0 and a.ap == pytest.approx(want)
    assert b.ap == [9.0] * 7 and b.flux == 199.0


def test_cache_of_the_index(spark):
    at = lambda *x: datetime(2024, 1, *x)
    old = spark.createDataFrame([(at(1), 1.0), (at(2), 2.0), (at(3), 3.0)], "datetime timestamp_ntz, kp double")
    new = spark.createDataFrame([(at(3), 4.0), (at(3), 4.0), (at(4), 5.0)], "datetime timestamp_ntz, kp double")
    assert [tuple(r) for r in weather.extend(old, new).orderBy("datetime").collect()] == [(at(1), 1.0), (at(2), 2.0), (at(3), 4.0), (at(4), 5.0)]
    now = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp_ntz")
    actions = [weather.freshness(old, now(d)).first().action for d in (4, 9)]
    bad = weather.freshness(old.withColumn("kp", F.lit(11.0)), now(4)).first().action
    assert actions == ["keep", "extend"] and bad == "reload" and weather.freshness(old.limit(0), now(4)).first().action == "reload"
    assert weather.between(new, "2024-01-03", "2024-01-03").count() == 2 and weather.source_kind(2024) == "nowcast"


L1, L2 = "1 25544U 98067A   24001.50000000  .00016717  00000-0  10270-3 0  9005", "2 25544  51.6400 208.9163 0006703  69.9862  25.2906 15.49000000    14"


def test_element_text_finds_its_way_again(spark, tmp_path):
    text = "\n".join(["STATION", L1, L2, "", "stray", L1, L2, L1, L2, "2 lonely", "1 lonely", "END"])
    rows = orbits.tle_text(spark, _land(tmp_path, "t.txt", text)).orderBy("line").collect()
    assert [r.name for r in rows] == ["STATION", "stray", "CATNR 25544"] and rows[0].epoch == datetime(2024, 1, 1, 12)


def test_precise_orbit(spark, tmp_path):
    osv = "".join(f"<OSV><TAI>TAI=x</TAI><UTC>UTC=2024-01-01T00:00:{s:02d}.000000</UTC>" + "".join(f'<{n} unit="m">{v + s}</{n}>' for n, v in zip(("X", "Y", "Z", "VX", "VY", "VZ"), range(6), strict=True)) + "</OSV>" for s in (0, 10))
    a, b = orbits.precise_orbit(spark, _land(tmp_path, "o.EOF", f"<Earth_Explorer_File><Data_Block><List_of_OSVs count='2'>{osv}</List_of_OSVs></Data_Block></Earth_Explorer_File>")).orderBy("utc").collect()
    assert (a.x, a.vz, b.y) == (0.0, 5.0, 11.0) and b.utc == datetime(2024, 1, 1, 0, 0, 10)


def test_messages(spark, tmp_path):
    rows = [{"CDM_ID": "5", "TCA": "2024-01-01T00:00:00.5", "MIN_RNG": "250", "PC": "", "SAT_1_ID": "1", "SAT_1_NAME": " A ", "SAT_2_ID": "2", "SAT_2_NAME": None}]
    [m] = orbits.conjunction_messages(spark, _land(tmp_path, "c.json", rows)).collect()
    assert (m.miss_distance_km, m.collision_probability, m.sat1_name, m.sat2_name, m.sat2_norad) == (0.25, None, "A", "", 2)
    with pytest.raises(Exception, match="no time"):
        orbits.conjunction_messages(spark, _land(tmp_path, "d.json", [{**rows[0], "TCA": "soon"}])).collect()


def test_parameters(spark):
    phases = parameters.mission_phases(spark, "ldpe-3a")
    [span] = parameters.window(phases).select("end", parameters.months(F.col("begin"), F.col("end")).alias("label")).collect()
    assert span.label == "Sep–Nov 2024" and span.end == datetime(2024, 11, 30, 23, 59, 59) and phases.count() == 5
    assert [tuple(r) for r in parameters.mission_objects(spark, "ldpe-3a").collect()] == [("chaser", 55264, "LDPE-3A"), ("target", 55131, "SJ-23")]
    assert len(parameters.stations()) == 3 and len(GP) == 34


def test_an_object_that_runs_ahead_holds_back_no_other(spark, tmp_path):
    rows = lambda sets: [{"GP_ID": str(g), "NORAD_CAT_ID": str(n), "EPOCH": f"2024-01-{d:02d}T00:00:00"} for g, n, d in sets]
    gp = catalog.elements(spark, _land(tmp_path, "full.json", rows([(1, 10, 20), (2, 20, 5)])))
    new = catalog.newer_by_object(spark, _land(tmp_path, "new.json", rows([(3, 10, 19), (4, 20, 6), (5, 30, 1), (2, 20, 5)])), gp)
    assert sorted((r.GP_ID, r.NORAD_CAT_ID) for r in new.collect()) == [(4, 20), (5, 30)] and new.columns == GP.names

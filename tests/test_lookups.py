from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from orrery.__main__ import main, parser
from orrery.operators import lookups, propagate, store
from orrery.plans import reports
from orrery.schemas import GP, SATCAT


def _gp(spark, rows):
    return store.migrate(spark.createDataFrame(rows, "GP_ID long, NORAD_CAT_ID int, OBJECT_NAME string, OBJECT_TYPE string, PERIAPSIS double, APOAPSIS double, TLE_LINE1 string"), GP)


def test_view_has_its_columns_and_keeps_objects_without_metadata(spark):
    gp = _gp(spark, [(1, 10, "A", "DEBRIS", 400.0, 420.0, "1"), (2, 20, "B", None, 500.0, 900.0, None)])
    sat = store.migrate(spark.createDataFrame([(10, "SAT A", "DEB")], "NORAD_CAT_ID int, SATNAME string, OBJECT_TYPE string"), SATCAT)
    view = lookups.catalog_view(gp, sat)
    assert len(view.columns) == 35
    a, b = view.orderBy("NORAD_CAT_ID").collect()
    assert (a.SATNAME, a.GP_OBJECT_TYPE, a.SAT_OBJECT_TYPE) == ("SAT A", "DEBRIS", "DEB") and b.SATNAME is None
    assert lookups.one(view, "NORAD_CAT_ID", 99).count() == 0 and lookups.tle(gp, 10).first().TLE_LINE1 == "1" and lookups.object_name(gp, 20).first()[0] == "B"


def test_band_ends_are_within(spark):
    gp = _gp(spark, [(1, 1, "", "", 400.0, 500.0, "1"), (2, 2, "", "", 430.0, 500.0, "1"), (3, 3, "", "", 430.1, 500.0, "1"), (4, 4, "", "", 300.0, 390.0, "1"), (5, 5, "", "", 300.0, 389.9, "1")])
    assert [r.NORAD_CAT_ID for r in lookups.in_band(gp, 390, 430).orderBy("NORAD_CAT_ID").collect()] == [1, 2, 4]


def test_wild_characters_in_names_are_wild(spark):
    gp = _gp(spark, [(1, 1, "COSMOS 1", "", 0.0, 0.0, None), (2, 2, "cosmos_2", "", 0.0, 0.0, None)])
    assert lookups.first_by_name(gp, "OBJECT_NAME", "s_2", "NORAD_CAT_ID").first().NORAD_CAT_ID == 2
    assert lookups.first_by_name(gp, "OBJECT_NAME", "COS%", "NORAD_CAT_ID").first().NORAD_CAT_ID == 1


def test_statistics_of_empty_tables(spark):
    gp, sat = store.empty(spark, GP), store.empty(spark, SATCAT)
    stats = reports.catalog_stats(gp, gp, sat)
    assert stats["totals"].first().gp_count == 0 and stats["totals"].first().oldest_epoch is None and stats["gp_by_type"].count() == 0


def test_pushdown_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "gp")
    _gp(spark, [(1, 1, "A", "DEBRIS", 1.0, 2.0, None)]).write.parquet(path)
    rows = lookups.in_band(lookups.by_type(spark.read.schema(GP).parquet(path), "DEBRIS"), 0, 5).select("NORAD_CAT_ID")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "(OBJECT_TYPE,DEBRIS)" in plan.split("PushedFilters")[1] and "TLE_LINE1" not in plan.split("ReadSchema")[1]


def test_ellipse_and_numerical_orbit_part_slowly(spark):
    one = spark.range(1)
    angle = [F.lit(x) for x in (7000.0, 0.001, 0.9, 0.1, 0.2, 0.3)]
    at = one.select(propagate.ellipse_state(*angle, F.lit(0.0)).alias("s"), propagate.ellipse_state(*angle, F.lit(300.0)).alias("k"))
    row = at.select("k", propagate.numerical_state(F.col("s"), F.lit(0.0), F.lit(300.0)).alias("n")).first()
    gap = sum((a - b) ** 2 for a, b in zip(row.k[:3], row.n[:3], strict=True)) ** 0.5
    assert 0 < gap < 5


def test_command_line(spark, tmp_path, capsys):
    record = '{"GP_ID": "%d", "NORAD_CAT_ID": "7", "EPOCH": "%s", "OBJECT_NAME": "SEVEN", "OBJECT_TYPE": "PAYLOAD"}'
    one, two, meta = tmp_path / "1.json", tmp_path / "2.json", tmp_path / "m.json"
    one.write_text("[" + record % (1, "2024-01-01T00:00:00") + "]")
    two.write_text("[" + record % (1, "2024-01-01T00:00:00") + "," + record % (2, "2024-01-02T00:00:00") + "]")
    meta.write_text('[{"NORAD_CAT_ID": "7", "COUNTRY": "XX"}]')
    root = ["--store", str(tmp_path / "store")]
    main([*root, "full", "--elements", str(one), "--metadata", str(meta)])
    main([*root, "update", "--elements", str(two), "--metadata", str(meta)])
    main([*root, "status"])
    tables = store.bootstrap(spark, root[1])
    assert [r.GP_ID for r in tables["gp"].collect()] == [2] and [r.GP_ID for r in tables["gp_history"].collect()] == [1]
    assert tables["gp"].first().EPOCH == datetime(2024, 1, 2) and "PAYLOAD" in capsys.readouterr().out
    assert parser().parse_args([*root, "screen", "--name", "x", "--start", "2024-01-01"]).days == 30

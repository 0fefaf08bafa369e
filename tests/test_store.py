from __future__ import annotations

from pyspark.sql import functions as F

from orrery.operators import store
from orrery.schemas import MANEUVERS, SENSOR, TABLES


def _rows(spark, rows):
    return spark.createDataFrame(rows, "GP_ID long, NORAD_CAT_ID int, v string")


def _run(rows):
    return sorted((r.GP_ID, r.NORAD_CAT_ID, r.v) for r in rows.collect())


def test_upsert_replaces_on_either_key(spark):
    stored = _rows(spark, [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")])
    new = _rows(spark, [(4, 10, "d"), (2, 25, "e")]).coalesce(1)
    assert _run(store.upsert_elements(stored, new)) == [(2, 25, "e"), (3, 30, "c"), (4, 10, "d")]


def test_a_row_replaced_later_has_still_replaced(spark):
    """Set 9 pushes out object 10; then object 11 with set 9 pushes that out again."""
    new = spark.createDataFrame([(9, 10, "x", 1), (9, 11, "y", 2)], "GP_ID long, NORAD_CAT_ID int, v string, seq int")
    got = store.upsert(_rows(spark, [(1, 10, "a")]), new.drop("seq"), [["GP_ID"], ["NORAD_CAT_ID"]], F.when(F.col("v") == "x", 1).otherwise(2))
    assert _run(got) == [(9, 11, "y")]


def test_upsert_with_nulls_and_empty_tables(spark):
    none = _rows(spark, []).filter("false")
    some = _rows(spark, [(None, 1, "a"), (None, 2, "b")])
    assert _run(store.upsert_elements(none, none)) == []
    assert len(store.upsert_elements(none, some).collect()) == 2


def test_archive_leaves_out_what_history_has(spark):
    gp = _rows(spark, [(1, 10, "a"), (2, 20, "b"), (3, 30, "c")])
    kept, old = store.archive(gp, _rows(spark, [(1, 10, "old")]), _rows(spark, [(7, 10, ""), (8, 20, "")]))
    assert _run(kept) == [(3, 30, "c")] and _run(old) == [(1, 10, "old"), (2, 20, "b")]


def test_insert_ignore_keeps_the_first(spark):
    new = _rows(spark, [(5, 1, "first"), (5, 1, "second"), (1, 1, "no")]).coalesce(1)
    stored = _rows(spark, [(1, 1, "a")])
    assert _run(store.insert_ignore(stored, new, ["GP_ID"])) == [(1, 1, "a"), (5, 1, "first")]
    assert tuple(store.insert_counts(stored, new, ["GP_ID"]).first()) == (1, 2)


def test_sensor_ids_survive_a_replacement(spark):
    s = spark.createDataFrame([("A", "RADAR", 1.0, 2.0, "old")], "NAME string, TYPE string, LAT double, LON double, REMARKS string")
    one = store.upsert_sensors(store.empty(spark, SENSOR), s)
    two = store.upsert_sensors(one, s.withColumn("REMARKS", F.lit("new")))
    assert one.first().SENSOR_ID == two.first().SENSOR_ID and two.count() == 1 and two.first().REMARKS == "new"


def test_tables_are_made_saved_and_migrated(spark, tmp_path):
    root = str(tmp_path)
    tables = store.bootstrap(spark, root)
    assert set(tables) == set(TABLES) and all(t.count() == 0 for t in tables.values())
    store.save(store.watermark(tables["sync_meta"], "last_gp_sync", "2024"), f"{root}/sync_meta")
    assert [tuple(r) for r in store.bootstrap(spark, root)["sync_meta"].collect()] == [("last_gp_sync", "2024")]
    old = spark.createDataFrame([(1, 5)], "id long, NORAD_CAT_ID int")
    moved = store.migrate(old, MANEUVERS)
    assert moved.columns == MANEUVERS.names and moved.first().KP is None


def test_detections_keep_only_what_is_flagged(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    pairs = spark.createDataFrame([(1, True, -0.5, "confirmed"), (2, False, 0.1, None)], "NORAD_CAT_ID int, likely_maneuver boolean, delta_sma double, classification string")
    pairs = pairs.withColumns({"epoch_from": at, "epoch_to": at, **{c: F.lit(0.0) for c in ("delta_ecc", "delta_inc", "kp", "vel_residual_ms", "delta_bstar")}})
    out = store.insert_detections(store.empty(spark, MANEUVERS), store.detections(pairs))
    out = store.insert_detections(out, store.detections(pairs))
    [row] = out.collect()
    assert row.NORAD_CAT_ID == 1 and row.DELTA_SMA == -0.5 and row.DELTA_RAAN is None and row.detected_at is not None


def test_a_stop_between_the_moves_loses_no_table(spark, tmp_path):
    root = str(tmp_path)
    store.bootstrap(spark, root)
    meta = lambda: [tuple(r) for r in store.bootstrap(spark, root)["sync_meta"].collect()]
    store.save(store.watermark(store.bootstrap(spark, root)["sync_meta"], "k", "old"), f"{root}/sync_meta")
    new = store.watermark(spark.createDataFrame([], "key string, value string"), "k", "new")
    new.write.parquet(f"{root}/sync_meta.new")
    (tmp_path / "sync_meta").rename(tmp_path / "sync_meta.old")
    assert meta() == [("k", "new")]  # written whole, so it takes its place
    new.write.parquet(f"{root}/sync_meta.new")
    (tmp_path / "sync_meta.new" / "_SUCCESS").unlink()
    (tmp_path / "sync_meta").rename(tmp_path / "aside")
    assert meta() == [("k", "old")]  # half written, so the old rows come back
    store.save(new, f"{root}/sync_meta")
    assert meta() == [("k", "new")] and not (tmp_path / "sync_meta.old").exists() and not (tmp_path / "sync_meta.new").exists()

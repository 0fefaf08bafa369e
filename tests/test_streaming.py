from __future__ import annotations

from datetime import datetime, timedelta

from orrery.operators.store import bootstrap, migrate
from orrery.schemas import GP
from orrery.streaming import incremental


def _sets(spark, rows):
    return migrate(spark.createDataFrame([(g, n, datetime(2024, 1, 1) + timedelta(days=d)) for g, n, d in rows], "GP_ID long, NORAD_CAT_ID int, EPOCH timestamp_ntz"), GP)


def test_tables_follow_the_stream(spark, tmp_path):
    root, land = str(tmp_path / "store"), str(tmp_path / "land")
    bootstrap(spark, root)
    for rows in ([(1, 10, 0), (2, 20, 0)], [(3, 10, 1)], [(3, 10, 1), (4, 10, 2)]):
        _sets(spark, rows).write.mode("append").parquet(land)
        incremental.maintain(incremental.landed(spark, land), root, str(tmp_path / "check")).awaitTermination()
    read = lambda name: sorted((r.GP_ID, r.NORAD_CAT_ID) for r in spark.read.schema(GP).parquet(f"{root}/{name}").collect())
    assert read("gp") == [(2, 20), (4, 10)] and read("gp_history") == [(1, 10), (3, 10)]


def test_latest_of_each_object(spark, tmp_path):
    land = str(tmp_path / "land")
    _sets(spark, [(1, 10, 0), (2, 10, 3), (3, 20, 1)]).write.parquet(land)
    query = incremental.latest(incremental.landed(spark, land)).writeStream.format("memory").queryName("latest_sets").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.NORAD_CAT_ID, r.GP_ID) for r in spark.table("latest_sets").collect()) == [(10, 2), (20, 3)]


def test_a_stop_between_the_tables_is_made_good(spark, tmp_path, monkeypatch):
    root, land, check = str(tmp_path / "store"), str(tmp_path / "land"), str(tmp_path / "check")
    bootstrap(spark, root)
    follow = lambda: incremental.maintain(incremental.landed(spark, land), root, check).awaitTermination()
    read = lambda name: sorted((r.GP_ID, r.NORAD_CAT_ID) for r in spark.read.schema(GP).parquet(f"{root}/{name}").collect())
    _sets(spark, [(1, 10, 0), (2, 20, 0)]).write.parquet(land)
    follow()
    _sets(spark, [(3, 10, 1), (4, 10, 2), (5, 20, -1)]).write.mode("append").parquet(land)
    with monkeypatch.context() as m:
        m.setattr(incremental, "save", lambda *_: 1 / 0)
        try:
            follow()
        except Exception:  # noqa: S110  the stop
            pass
    assert read("gp_history") == [(1, 10), (3, 10), (5, 20)] and read("gp") == [(1, 10), (2, 20)]
    follow()
    assert read("gp") == [(2, 20), (4, 10)] and read("gp_history") == [(1, 10), (3, 10), (5, 20)]
    files = lambda: set((tmp_path / "store" / "gp_history").glob("*.parquet"))
    before = files()
    _sets(spark, [(6, 30, 0)]).write.mode("append").parquet(land)
    follow()
    assert before <= files() and read("gp") == [(2, 20), (4, 10), (6, 30)]  # the history is only appended to

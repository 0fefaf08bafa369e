"""Command line: keep a store of tables up to date and ask it questions.

    python -m orrery --store DIR COMMAND ...

Files that a service has landed (JSON, text, CSV) are given as paths; nothing
here calls a remote service.
"""

from __future__ import annotations

import argparse
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import lookups, store
from .plans import conjunction, maneuver, messages, proximity, reconcile, reports, tasking, visibility
from .session import session
from .sources import catalog, orbits, sensors, weather
from .sources.parameters import OBJECTS, mission_objects, mission_phases, months, window


def _show(title: str, rows: DataFrame, n: int = 50) -> None:
    print(f"\n{title}")
    rows.show(n, truncate=False)


def _time(text: str) -> datetime:
    return datetime.fromisoformat(text)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orrery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--store", required=True, help="folder of the tables")
    p.add_argument("--master", help="Spark master")
    c = p.add_subparsers(dest="command", required=True)
    add = lambda name, text: c.add_parser(name, help=text)
    for name, text in (("full", "load all element sets and metadata"), ("update", "archive and replace element sets that are new, find maneuvers")):
        x = add(name, text)
        x.add_argument("--elements", required=True)
        x.add_argument("--metadata", required=True)
        x.add_argument("--kp")
    x = add("backfill", "history of an object")
    x.add_argument("--elements", required=True)
    x.add_argument("--norad", type=int, required=True)
    x.add_argument("--start", required=True)
    x.add_argument("--end", required=True)
    add("status", "tables, types, epochs")
    x = add("maneuvers", "detections")
    x.add_argument("--norad", type=int)
    x.add_argument("--since")
    x.add_argument("--limit", type=int, default=20)
    x = add("sensors", "load a sheet of sensors")
    x.add_argument("--sheet", required=True)
    add("sensor-status", "sensors by type and country")
    x = add("detect", "maneuvers of some objects, with details")
    x.add_argument("--norad", type=int, nargs="*")
    x.add_argument("--kp")
    x.add_argument("--sigma", type=float, default=maneuver.SIGMA)
    x.add_argument("--kp-threshold", type=float, default=maneuver.KP_DISTURBED)
    x = add("screen", "conjunctions of an object")
    x.add_argument("--name", required=True)
    x.add_argument("--start", type=_time, required=True)
    x.add_argument("--days", type=float, default=30)
    x.add_argument("--warn-km", type=float, default=conjunction.WARN_KM)
    x.add_argument("--red-km", type=float, default=conjunction.RED_KM)
    x.add_argument("--dense", action="store_true")
    x = add("visible", "passes over sensors")
    x.add_argument("--sensor", nargs="*", default=[])
    x.add_argument("--sensor-id", type=int, nargs="*", default=[])
    x.add_argument("--start", type=_time, required=True)
    x.add_argument("--hours", type=float, default=24)
    x.add_argument("--step", type=float, default=30)
    x = add("task", "schedule of the tasking sites")
    x.add_argument("--start", type=_time, required=True)
    x.add_argument("--end", type=_time, required=True)
    x = add("proximity", "a rendezvous mission")
    x.add_argument("--mission", choices=sorted({x[0] for x in OBJECTS}), required=True)
    x = add("verify", "conjunction messages against propagation")
    x.add_argument("--messages", required=True)
    x.add_argument("--sensitivity", action="store_true")
    x = add("reconcile", "a file of element sets against the history")
    x.add_argument("--text", required=True)
    x.add_argument("--norad", type=int, required=True)
    return p


def _ingest(spark, args, tables, put, update: bool) -> None:
    if update:
        new = catalog.newer_by_object(spark, args.elements, tables["gp"]).cache()
        kept, history = store.archive(tables["gp"], tables["gp_history"], new)
        put("gp_history", history)
        put("gp", store.upsert_elements(kept, new, F.unix_micros(F.col("EPOCH").cast("timestamp"))))
    else:
        new = catalog.elements(spark, args.elements)
        put("gp", store.upsert_elements(tables["gp"], new))
    put("satcat", store.upsert_catalog(tables["satcat"], catalog.metadata(spark, args.metadata)))
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    put("sync_meta", store.watermark(store.watermark(tables["sync_meta"], "last_gp_sync", now), "last_satcat_sync", now))
    if update:
        kp = weather.kp(weather.read_text(spark, args.kp)) if args.kp else None
        history = store.bootstrap(spark, args.store)["gp_history"]
        found = maneuver.analyse(history, kp, ids=new)
        put("maneuvers", store.insert_detections(tables["maneuvers"], store.detections(found)))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session(args.master)
    tables = store.bootstrap(spark, args.store)
    put = lambda name, rows: store.save(store.migrate(rows, store.TABLES[name]), f"{args.store}/{name}")
    kind = args.command
    if kind in ("full", "update"):
        _ingest(spark, args, tables, put, kind == "update")
    elif kind == "backfill":
        rows, counts = catalog.backfill(spark, tables["gp_history"], args.elements, args.norad, args.start, args.end)
        _show("history", counts)
        put("gp_history", rows)
    elif kind == "status":
        for title, rows in reports.catalog_status(tables).items():
            _show(title, rows)
    elif kind == "maneuvers":
        _show("maneuvers", lookups.maneuvers(tables["maneuvers"], tables["gp"], args.norad, args.since, args.limit), args.limit)
    elif kind == "sensors":
        sheet = sensors.read_workbook(spark, args.sheet) if args.sheet.endswith(".xlsx") else sensors.read_csv(spark, args.sheet)
        kept, counts = sensors.sensors(sheet)
        _show("rows", counts)
        put("sensor", store.upsert_sensors(tables["sensor"], kept))
    elif kind == "sensor-status":
        for title, rows in reports.sensor_status(tables["sensor"]).items():
            _show(title, rows)
        _show("sensors", reports.sensor_list(tables["sensor"]), 1000)
    elif kind == "detect":
        kp = weather.kp(weather.read_text(spark, args.kp)) if args.kp else None
        ids = spark.createDataFrame([(n,) for n in args.norad], "NORAD_CAT_ID int") if args.norad else None
        found = maneuver.analyse(tables["gp_history"], kp, ids, args.sigma, args.kp_threshold).cache()
        _show("totals", maneuver.totals(found))
        _show("details", reports.maneuver_details(found), 1000)
    elif kind == "screen":
        primary = lookups.first_by_name(tables["gp"], "OBJECT_NAME", args.name, "NORAD_CAT_ID").first()
        if primary is None:
            raise SystemExit(f"no object is called {args.name}")
        events = conjunction.screen(tables["gp"], primary.NORAD_CAT_ID, args.start, args.start + timedelta(days=args.days), args.warn_km, args.red_km, dense=args.dense).cache()
        _show(f"conjunctions of {primary.OBJECT_NAME}", events.drop("r1", "r2", "v2"), 1000)
        _show("by country", conjunction.by_country(events))
    elif kind == "visible":
        names = spark.createDataFrame([(n,) for n in args.sensor], "name string")
        asked = lookups.sensors_named(tables["sensor"], names).drop("asked").unionByName(lookups.by_ids(tables["sensor"], "SENSOR_ID", args.sensor_id)).dropDuplicates(["SENSOR_ID"])
        ids = [r[0] for r in asked.select("SENSOR_ID").orderBy("SENSOR_ID").collect()]
        found = visibility.passes(tables["gp"], asked, args.start, args.start + timedelta(hours=args.hours), args.step).cache()
        _show("objects", visibility.matrix(found, tables["gp"], ids), 1000)
        _show("totals", visibility.totals(found, ids))
        _show("sensors", visibility.by_sensor(found))
        _show("passes", visibility.details(found), 1000)
    elif kind == "task":
        chosen = tasking.schedule(tasking.fleet(tables["gp"]), args.start, args.end).cache()
        for title, rows in (("contacts", tasking.contacts(chosen)), ("simultaneous", tasking.simultaneous(chosen)), ("schedule", tasking.selection(chosen)), ("revisits", tasking.revisits(chosen, args.start, args.end)), ("conflicts", tasking.conflicts(chosen, args.start))):
            _show(title, rows, 1000)
    elif kind == "proximity":
        phases = mission_phases(spark, args.mission)
        who = {r.role: r for r in mission_objects(spark, args.mission).collect()}
        chaser, target = who["chaser"], who["target"]
        series = proximity.distances(tables["gp_history"], chaser.NORAD_CAT_ID, target.NORAD_CAT_ID, phases).cache()
        _show("window", window(phases).select(months(F.col("begin"), F.col("end")).alias("window")))
        _show(f"{chaser.name} / {target.name}", proximity.closest(series))
        _show("by phase", proximity.closest_by_phase(series, phases))
        _show("maneuvers by phase", proximity.detections_by_phase(tables["gp_history"], chaser.NORAD_CAT_ID, phases))
        _show("noise floor of the target", proximity.noise_floor(tables["gp_history"], target.NORAD_CAT_ID, phases))
    elif kind == "verify":
        found = orbits.conjunction_messages(spark, args.messages)
        history = tables["gp_history"].unionByName(tables["gp"])
        _show("messages", messages.verify(found, history).drop("line11", "line12", "line21", "line22", "r1", "r2"), 1000)
        if args.sensitivity:
            _show("by age", messages.age_sensitivity(found, history), 1000)
    elif kind == "reconcile":
        left = orbits.tle_text(spark, args.text).select(F.lit(args.norad).alias("NORAD_CAT_ID"), "epoch")
        right = tables["gp_history"].filter(F.col("NORAD_CAT_ID") == args.norad).select("NORAD_CAT_ID", F.col("EPOCH").alias("epoch"))
        _show("summary", reconcile.summary(left, right, ["NORAD_CAT_ID"]))
        for title, rows in reconcile.reconcile(left, right, ["NORAD_CAT_ID"]).items():
            _show(title, rows)


if __name__ == "__main__":
    main()

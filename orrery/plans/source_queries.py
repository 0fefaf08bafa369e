"""Queries of sources, sinks, gates, reports and messages: landed text is made from the driver's tables, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sensors as rules
from ..functions import times, tle
from ..operators import propagate, store
from ..schemas import GP
from ..sources import catalog, orbits, weather
from ..sources import sensors as sheets
from . import ephemeris, maneuver, messages, reports
from .geometry_queries import LINES, _lines
from .tables import HISTORY, LATEST, SENSORS, STATES, history, latest, metadata, sensors, states, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _every(rows, schema, known):
    """All columns of a schema as text; those not given are null."""
    return rows.select(*[(known[f.name].cast("string") if f.name in known else F.lit(None).cast("string")).alias(f.name) for f in schema if f.name != "ingested_at"], F.lit(None).cast("string").alias("error"))


# Element sets as the service sends them: all text, blanks for what is missing, two forms of time.

RAW = """raw AS (SELECT event_id AS "FILE", CASE WHEN event_id % 50 <> 0 THEN event_id END AS "GP_ID", CAST(user_id AS INTEGER) AS "NORAD_CAT_ID",
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END AS "EPOCH", CASE WHEN event_id % 5 <> 0 THEN value END AS "MEAN_MOTION",
  CASE WHEN event_id % 11 = 0 THEN DATE '2024-01-01' + CAST(event_id % 28 AS INTEGER) END AS "DECAY_DATE" FROM events)"""


def _typed(spark, sf):
    e, k = table(spark, sf, "events"), F.col("event_id")
    blank = lambda test, text: F.when(test, F.lit("")).otherwise(text.cast("string"))
    at = F.when(k % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    decay = F.date_add(F.lit("2024-01-01").cast("date"), (k % 28).cast("int"))
    known = {"FILE": k, "GP_ID": blank(k % 50 == 0, k), "NORAD_CAT_ID": F.col("user_id"), "EPOCH": blank(k % 7 == 0, at), "MEAN_MOTION": blank(k % 5 == 0, F.col("value")), "DECAY_DATE": blank(k % 11 != 0, decay)}
    return catalog.typed(_every(e, GP, known), GP)


@query(f'WITH {RAW} SELECT *, "GP_ID" AS "GP_ID_ORIG" FROM raw')
def typed_elements(spark, sf):
    return _typed(spark, sf).select("FILE", "GP_ID", "NORAD_CAT_ID", "EPOCH", "MEAN_MOTION", "DECAY_DATE", "GP_ID_ORIG")


@query(f'WITH {RAW} SELECT "FILE" FROM raw WHERE "DECAY_DATE" IS NULL')
def flying_elements(spark, sf):
    return catalog.flying(_typed(spark, sf)).select("FILE")


@query(f"""WITH {RAW} SELECT "FILE" FROM raw WHERE "EPOCH" > TIMESTAMP '2024-01-10 12:00:00'""")
def newer_elements(spark, sf):
    return catalog.after(_typed(spark, sf), "2024-01-10 12:00:00").select("FILE")


@query(f"""WITH {HISTORY}, gp AS (SELECT "NORAD_CAT_ID", max("EPOCH") AS last FROM hist WHERE "GP_ID" % 2 = 0 AND "NORAD_CAT_ID" % 5 <> 0 GROUP BY 1)
SELECT "GP_ID" FROM hist LEFT JOIN gp USING ("NORAD_CAT_ID") WHERE last IS NULL OR "EPOCH" > last""")
def elements_ahead(spark, sf):
    h = history(spark, sf)
    return catalog.ahead(h, h.filter("GP_ID % 2 = 0 AND NORAD_CAT_ID % 5 != 0")).select("GP_ID")


@query(f"""WITH {HISTORY}, f AS (SELECT * FROM hist WHERE "NORAD_CAT_ID" = 11 AND CAST("EPOCH" AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20')
SELECT count(*) FILTER ("GP_ID" % 3 <> 0) AS inserted, count(*) FILTER ("GP_ID" % 3 = 0) AS skipped FROM f""")
def backfill_counts(spark, sf):
    h = history(spark, sf)
    return store.insert_counts(h.filter("GP_ID % 3 = 0"), catalog.of_days(h, 11, "2024-01-05", "2024-01-20"), ["GP_ID"])


# Sheets of sensors.


@query("""WITH s AS (SELECT s_suppkey AS k, s_name AS n FROM supplier), t AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'RADAR' WHEN k % 4 = 1 THEN 'LASER' WHEN k % 4 = 2 THEN 'PHASED_ARRAY_RADAR' ELSE 'OPTICAL' END AS kind FROM s WHERE k % 13 <> 0 AND k % 17 <> 0)
SELECT n AS "NAME", kind AS "TYPE", CAST((k * 7) % 160 - 80 AS DOUBLE) AS "LAT", CASE WHEN k % 3 = 0 THEN 10.0 ELSE CAST(k % 20 + 1 AS DOUBLE) END AS "MIN_EL_DEG", 90.0::DOUBLE AS "MAX_EL_DEG", -180.0::DOUBLE AS "AZ_MIN_DEG",
  CASE WHEN k % 4 = 0 THEN 2000.0 WHEN k % 4 = 1 THEN 40000.0 WHEN k % 4 = 2 THEN 3000.0 ELSE 42000.0 END::DOUBLE AS "MAX_RANGE_KM" FROM t""")
def sensor_sheet(spark, sf):
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    kinds = F.array(*[F.lit(x) for x in (" radar", "Laser", "phased array radar ", "optical")])
    known = {
        "Sensor Name": F.when(k % 13 == 0, F.lit(" ")).otherwise(F.col("s_name")), "Sensor Type": F.get(kinds, (k % 4).cast("int")), "Lat": F.when(k % 17 != 0, text((k * 7) % 160 - 80)), "Lon": F.lit("5.5"),
        "Elevation Min": F.when(k % 3 != 0, text(k % 20 + 1)), "Elevation Max": F.lit("0"), "Azimuth Min": F.lit(""), "Remarks": F.lit("2.4 m mirror"),
    }
    rows = table(spark, sf, "supplier").select(*[(known[c] if c in known else F.lit(None).cast("string")).alias(c) for c in sheets.HEADER])
    kept, _ = sheets.sensors(rows)
    return kept.select("NAME", "TYPE", "LAT", "MIN_EL_DEG", "MAX_EL_DEG", "AZ_MIN_DEG", "MAX_RANGE_KM")


@query(f"""WITH {SENSORS}, o AS (SELECT "NAME", "LAT", "LON", 'old' AS "REMARKS" FROM sensor WHERE "SENSOR_ID" % 3 <> 0), n AS (SELECT "NAME", "LAT", "LON", 'new' AS "REMARKS" FROM sensor WHERE "SENSOR_ID" % 2 = 0 OR "SENSOR_ID" % 3 = 0)
SELECT * FROM n UNION ALL SELECT o.* FROM o ANTI JOIN n USING ("NAME", "LAT", "LON")""")
def sensor_upsert(spark, sf):
    s = sensors(spark, sf).select("NAME", "TYPE", "LAT", "LON", "SENSOR_ID")
    old = store.upsert_sensors(store.migrate(s.limit(0), store.TABLES["sensor"]).select("SENSOR_ID", "NAME", "TYPE", "LAT", "LON", "REMARKS"), s.filter("SENSOR_ID % 3 != 0").drop("SENSOR_ID").withColumn("REMARKS", F.lit("old")))
    return store.upsert_sensors(old, s.filter("SENSOR_ID % 2 = 0 OR SENSOR_ID % 3 = 0").drop("SENSOR_ID").withColumn("REMARKS", F.lit("new"))).select("NAME", "LAT", "LON", "REMARKS")


# Space weather: lines made from events and from days.

NOWCAST = """nc AS (SELECT event_id, date_trunc('day', ts) + to_hours(CAST(3 * (event_id % 8) AS BIGINT)) + INTERVAL 30 MINUTE AS datetime, (event_id % 100 - 5) / 10.0 AS kp FROM events WHERE event_id % 9 <> 0)"""


def _nowcast(spark, sf):
    k, ts = F.col("event_id"), F.col("ts")
    hour = F.format_string("%d.5", 3 * (k % 8))
    line = F.concat_ws(" ", F.date_format(ts, "yyyy MM dd"), hour, F.lit("0 0 0"), ((k % 100 - 5) / F.lit(10.0)).cast("string"), F.lit("9"))
    return weather.kp(table(spark, sf, "events").select(F.when(k % 9 == 0, F.lit("# no line")).otherwise(line).alias("value")))


@query(f"WITH {NOWCAST} SELECT datetime, kp FROM nc WHERE kp >= 0")
def kp_nowcast(spark, sf):
    return _nowcast(spark, sf)


@query(f"""WITH {NOWCAST}, s AS (SELECT datetime, min(kp) AS kp FROM nc WHERE kp >= 0 GROUP BY 1), o AS (SELECT * FROM s WHERE datetime < TIMESTAMP '2024-01-20'), n AS (SELECT datetime, kp + 1 AS kp FROM s WHERE datetime >= TIMESTAMP '2024-01-15')
SELECT datetime, round(kp, 6) AS kp FROM n UNION ALL SELECT datetime, round(kp, 6) FROM o WHERE datetime < (SELECT min(datetime) FROM n)""")
def kp_extended(spark, sf):
    s = _nowcast(spark, sf).groupBy("datetime").agg(F.min("kp").alias("kp"))
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    new = s.filter(F.col("datetime") >= at("2024-01-15")).withColumn("kp", F.col("kp") + 1)
    return weather.extend(s.filter(F.col("datetime") < at("2024-01-20")), new).select("datetime", F.round("kp", 6).alias("kp"))


@query(f"""WITH {NOWCAST}, s AS (SELECT max(datetime) AS latest, max(kp) AS top FROM nc WHERE kp >= 0) SELECT latest, top <= 9 AS valid, CAST(epoch_us(TIMESTAMP '2024-03-01') - epoch_us(latest) AS BIGINT) // 86400000000 AS age_days,
  CASE WHEN top > 9 THEN 'reload' WHEN (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(latest)) // 86400000000 <= 1 THEN 'keep' ELSE 'extend' END AS action FROM s""")
def kp_freshness(spark, sf):
    return weather.freshness(_nowcast(spark, sf), F.lit("2024-03-01").cast("timestamp_ntz"))


DAYS = """dd AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), dy AS (SELECT date, 100.0::DOUBLE + day(date) AS f107, (day(date) * 7) % 50 + 1.0::DOUBLE AS ap_daily, day(date) AS d FROM dd WHERE day(date) % 6 <> 0),
days AS (SELECT *, avg(f107) OVER (ORDER BY date - DATE '1970-01-01' RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) AS f107_81 FROM dy)"""


def _days(spark, sf):
    """A line for each day on which there are events; every sixth has no flux."""
    day = table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    d = F.day("date")
    eight = [((d * (i + 3)) % 30).cast("string") for i in range(8)]
    flux = F.when(d % 6 == 0, F.lit("-1")).otherwise((100.0 + d).cast("string"))
    line = F.concat_ws(" ", F.date_format("date", "yyyy MM dd"), *[F.lit("0")] * 12, *eight, ((d * 7) % 50 + 1.0).cast("string"), F.lit("0"), flux, F.lit("0"))
    return weather.daily(day.select(line.alias("value")))


@query(f"WITH {DAYS} SELECT date, round(f107, 6) AS f107, round(f107_81, 6) AS f107_81, ap_daily FROM days")
def flux_days(spark, sf):
    return _days(spark, sf).select("date", F.round("f107", 6).alias("f107"), F.round("f107_81", 6).alias("f107_81"), "ap_daily")


AP = """ap AS (SELECT CAST(date AS TIMESTAMP) + to_hours(CAST(3 * i AS BIGINT)) AS t, CAST((d * (i + 3)) % 30 AS DOUBLE) AS ap FROM days, (SELECT unnest(range(8)) AS i))"""


@query(f"""WITH {DAYS}, {AP}, e AS (SELECT event_id, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR AS slot FROM events) SELECT event_id, coalesce(ap, 9.0) AS ap FROM e LEFT JOIN ap ON slot = t""")
def ap_lookup(spark, sf):
    return weather.ap_at(table(spark, sf, "events").select("event_id", "ts"), _days(spark, sf), "ts", hours_before=6).select("event_id", "ap")


@query(f"""WITH {DAYS}, a AS (SELECT DISTINCT CAST(ts AS DATE) - 1 AS day FROM events), n AS (SELECT day, f107 FROM a, days QUALIFY row_number() OVER (PARTITION BY day ORDER BY abs(day - date), date) = 1)
SELECT event_id, f107 AS flux FROM events JOIN n ON day = CAST(ts AS DATE) - 1""")
def flux_lookup(spark, sf):
    return weather.flux_at(table(spark, sf, "events").select("event_id", "ts"), _days(spark, sf), "ts", "f107", "flux", previous=True).select("event_id", "flux")


@query(f"""WITH {DAYS}, {AP}, e AS (SELECT DISTINCT ts, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS slot FROM events), k AS (SELECT ts, k, coalesce(ap, 9.0) AS ap FROM (SELECT *, unnest(range(20)) AS k FROM e) LEFT JOIN ap ON t = slot - to_hours(CAST(3 * k AS BIGINT)))
SELECT ts, coalesce(any_value(ap_daily), 9.0) AS ap0, max(ap) FILTER (k = 0) AS ap1, max(ap) FILTER (k = 1) AS ap2, max(ap) FILTER (k = 3) AS ap4, round(avg(ap) FILTER (k BETWEEN 4 AND 11), 6) AS ap5, round(avg(ap) FILTER (k >= 12), 6) AS ap6
FROM k LEFT JOIN days ON CAST(ts AS DATE) = date GROUP BY ts""")
def atmosphere_lags(spark, sf):
    rows = table(spark, sf, "events").select("ts").distinct()
    a = weather.atmosphere_inputs(rows, _days(spark, sf), "ts")
    return a.select("ts", *[F.round(F.col("ap")[i], 6).alias(f"ap{i}") for i in (0, 1, 2, 4, 5, 6)])


# Element sets as text.


@query(f"""WITH {LINES} SELECT event_id // 40 AS file, CASE WHEN event_id % 2 = 0 THEN 'OBJECT ' || event_id ELSE 'CATNR 00001' END AS name, make_timestamp(CASE WHEN event_id % 100 < 57 THEN 2000 ELSE 1900 END + event_id % 100, 1, 1, 0, 0, 0.0) + to_days(CAST(event_id % 365 AS INTEGER)) + INTERVAL 12 HOUR AS epoch
FROM tl WHERE event_id % 9 <> 0""")
def tle_records(spark, sf):
    k = F.col("event_id")
    record = F.concat(F.when(k % 2 == 0, F.concat(F.lit("OBJECT "), k, F.lit("\r\n"))).otherwise(F.lit("\n")), F.col("l"), F.when(k % 9 != 0, F.lit("\n2 00001  51.6")).otherwise(F.lit("")), F.lit("\n \n"))
    files = _lines(spark, sf).groupBy(F.floor(k / 40).alias("file")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(k, record.alias("r")))), lambda x: x["r"]), "").alias("value"))  # forty records
    return orbits.tle_records(files).select("file", "name", "epoch")


@query(f"""WITH {LINES} SELECT event_id, event_id % 3 <> 0 AND event_id % 4 <> 0 AS usable FROM tl""")
def usable_lines(spark, sf):
    k = F.col("event_id")
    two = F.rpad(F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit("2 00001")), 69, " ")
    return _lines(spark, sf).select("event_id", tle.usable(F.when(k % 4 != 0, F.col("l")), two).alias("usable"))


# Gates of sensors.


@query("""WITH g AS (SELECT event_id, value * 2 AS slant, (event_id * 7) % 360 / 1.0 AS az, event_id % 90 / 1.0 AS el, (event_id * 11) % 360 / 1.0 AS lo, (event_id * 13) % 360 / 1.0 AS hi FROM events)
SELECT event_id, slant <= 600 AND (CASE WHEN lo <= hi THEN az BETWEEN lo AND hi ELSE az >= lo OR az <= hi END) AND el >= 20 AS tracked, el >= 20 AND slant <= 600 AS seen, round(greatest(0.0, slant * sin(radians(el))), 6) AS least FROM g""")
def sensor_gates(spark, sf):
    k, slant = F.col("event_id"), F.col("value") * 2
    az, lo, hi, el = (c / F.lit(1.0) for c in ((k * 7) % 360, (k * 11) % 360, (k * 13) % 360, k % 90))
    far, low = F.lit(600.0), F.lit(20.0)
    return table(spark, sf, "events").select("event_id", rules.passes_gate(slant, az, el, far, lo, hi, low).alias("tracked"), rules.visible(el, slant, low, far).alias("seen"), F.round(rules.least_altitude(slant, el), 6).alias("least"))


# Maneuvers: detections, totals, changes of elements, reports.

FLAGS = f"""WITH {HISTORY}, fl AS (SELECT "NORAD_CAT_ID", "EPOCH", "SEMIMAJOR_AXIS" AS v, "SEMIMAJOR_AXIS" > 200 AS od, "GP_ID" % 6 = 0 AS bs, "GP_ID" % 4 = 0 AS bad FROM hist)"""


def _flagged(spark, sf):
    od, bs, bad = F.col("SEMIMAJOR_AXIS") > 200, F.col("GP_ID") % 6 == 0, F.col("GP_ID") % 4 == 0
    none = F.lit(None).cast("double")
    out = history(spark, sf).select("NORAD_CAT_ID", F.col("EPOCH").alias("epoch_from"), F.col("EPOCH").alias("epoch_to"), F.lit(1.0).alias("gap_days"), F.col("SEMIMAJOR_AXIS").alias("delta_sma"), *[none.alias(c) for c in ("delta_ecc", "delta_inc", "kp", "vel_residual_ms", "delta_bstar", "vr_threshold", "bstar_threshold")], od.alias("od_flag"), bs.alias("bstar_flag"), (od | bs).alias("likely_maneuver"), bad.alias("__bad"))
    out = out.withColumn("confirmed_maneuver", F.col("likely_maneuver") & ~F.col("__bad")).withColumn("uncertain_maneuver", F.col("likely_maneuver") & F.col("__bad"))
    return out.withColumn("classification", F.when(F.col("confirmed_maneuver"), "confirmed").when(F.col("uncertain_maneuver"), "uncertain"))


@query(f"""{FLAGS} SELECT "NORAD_CAT_ID", "EPOCH" AS "EPOCH_AFTER", any_value(v) AS "DELTA_SMA", CASE WHEN bool_and(bad) THEN 'uncertain' ELSE 'confirmed' END AS "CLASSIFICATION" FROM fl WHERE od OR bs GROUP BY ALL""")
def detection_rows(spark, sf):
    """One object has one set of an epoch here, so each detection is new once, though it is inserted twice."""
    found = store.detections(_flagged(spark, sf))
    stored = store.insert_detections(store.empty(spark, store.TABLES["maneuvers"]), found)
    return store.insert_ignore(stored.drop("id", "detected_at"), found, list(store.MANEUVER_KEY), F.col("EPOCH_AFTER").cast("timestamp").cast("long")).select("NORAD_CAT_ID", "EPOCH_AFTER", "DELTA_SMA", "CLASSIFICATION")


@query(f"""{FLAGS} SELECT "NORAD_CAT_ID", count(*) AS pairs, count(*) FILTER (od) AS od_flag, count(*) FILTER (bs) AS bstar_flag, count(*) FILTER ((od OR bs) AND NOT bad) AS confirmed_maneuver, count(*) FILTER ((od OR bs) AND bad) AS uncertain_maneuver FROM fl GROUP BY 1""")
def maneuver_totals(spark, sf):
    return maneuver.totals(_flagged(spark, sf)).drop("vr_threshold", "bstar_threshold")


@query(f"""{FLAGS} SELECT "NORAD_CAT_ID", "EPOCH" AS epoch_from, upper(CASE WHEN bad THEN 'uncertain' ELSE 'confirmed' END) AS class, CASE WHEN od AND bs THEN 'OD+B*' WHEN od THEN 'OD' ELSE 'B*' END AS flags FROM fl WHERE od OR bs""")
def maneuver_details(spark, sf):
    return reports.maneuver_details(_flagged(spark, sf)).select("NORAD_CAT_ID", "epoch_from", "class", "flags")


@query(f"""WITH {LATEST}, f AS (SELECT "NORAD_CAT_ID", "EPOCH", "SEMIMAJOR_AXIS" AS v FROM hist WHERE "SEMIMAJOR_AXIS" > 200 ORDER BY "EPOCH" DESC, "NORAD_CAT_ID" LIMIT 20)
SELECT f."NORAD_CAT_ID", substr("OBJECT_NAME", 1, 20) AS name, f."EPOCH" AS "EPOCH_AFTER", v AS "DELTA_SMA", '-' AS classification FROM f LEFT JOIN gp ON gp."NORAD_CAT_ID" = f."NORAD_CAT_ID" """)
def recent_report(spark, sf):
    found = history(spark, sf).filter("SEMIMAJOR_AXIS > 200").select("NORAD_CAT_ID", F.col("EPOCH").alias("EPOCH_BEFORE"), F.col("EPOCH").alias("EPOCH_AFTER"), F.col("SEMIMAJOR_AXIS").alias("DELTA_SMA"), F.lit(0.0).alias("VEL_RESIDUAL_MS"), F.lit("").alias("CLASSIFICATION"), F.lit(0.0).alias("KP"))
    return reports.recent_maneuvers(found, latest(spark, sf)).select("NORAD_CAT_ID", "name", "EPOCH_AFTER", "DELTA_SMA", "classification")


@query(f"""WITH {HISTORY}, l AS (SELECT * FROM hist QUALIFY row_number() OVER (PARTITION BY "NORAD_CAT_ID", "EPOCH" ORDER BY "GP_ID" DESC) = 1),
p AS (SELECT "NORAD_CAT_ID", "EPOCH" AS a, lead("EPOCH") OVER w AS b, "SEMIMAJOR_AXIS" AS v, lead("SEMIMAJOR_AXIS") OVER w AS u, "PERIAPSIS" AS x, lead("PERIAPSIS") OVER w AS y FROM l WINDOW w AS (PARTITION BY "NORAD_CAT_ID" ORDER BY "EPOCH"))
SELECT "NORAD_CAT_ID", a AS epoch_from, round(u - v, 6) AS delta_semimajor_axis, y - x AS delta_periapsis FROM p WHERE b IS NOT NULL AND (abs(u - v) > 100 OR abs(y - x) > 700)""")
def element_changes(spark, sf):
    found = maneuver.element_changes(history(spark, sf), {"SEMIMAJOR_AXIS": 100.0, "PERIAPSIS": 700.0})
    return found.select("NORAD_CAT_ID", "epoch_from", F.round("delta_semimajor_axis", 6).alias("delta_semimajor_axis"), "delta_periapsis")


@query(f"""WITH {LATEST} SELECT 'gp' AS "table", count(*) AS n FROM gp UNION ALL SELECT 'gp_history', count(*) FROM hist UNION ALL SELECT 'satcat', count(*) FROM customer UNION ALL SELECT 'sync_meta', 1""")
def table_sizes(spark, sf):
    meta = spark.createDataFrame([("last_gp_sync", "x")], "key string, value string")
    return reports.catalog_status({"gp": latest(spark, sf), "gp_history": history(spark, sf), "satcat": metadata(spark, sf), "sync_meta": meta})["tables"]


# Conjunction messages.

MESSAGES = """m AS (SELECT 'm' || event_id AS cdm_id, ts AS tca, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 1000 / 1000.0 END AS miss_distance_km, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.5::DOUBLE END AS collision_probability,
  CAST(user_id AS INTEGER) AS sat1_norad, CAST(user_id % 7 + 1 AS INTEGER) AS sat2_norad FROM events WHERE event_type = 'purchase')"""


def _messages(spark, sf):
    k = F.col("event_id")
    known = {
        "CDM_ID": F.concat(F.lit("m"), k), "TCA": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "MIN_RNG": F.when(k % 8 == 0, F.lit("")).when(k % 8 == 4, F.lit("0")).otherwise((k % 1000).cast("string")),
        "PC": F.when(k % 3 != 0, F.lit(" 0.5 ")), "SAT_1_ID": F.col("user_id").cast("string"), "SAT_2_ID": (F.col("user_id") % 7 + 1).cast("string"), "SAT_1_NAME": F.lit(" A "),
    }
    rows = table(spark, sf, "events").filter("event_type = 'purchase'")
    return orbits.typed_messages(rows.select(*[(known[c] if c in known else F.lit(None).cast("string")).alias(c) for c in orbits.MESSAGE]))


@query(f"""WITH {MESSAGES} SELECT * REPLACE (CASE WHEN miss_distance_km = 0 THEN NULL ELSE miss_distance_km END AS miss_distance_km), 'A' AS sat1_name, '' AS sat2_name FROM m""")
def message_fields(spark, sf):
    return _messages(spark, sf).select("cdm_id", "tca", "miss_distance_km", "collision_probability", "sat1_norad", "sat2_norad", "sat1_name", "sat2_name")


@query(f"""WITH {HISTORY}, {MESSAGES}, c AS (SELECT cdm_id, "EPOCH" AS e, "EPOCH" <= tca AS before, abs(epoch_us("EPOCH") - epoch_us(tca)) AS far FROM m LEFT JOIN hist ON "NORAD_CAT_ID" = sat1_norad)
SELECT cdm_id, e AS epoch1 FROM c QUALIFY row_number() OVER (PARTITION BY cdm_id ORDER BY before DESC NULLS LAST, far) = 1""")
def message_elements(spark, sf):
    return messages.with_elements(_messages(spark, sf), history(spark, sf)).select("cdm_id", "epoch1")


@query(f"""WITH {HISTORY}, {MESSAGES} SELECT DISTINCT cdm_id, "EPOCH" AS epoch, round((epoch_us(tca) - epoch_us("EPOCH")) / 3600000000.0, 6) AS age_h FROM m JOIN hist ON "NORAD_CAT_ID" = sat1_norad AND "EPOCH" <= tca AND epoch_us(tca) - epoch_us("EPOCH") <= 2 * 86400000000""")
def message_series(spark, sf):
    return messages.series(_messages(spark, sf), history(spark, sf), "sat1", 2.0).select("cdm_id", "epoch", F.round("age_h", 6).alias("age_h"))


@query(f"""WITH {MESSAGES} SELECT cdm_id, 1.5::DOUBLE AS tca_offset_s, round(2.0 - miss_distance_km, 9) AS miss_error_km, CASE WHEN miss_distance_km > 0 THEN round(2.0 / miss_distance_km, 6) END AS miss_ratio FROM (SELECT * REPLACE (CASE WHEN miss_distance_km = 0 THEN NULL ELSE miss_distance_km END AS miss_distance_km) FROM m)""")
def message_errors(spark, sf):
    found = _messages(spark, sf).withColumn("sgp4_tca", F.timestamp_add("MILLISECOND", F.lit(1500), F.col("tca"))).withColumn("sgp4_miss_km", F.lit(2.0))
    return messages.compare(found).select("cdm_id", "tca_offset_s", F.round("miss_error_km", 9).alias("miss_error_km"), F.round("miss_ratio", 6).alias("miss_ratio"))


# Ephemerides: errors of two predictions that are off by known vectors, and an orbit that is a circle.


@query(f"""WITH {STATES}, h AS (SELECT *, sqrt(rx * rx + ry * ry + rz * rz) AS r, ry * vz - rz * vy AS hx, rz * vx - rx * vz AS hy, rx * vy - ry * vx AS hz FROM st), n AS (SELECT *, sqrt(hx * hx + hy * hy + hz * hz) AS hn FROM h)
SELECT event_id, round((epoch_us(t) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0, 6) AS elapsed_h, 1.0::DOUBLE AS sgp4_3d, round(rx / r, 6) AS sgp4_r, round(hx / hn, 6) AS sgp4_n, 2.0::DOUBLE AS num_3d, round(2 * ry / r, 6) AS num_r, round(sqrt(5.0), 6) AS diverge_3d FROM n""")
def ephemeris_errors(spark, sf):
    s = states(spark, sf).select(F.col("event_id").alias("k"), "t", *[F.col(f"{a}_{c}").alias(f"{b}{c}") for a, b in (("r", ""), ("v", "v")) for c in "xyz"])
    truth = s.withColumn("common_start", F.lit("2024-01-01").cast("timestamp_ntz"))
    found = ephemeris.errors(truth, s.withColumn("x", F.col("x") + 1.0), s.withColumn("y", F.col("y") + 2.0), ["k"])
    return found.select(F.col("k").alias("event_id"), *[F.round(c, 6).alias(c) for c in ("elapsed_h", "sgp4_3d", "sgp4_r", "sgp4_n", "num_3d", "num_r", "diverge_3d")])


CIRCLE = """cc AS (SELECT event_id, 7000.0 + event_id % 900 AS a, radians(event_id % 180) AS i, radians((event_id * 7) % 360) AS o, radians((event_id * 11) % 360) AS u0, event_id % 6000 / 1.0 AS s FROM events), cu AS (SELECT *, u0 + s * sqrt(398600.4418 / (a * a * a)) AS u FROM cc)"""


@query(f"""WITH {CIRCLE} SELECT event_id, round(a * (cos(o) * cos(u) - sin(o) * sin(u) * cos(i)), 3) AS x, round(a * (sin(o) * cos(u) + cos(o) * sin(u) * cos(i)), 3) AS y, round(a * sin(u) * sin(i), 3) AS z FROM cu""")
def circular_orbits(spark, sf):
    k = F.col("event_id")
    s = propagate.ellipse_state(F.lit(7000.0) + k % 900, F.lit(0.0), F.radians(k % 180), F.radians((k * 7) % 360), F.lit(0.0), F.radians((k * 11) % 360), k % 6000)
    return table(spark, sf, "events").withColumn("s", s).select("event_id", *[F.round(F.col(f"s.{c}"), 3).alias(c) for c in "xyz"])


@query(f"""WITH {STATES} SELECT event_id, round(sqrt(1.0 + 4.0), 6) AS km FROM st""")
def orbit_divergence(spark, sf):
    s = states(spark, sf).select(F.col("event_id").alias("k"), "t", *[F.col(f"{a}_{c}").alias(f"{b}{c}") for a, b in (("r", ""), ("v", "v")) for c in "xyz"])
    return ephemeris.divergence(s, s.withColumn("x", F.col("x") + 1.0).withColumn("z", F.col("z") - 2.0), ["k"]).select(F.col("k").alias("event_id"), F.round("km", 6).alias("km"))


@query(f"""WITH {HISTORY}, e AS (SELECT "GP_ID", ("GP_ID" % 100) / 10.0 AS elapsed_h, "SEMIMAJOR_AXIS" AS a, "GP_ID" % 3 / 1.0 AS b FROM hist) SELECT "GP_ID", CASE WHEN b > 0 THEN round(a / b, 6) END AS ratio FROM e WHERE elapsed_h >= 0.5""")
def error_ratios(spark, sf):
    e = history(spark, sf).select("GP_ID", ((F.col("GP_ID") % 100) / F.lit(10.0)).alias("elapsed_h"), F.col("SEMIMAJOR_AXIS").alias("sgp4_3d"), ((F.col("GP_ID") % 3) / F.lit(1.0)).alias("num_3d"))
    return ephemeris.ratio_series(e).select("GP_ID", F.round("ratio", 6).alias("ratio"))

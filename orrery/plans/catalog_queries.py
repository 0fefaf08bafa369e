"""Queries of lookups, statistics, upserts and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import shown
from ..operators import dedupe, lookups, store
from . import reports
from .tables import HISTORY, LATEST, METADATA, SENSORS, history, latest, metadata, sensors, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


GP_COLUMNS = '"NORAD_CAT_ID", "GP_ID", "EPOCH", "OBJECT_TYPE", "PERIAPSIS", "APOAPSIS"'
GP_NAMES = ["NORAD_CAT_ID", "GP_ID", "EPOCH", "OBJECT_TYPE", "PERIAPSIS", "APOAPSIS"]


@query(f'WITH {LATEST} SELECT {GP_COLUMNS} FROM gp WHERE "NORAD_CAT_ID" = 7')
def object_lookup(spark, sf):
    return lookups.one(latest(spark, sf), "NORAD_CAT_ID", 7).select(GP_NAMES)


@query(f'WITH {LATEST} SELECT {GP_COLUMNS} FROM gp WHERE "PERIAPSIS" <= 900 AND "APOAPSIS" >= 500')
def band_overlap(spark, sf):
    return lookups.in_band(latest(spark, sf), 500, 900).select(GP_NAMES).orderBy("NORAD_CAT_ID")


@query(f"""WITH {LATEST}, p AS (SELECT "PERIAPSIS" - 50 AS lo, "APOAPSIS" + 50 AS hi FROM gp WHERE "NORAD_CAT_ID" = 7)
SELECT {GP_COLUMNS} FROM gp, p WHERE "PERIAPSIS" <= hi AND "APOAPSIS" >= lo AND "NORAD_CAT_ID" <> 7""")
def padded_candidates(spark, sf):
    return lookups.candidates(latest(spark, sf), 7).select(GP_NAMES)


@query(f"""WITH {LATEST}, {SENSORS} SELECT "NORAD_CAT_ID", "SENSOR_ID" FROM gp, sensor
WHERE "PERIAPSIS" <= "MAX_RANGE_KM" AND "APOAPSIS" >= greatest(0.0, "MIN_RANGE_KM" * sin(radians("MIN_EL_DEG")))""")
def sensor_reach(spark, sf):
    return lookups.in_reach(latest(spark, sf), sensors(spark, sf)).select("NORAD_CAT_ID", F.col("sensor.SENSOR_ID").alias("SENSOR_ID"))


@query(f"""WITH {LATEST} SELECT {GP_COLUMNS} FROM gp WHERE "OBJECT_TYPE" = 'click'""")
def objects_by_type(spark, sf):
    return lookups.by_type(latest(spark, sf), "click").select(GP_NAMES).orderBy("NORAD_CAT_ID")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE 'CUSTOMER#00000001%'")
def name_prefix(spark, sf):
    return lookups.by_prefix(table(spark, sf, "customer"), "c_name", "CUSTOMER#00000001").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name ILIKE '%mer#%12%' ORDER BY c_custkey LIMIT 1")
def name_substring(spark, sf):
    return lookups.first_by_name(table(spark, sf, "customer"), "c_name", "mer#%12", "c_custkey").select("c_custkey", "c_name")


@query(f"""WITH {SENSORS}, asked AS (SELECT DISTINCT trim(n_name) AS asked FROM nation UNION SELECT trim(s_name) FROM supplier UNION SELECT '00000001'),
e AS (SELECT asked, "SENSOR_ID" FROM asked JOIN sensor ON upper("NAME") = upper(asked)),
l AS (SELECT asked, "SENSOR_ID" FROM asked JOIN sensor ON "NAME" ILIKE '%' || asked || '%' WHERE asked NOT IN (SELECT asked FROM e))
SELECT * FROM e UNION ALL SELECT * FROM l""")
def name_fallback(spark, sf):
    s = sensors(spark, sf)
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(s.select(F.col("NAME").alias("name"))).unionByName(spark.range(1).select(F.lit("00000001").alias("name")))
    return lookups.sensors_named(s, names).select("asked", "SENSOR_ID")


@query(f'WITH {LATEST} SELECT {GP_COLUMNS} FROM gp WHERE "NORAD_CAT_ID" IN (1, 5, 9, 77)')
def objects_by_ids(spark, sf):
    return lookups.by_ids(latest(spark, sf), "NORAD_CAT_ID", [1, 5, 9, 77]).select(GP_NAMES)


@query(f"""WITH {LATEST}, {METADATA} SELECT gp."NORAD_CAT_ID", "EPOCH", "OBJECT_TYPE", "PERIAPSIS", "APOAPSIS", "SATNAME", "COUNTRY", "SITE" FROM gp LEFT JOIN sat ON gp."NORAD_CAT_ID" = sat."NORAD_CAT_ID" """)
def catalog_view(spark, sf):
    g, s = latest(spark, sf), metadata(spark, sf)
    return g.join(s, "NORAD_CAT_ID", "left").select("NORAD_CAT_ID", "EPOCH", "OBJECT_TYPE", "PERIAPSIS", "APOAPSIS", "SATNAME", "COUNTRY", "SITE")


@query(f"""WITH {LATEST} SELECT h."GP_ID", h."NORAD_CAT_ID", h."EPOCH" AS "EPOCH_AFTER", gp."OBJECT_NAME" FROM hist h LEFT JOIN gp ON h."NORAD_CAT_ID" = gp."NORAD_CAT_ID"
WHERE h."SEMIMAJOR_AXIS" > 400 AND strftime(h."EPOCH", '%Y-%m-%dT%H:%M:%S') > '2024-01-10' ORDER BY h."EPOCH" DESC, h."NORAD_CAT_ID", h."EPOCH" LIMIT 100""")
def recent_detections(spark, sf):
    found = history(spark, sf).filter("SEMIMAJOR_AXIS > 400").select("GP_ID", "NORAD_CAT_ID", F.col("EPOCH").alias("EPOCH_BEFORE"), F.col("EPOCH").alias("EPOCH_AFTER"))
    return lookups.maneuvers(found, latest(spark, sf), since="2024-01-10", limit=100).select("GP_ID", "NORAD_CAT_ID", "EPOCH_AFTER", "OBJECT_NAME")


@query(f"""WITH {HISTORY} SELECT DISTINCT "NORAD_CAT_ID" FROM hist WHERE "SEMIMAJOR_AXIS" > 480 AND strftime("EPOCH", '%Y-%m-%dT%H:%M:%S') > '2024-01-15'""")
def objects_since(spark, sf):
    found = history(spark, sf).filter("SEMIMAJOR_AXIS > 480").withColumn("EPOCH_AFTER", F.col("EPOCH"))
    return lookups.maneuvering(found, "2024-01-15")


@query(f'WITH {HISTORY} SELECT "GP_ID", "EPOCH" FROM hist WHERE "NORAD_CAT_ID" = 11')
def object_history(spark, sf):
    found = history(spark, sf).select("GP_ID", "NORAD_CAT_ID", "EPOCH", F.col("EPOCH").alias("EPOCH_BEFORE"), F.col("EPOCH").alias("EPOCH_AFTER"))
    return lookups.maneuver_history(found, 11).select("GP_ID", "EPOCH")


@query(f"""WITH {HISTORY} SELECT "GP_ID", "EPOCH" FROM hist WHERE "NORAD_CAT_ID" = 11 AND strftime("EPOCH", '%Y-%m-%dT%H:%M:%S.%f') >= '2024-01-05' AND strftime("EPOCH", '%Y-%m-%dT%H:%M:%S.%f') <= '2024-01-20T23:59:59'
QUALIFY row_number() OVER (PARTITION BY "EPOCH" ORDER BY "GP_ID" DESC) = 1""")
def history_window(spark, sf):
    return lookups.history_of(history(spark, sf), 11, "2024-01-05", "2024-01-20").select("GP_ID", "EPOCH")


@query(f"""WITH {LATEST} SELECT (SELECT count(*) FROM gp) AS gp_count, (SELECT count(*) FROM hist) AS gp_history_count, (SELECT count(*) FROM customer) AS satcat_count, min("EPOCH") AS oldest_epoch, max("EPOCH") AS newest_epoch FROM gp""")
def catalog_totals(spark, sf):
    return reports.catalog_stats(latest(spark, sf), history(spark, sf), metadata(spark, sf))["totals"]


@query(f'WITH {LATEST} SELECT "OBJECT_TYPE", count(*) AS n FROM gp GROUP BY 1')
def stats_by_type(spark, sf):
    return lookups.counts(latest(spark, sf), "OBJECT_TYPE")


@query(f'WITH {METADATA} SELECT "COUNTRY", count(*) AS n FROM sat GROUP BY 1 ORDER BY n DESC, "COUNTRY" NULLS FIRST LIMIT 20')
def top_countries(spark, sf):
    return lookups.counts(metadata(spark, sf), "COUNTRY", 20)


@query(f"""WITH {HISTORY} SELECT coalesce(min("EPOCH"), TIMESTAMP '2000-01-01') AS start, coalesce(max("EPOCH"), TIMESTAMP '2000-01-02') AS "end" FROM hist WHERE "NORAD_CAT_ID" IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def epoch_range_of_objects(spark, sf):
    ids = table(spark, sf, "customer").filter("c_nationkey = 3").select("c_custkey")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return lookups.epoch_range_of(history(spark, sf), ids, "EPOCH", at("2000-01-01"), at("2000-01-02"))


@query(f'WITH {SENSORS} SELECT "TYPE", min("MAX_RANGE_KM") AS least, max("MAX_RANGE_KM") AS greatest FROM sensor GROUP BY 1')
def sensor_ranges(spark, sf):
    return reports.sensor_status(sensors(spark, sf).withColumn("COUNTRY", F.lit(None).cast("string")))["ranges"]


@query(f'WITH {SENSORS} SELECT "SENSOR_ID", "NAME", CAST(NULL AS VARCHAR) AS "COUNTRY", "TYPE", "LAT", "LON", "MIN_RANGE_KM", "MAX_RANGE_KM", "MIN_EL_DEG" FROM sensor')
def sensor_list(spark, sf):
    return reports.sensor_list(sensors(spark, sf).withColumn("COUNTRY", F.lit(None).cast("string")))


@query("SELECT c_custkey, substr(coalesce(nullif(c_name, ''), '?'), 1, 12) AS name FROM customer")
def shown_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", shown(F.col("c_name"), 12).alias("name"))


# Upserts: events of even ids are stored, those of odd ids come in.

SPLIT = HISTORY + """, old AS (SELECT * FROM hist WHERE "GP_ID" % 2 = 0), new AS (SELECT * FROM hist WHERE "GP_ID" % 2 = 1),
stored AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "NORAD_CAT_ID" ORDER BY "GP_ID" DESC) AS rn FROM old) WHERE rn = 1)"""


def _split(spark, sf):
    h = history(spark, sf)
    old, new = h.filter("GP_ID % 2 = 0"), h.filter("GP_ID % 2 = 1")
    return dedupe.keep(old, ["NORAD_CAT_ID"], [F.col("GP_ID").desc()]), new


@query(f"""WITH {SPLIT}, b AS (SELECT *, 0 AS src FROM stored UNION ALL SELECT *, 1 FROM new)
SELECT {GP_COLUMNS} FROM (SELECT *, row_number() OVER (PARTITION BY "NORAD_CAT_ID" ORDER BY src DESC, "GP_ID" DESC) AS rn FROM b) WHERE rn = 1""")
def upsert_latest(spark, sf):
    stored, new = _split(spark, sf)
    return store.upsert_elements(stored, new, F.col("GP_ID")).select(GP_NAMES)


@query(f"""WITH {SPLIT}, inc AS (SELECT * FROM new WHERE "NORAD_CAT_ID" % 3 = 0)
SELECT 'gp' AS side, "GP_ID" FROM stored WHERE "NORAD_CAT_ID" NOT IN (SELECT "NORAD_CAT_ID" FROM inc)
UNION ALL SELECT 'history', "GP_ID" FROM (SELECT "GP_ID" FROM old WHERE "GP_ID" % 4 = 0 UNION SELECT "GP_ID" FROM stored WHERE "NORAD_CAT_ID" IN (SELECT "NORAD_CAT_ID" FROM inc))""")
def archive_split(spark, sf):
    stored, new = _split(spark, sf)
    gp, old = store.archive(stored, history(spark, sf).filter("GP_ID % 4 = 0"), new.filter("NORAD_CAT_ID % 3 = 0"))
    return gp.select(F.lit("gp").alias("side"), "GP_ID").unionByName(old.select(F.lit("history").alias("side"), "GP_ID"))


# Two of three sets are stored; the third and every second come in, so each row is on one side at least.


@query(f"""WITH {HISTORY}, s AS (SELECT * FROM hist WHERE "GP_ID" % 3 <> 0), n AS (SELECT * FROM hist WHERE "GP_ID" % 3 = 0 OR "GP_ID" % 2 = 0)
SELECT "GP_ID" FROM s UNION ALL SELECT "GP_ID" FROM n WHERE "GP_ID" NOT IN (SELECT "GP_ID" FROM s)""")
def insert_ignore(spark, sf):
    h = history(spark, sf)
    return store.insert_ignore(h.filter("GP_ID % 3 != 0"), h.filter("GP_ID % 3 = 0 OR GP_ID % 2 = 0"), ["GP_ID"], F.col("GP_ID")).select("GP_ID")


@query(f"""WITH {HISTORY}, s AS (SELECT * FROM hist WHERE "GP_ID" % 3 <> 0), n AS (SELECT * FROM hist WHERE "GP_ID" % 3 = 0 OR "GP_ID" % 2 = 0), f AS (SELECT count(*) AS inserted FROM n WHERE "GP_ID" NOT IN (SELECT "GP_ID" FROM s))
SELECT inserted, (SELECT count(*) FROM n) - inserted AS skipped FROM f""")
def insert_counts(spark, sf):
    h = history(spark, sf)
    return store.insert_counts(h.filter("GP_ID % 3 != 0"), h.filter("GP_ID % 3 = 0 OR GP_ID % 2 = 0"), ["GP_ID"])


@query("SELECT key, value FROM (VALUES ('last_gp_sync', '2024-02-01T00:00:00'), ('last_satcat_sync', 'x')) t(key, value)")
def watermark(spark, sf):
    meta = spark.createDataFrame([("last_gp_sync", "old"), ("last_satcat_sync", "x")], "key string, value string")
    return store.watermark(meta, "last_gp_sync", "2024-02-01T00:00:00")


@query(f"""WITH {HISTORY} SELECT "GP_ID" FROM hist QUALIFY row_number() OVER (PARTITION BY "NORAD_CAT_ID" % 10, date_trunc('hour', "EPOCH") ORDER BY "GP_ID" DESC) = 1""")
def dedupe_last(spark, sf):
    h = history(spark, sf).withColumn("NORAD_CAT_ID", F.col("NORAD_CAT_ID") % 10).withColumn("EPOCH", F.date_trunc("HOUR", "EPOCH"))
    return dedupe.keep_last(h, ["NORAD_CAT_ID"], "EPOCH", "GP_ID").select("GP_ID")


@query(f"""WITH {HISTORY} SELECT "GP_ID" FROM hist QUALIFY row_number() OVER (PARTITION BY "NORAD_CAT_ID" % 2, date_trunc('second', "EPOCH") ORDER BY "EPOCH", "GP_ID") = 1""")
def dedupe_second(spark, sf):
    h = history(spark, sf).withColumn("NORAD_CAT_ID", F.col("NORAD_CAT_ID") % 2)
    return dedupe.keep_first_second(h, ["NORAD_CAT_ID"], "EPOCH", [F.col("EPOCH"), F.col("GP_ID")]).select("GP_ID")


@query(f"""WITH {HISTORY} SELECT "GP_ID" FROM (SELECT *, row_number() OVER (PARTITION BY "NORAD_CAT_ID", round_even("SEMIMAJOR_AXIS" * 2, 0) / 2 ORDER BY "GP_ID") AS rn FROM hist) WHERE rn = 1 AND "GP_ID" % 5 <> 0""")
def claimed_buckets(spark, sf):
    from ..functions.times import half_hours

    h = history(spark, sf).withColumn("bucket", half_hours(F.col("SEMIMAJOR_AXIS"))).withColumn("ok", F.col("GP_ID") % 5 != 0)
    return dedupe.claim_buckets(h, ["NORAD_CAT_ID"], "bucket", [F.col("GP_ID")], "ok").select("GP_ID")


@query(f"""WITH {HISTORY} SELECT "NORAD_CAT_ID", "OBJECT_TYPE", count(*) AS n FROM hist GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return lookups.duplicates(history(spark, sf), ["NORAD_CAT_ID", "OBJECT_TYPE"])


@query("SELECT DISTINCT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_values(spark, sf):
    return lookups.missing_from(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"""WITH {HISTORY}, f AS (SELECT DISTINCT "NORAD_CAT_ID" FROM hist ORDER BY 1 LIMIT 50) SELECT "NORAD_CAT_ID", "GP_ID", greatest((SELECT count(DISTINCT "NORAD_CAT_ID") FROM hist) - 50, 0) AS more FROM hist WHERE "NORAD_CAT_ID" IN (FROM f)""")
def first_objects(spark, sf):
    return lookups.first_objects(history(spark, sf), "NORAD_CAT_ID", 50).select("NORAD_CAT_ID", "GP_ID", F.col("more").cast("long").alias("more"))


@query(f"""WITH {HISTORY} SELECT "NORAD_CAT_ID", count(*) FILTER ("OBJECT_TYPE" = 'click') AS click, count(*) FILTER ("OBJECT_TYPE" = 'view') AS "view", count(*) FILTER ("OBJECT_TYPE" = 'purchase') AS purchase FROM hist GROUP BY 1""")
def pivot_counts(spark, sf):
    return lookups.pivot_counts(history(spark, sf), "NORAD_CAT_ID", "OBJECT_TYPE", ["click", "view", "purchase"])

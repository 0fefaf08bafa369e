"""The driver's tables seen as the catalogue's: events are element sets, customers metadata, suppliers sensors.

The SQL of each view is beside it, for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    peri = F.lit(300) + F.pmod(F.col("event_id") * 37, F.lit(1500))
    return e.select(
        F.col("event_id").alias("GP_ID"), F.col("user_id").alias("NORAD_CAT_ID"), F.concat(F.lit("OBJECT "), F.col("user_id")).alias("OBJECT_NAME"), F.col("ts").alias("EPOCH"),
        F.col("event_type").alias("OBJECT_TYPE"), F.col("value").alias("SEMIMAJOR_AXIS"), peri.alias("PERIAPSIS"), (peri + F.pmod(F.col("event_id") * 13, F.lit(200))).alias("APOAPSIS"),
        F.lit("1").alias("TLE_LINE1"), F.lit("2").alias("TLE_LINE2"),
    )


HISTORY = """hist AS (SELECT event_id AS "GP_ID", user_id AS "NORAD_CAT_ID", 'OBJECT ' || user_id AS "OBJECT_NAME", ts AS "EPOCH", event_type AS "OBJECT_TYPE", value AS "SEMIMAJOR_AXIS",
  300 + (event_id * 37) % 1500 AS "PERIAPSIS", 300 + (event_id * 37) % 1500 + (event_id * 13) % 200 AS "APOAPSIS" FROM events)"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(history(spark, sf_dir), ["NORAD_CAT_ID"], [F.col("EPOCH").desc(), F.col("GP_ID").desc()])


LATEST = HISTORY + """, gp AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "NORAD_CAT_ID" ORDER BY "EPOCH" DESC, "GP_ID" DESC) AS rn FROM hist) WHERE rn = 1)"""


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("COUNTRY"))
    c = table(spark, sf_dir, "customer")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("c_custkey").alias("NORAD_CAT_ID"), F.col("c_name").alias("SATNAME"), "COUNTRY", F.col("c_mktsegment").alias("SITE"))


METADATA = """sat AS (SELECT c_custkey AS "NORAD_CAT_ID", c_name AS "SATNAME", n_name AS "COUNTRY", c_mktsegment AS "SITE" FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("SENSOR_ID"), F.col("s_name").alias("NAME"), F.element_at(F.array(*[F.lit(x) for x in ("RADAR", "OPTICAL", "LASER", "PHASED_ARRAY_RADAR")]), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("TYPE"),
        (F.pmod(k * 7, F.lit(160)) - 80).cast("double").alias("LAT"), (F.pmod(k * 31, F.lit(360)) - 180).cast("double").alias("LON"), F.lit(500.0).alias("ALT_M"),
        F.pmod(k, F.lit(20)).cast("double").alias("MIN_EL_DEG"), F.lit(200.0).alias("MIN_RANGE_KM"), (F.lit(400) + F.pmod(k * 97, F.lit(1500))).cast("double").alias("MAX_RANGE_KM"),
    )


SENSORS = """sensor AS (SELECT s_suppkey AS "SENSOR_ID", s_name AS "NAME", (['RADAR', 'OPTICAL', 'LASER', 'PHASED_ARRAY_RADAR'])[s_suppkey % 4 + 1] AS "TYPE", CAST((s_suppkey * 7) % 160 - 80 AS DOUBLE) AS "LAT",
  CAST((s_suppkey * 31) % 360 - 180 AS DOUBLE) AS "LON", 500.0::DOUBLE AS "ALT_M", CAST(s_suppkey % 20 AS DOUBLE) AS "MIN_EL_DEG", 200.0::DOUBLE AS "MIN_RANGE_KM", CAST(400 + (s_suppkey * 97) % 1500 AS DOUBLE) AS "MAX_RANGE_KM" FROM supplier)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A position, a velocity and a time for each event, by formula."""
    e = table(spark, sf_dir, "events")
    a, b = F.col("event_id").cast("double"), F.col("value")
    return e.select("event_id", "user_id", F.col("ts").alias("t"), (F.lit(6900.0) * F.cos(a) * F.cos(b)).alias("r_x"), (F.lit(6900.0) * F.sin(a) * F.cos(b)).alias("r_y"), (F.lit(6900.0) * F.sin(b)).alias("r_z"),
                    (-F.lit(7.5) * F.sin(a)).alias("v_x"), (F.lit(7.5) * F.cos(a)).alias("v_y"), (F.lit(0.5) * F.sin(a + b)).alias("v_z"))


STATES = """st AS (SELECT event_id, user_id, ts AS t, 6900.0 * cos(event_id) * cos(value) AS rx, 6900.0 * sin(event_id) * cos(value) AS ry, 6900.0 * sin(value) AS rz,
  -7.5 * sin(event_id) AS vx, 7.5 * cos(event_id) AS vy, 0.5 * sin(event_id + value) AS vz FROM events)"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access windows: an event of a user is seen by one of five sensors for one to sixty minutes."""
    e = table(spark, sf_dir, "events")
    minutes = (F.pmod(F.col("event_id") * 7, F.lit(60)) + 1).cast("int")
    return e.select((F.pmod(F.col("event_id"), F.lit(5))).alias("sensor"), F.col("user_id").alias("norad_id"), "event_id", F.col("ts").alias("t_aos"), F.timestamp_add("MINUTE", minutes, F.col("ts")).alias("t_los"))


INTERVALS = """iv AS (SELECT event_id % 5 AS sensor, user_id AS norad_id, event_id, ts AS t_aos, ts + to_minutes(CAST((event_id * 7) % 60 + 1 AS BIGINT)) AS t_los FROM events)"""


def element_lines(spark: SparkSession, sf_dir: str, epoch_day: float = 1.5) -> DataFrame:
    """Element sets of made-up low orbits, one for each customer, with altitudes."""
    k = F.col("c_custkey")
    revolutions = F.lit(15.9) - F.pmod(k * 7, F.lit(500)) / 250.0
    a = F.pow(F.lit(398600.8) / F.pow(revolutions * F.lit(2 * 3.141592653589793 / 86400), F.lit(2)), F.lit(1 / 3))
    ecc = F.pmod(k * 13, F.lit(100)) / 100000.0
    one = F.format_string(f"1 %05dU 24001A   24{epoch_day:012.8f}  .00000000  00000-0  10000-3 0    1", F.pmod(k, F.lit(100000)))
    two = F.format_string("2 %05d %8.4f %8.4f %07d %8.4f %8.4f %11.8f    1", F.pmod(k, F.lit(100000)), F.lit(30.0) + F.pmod(k * 17, F.lit(70)), F.pmod(k * 29, F.lit(360)).cast("double"), (ecc * 1e7).cast("int"), F.pmod(k * 43, F.lit(360)).cast("double"), F.pmod(k * 59, F.lit(360)).cast("double"), revolutions)
    return table(spark, sf_dir, "customer").select(k.alias("NORAD_CAT_ID"), F.col("c_name").alias("OBJECT_NAME"), one.alias("TLE_LINE1"), two.alias("TLE_LINE2"), (a * (1 - ecc) - 6378.135).alias("PERIAPSIS"), (a * (1 + ecc) - 6378.135).alias("APOAPSIS"), F.lit("PAYLOAD").alias("OBJECT_TYPE"), F.lit("X").alias("COUNTRY_CODE"))

"""Queries of pairs, thresholds, as-of, nearest, tolerance and overlap joins, runs and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, times
from ..operators import joins, robust, schedule, windows
from . import ephemeris, maneuver, proximity, reconcile, tasking, visibility
from .tables import HISTORY, INTERVALS, LATEST, history, intervals, latest, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


PAIRS = """pairs AS (SELECT * FROM (SELECT "GP_ID", "NORAD_CAT_ID", "EPOCH", "SEMIMAJOR_AXIS", lead("EPOCH") OVER w AS "next_EPOCH", lead("SEMIMAJOR_AXIS") OVER w AS "next_SEMIMAJOR_AXIS",
  (epoch_us(lead("EPOCH") OVER w) - epoch_us("EPOCH")) / 86400000000.0 AS gap_days FROM hist WINDOW w AS (PARTITION BY "NORAD_CAT_ID" ORDER BY "EPOCH", "GP_ID")) WHERE "next_EPOCH" IS NOT NULL)"""


def _pairs(spark, sf):
    return windows.lead_pairs(history(spark, sf), ["NORAD_CAT_ID"], "EPOCH", ["SEMIMAJOR_AXIS"], "GP_ID")


@query(f"""WITH {HISTORY}, {PAIRS} SELECT "GP_ID", "next_EPOCH", round(gap_days, 6) AS gap_days, round("next_SEMIMAJOR_AXIS" - "SEMIMAJOR_AXIS", 3) AS delta,
  round(CASE WHEN "SEMIMAJOR_AXIS" <> 0 AND "next_SEMIMAJOR_AXIS" <> 0 THEN abs("next_SEMIMAJOR_AXIS" - "SEMIMAJOR_AXIS") ELSE 0.0 END, 6) AS moved FROM pairs""")
def lead_pairs(spark, sf):
    d = F.col("next_SEMIMAJOR_AXIS") - F.col("SEMIMAJOR_AXIS")
    return _pairs(spark, sf).select("GP_ID", "next_EPOCH", F.round("gap_days", 6).alias("gap_days"), F.round(d, 3).alias("delta"), F.round(windows.drag_change(F.col("SEMIMAJOR_AXIS"), F.col("next_SEMIMAJOR_AXIS")), 6).alias("moved"))


@query(f"""WITH {HISTORY}, {PAIRS} SELECT "GP_ID" FROM pairs WHERE gap_days >= 0.01 AND gap_days <= 1""")
def gap_filter(spark, sf):
    return _pairs(spark, sf).filter(windows.gap_ok(F.col("gap_days"), 0.01, 1.0)).select("GP_ID")


@query(f"""WITH {HISTORY}, m AS (SELECT "NORAD_CAT_ID" AS k, median("SEMIMAJOR_AXIS") AS med, mad("SEMIMAJOR_AXIS") AS dev FROM hist GROUP BY 1)
SELECT "GP_ID", round(med + 2 * dev, 6) AS threshold, "SEMIMAJOR_AXIS" > med + 2 * dev AS flagged FROM hist JOIN m ON "NORAD_CAT_ID" = k""")
def mad_threshold(spark, sf):
    out = robust.mad_threshold(history(spark, sf), ["NORAD_CAT_ID"], "SEMIMAJOR_AXIS", 2.0)
    return out.select("GP_ID", F.round("threshold", 6).alias("threshold"), labels.above(F.col("SEMIMAJOR_AXIS"), F.col("threshold")).alias("flagged"))


@query(f"""WITH {HISTORY}, v AS (SELECT *, greatest("SEMIMAJOR_AXIS" - 400, 0) AS d FROM hist), m AS (SELECT "NORAD_CAT_ID" AS k, median(d) AS med, mad(d) AS dev, count(*) AS n FROM v WHERE d > 0 GROUP BY 1)
SELECT "GP_ID", CASE WHEN n >= 10 THEN round(med + 5 * dev, 6) ELSE 0.00005 END AS threshold FROM v LEFT JOIN m ON "NORAD_CAT_ID" = k""")
def drag_threshold(spark, sf):
    v = history(spark, sf).withColumn("d", F.greatest(F.col("SEMIMAJOR_AXIS") - 400, F.lit(0.0)))
    out = robust.drag_threshold(v, ["NORAD_CAT_ID"], "d")
    return out.select("GP_ID", F.round("bstar_threshold", 6).alias("threshold"))


@query(f"""WITH {HISTORY}, m AS (SELECT "NORAD_CAT_ID" AS k, count(*) FILTER (abs("SEMIMAJOR_AXIS") <= 245) AS keep, count(*) AS n, quantile_cont(abs("SEMIMAJOR_AXIS"), 0.95) AS q FROM hist GROUP BY 1)
SELECT "GP_ID" FROM hist JOIN m ON "NORAD_CAT_ID" = k WHERE abs("SEMIMAJOR_AXIS") <= CASE WHEN keep < n * 0.5 THEN q ELSE 245 END""")
def noise_filter(spark, sf):
    return robust.noise_filter(history(spark, sf), ["NORAD_CAT_ID"], "SEMIMAJOR_AXIS", 245.0).select("GP_ID")


@query(f"""WITH {HISTORY}, {PAIRS}, f AS (SELECT "GP_ID", CASE WHEN "GP_ID" % 7 = 0 THEN NULL ELSE CAST("GP_ID" % 10 AS DOUBLE) END AS kp, "SEMIMAJOR_AXIS" > 300 AS od, abs("next_SEMIMAJOR_AXIS" - "SEMIMAJOR_AXIS") > 100 AS bs FROM pairs)
SELECT "GP_ID", CASE WHEN (od OR bs) AND NOT coalesce(kp >= 5, false) THEN 'confirmed' WHEN od OR bs THEN 'uncertain' END AS classification FROM f""")
def classify(spark, sf):
    p = _pairs(spark, sf).select("GP_ID", F.when(F.col("GP_ID") % 7 != 0, (F.col("GP_ID") % 10).cast("double")).alias("kp"), F.col("SEMIMAJOR_AXIS").alias("vel_res_per_day"), F.lit(300.0).alias("vr_threshold"), F.abs(F.col("next_SEMIMAJOR_AXIS") - F.col("SEMIMAJOR_AXIS")).alias("delta_bstar"), F.lit(100.0).alias("bstar_threshold"))
    return maneuver.classify(p).select("GP_ID", "classification")


@query(f"""WITH {HISTORY} SELECT "GP_ID", CASE WHEN "SEMIMAJOR_AXIS" <= 50 THEN 'RED' WHEN "SEMIMAJOR_AXIS" <= 250 THEN 'WARN' END AS severity FROM hist""")
def severity(spark, sf):
    return history(spark, sf).select("GP_ID", labels.severity(F.col("SEMIMAJOR_AXIS"), 50.0, 250.0).alias("severity"))


@query(f"""WITH {HISTORY} SELECT "NORAD_CAT_ID", date_diff('microsecond', min("EPOCH"), max("EPOCH")) // 86400000000 AS coverage_days, date_diff('microsecond', min("EPOCH"), max("EPOCH")) // 86400000000 < 28 AS short FROM hist GROUP BY 1""")
def coverage(spark, sf):
    return robust.coverage(history(spark, sf), ["NORAD_CAT_ID"], "EPOCH", 28)


# A three-hourly index: mean of all events of three hours; the index has no value for those from nine.

SERIES = """kp AS (SELECT * FROM (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS datetime, round(avg(value), 6) AS kp FROM events GROUP BY 1) WHERE hour(datetime) <> 9)"""


def _series(spark, sf):
    e = table(spark, sf, "events")
    slot = F.floor(times.micros(F.col("ts")) / 10_800_000_000) * 3
    index = e.groupBy(F.timestamp_add("HOUR", slot, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("datetime")).agg(F.round(F.avg("value"), 6).alias("kp"))
    return index.filter(F.hour("datetime") != 9)


@query(f"""WITH {HISTORY}, {SERIES}, n AS (SELECT "GP_ID", "EPOCH", kp, datetime, abs(epoch_us(datetime) - epoch_us("EPOCH")) AS far, datetime <= "EPOCH" AND datetime + INTERVAL 3 HOUR > "EPOCH" AS holds FROM hist, kp)
SELECT "GP_ID", kp FROM n QUALIFY row_number() OVER (PARTITION BY "GP_ID" ORDER BY holds DESC, far, datetime) = 1""")
def index_at_epoch(spark, sf):
    return joins.covering_else_nearest(history(spark, sf), _series(spark, sf), "EPOCH", "datetime", "kp").select("GP_ID", "kp")


@query(f"""WITH {HISTORY}, {SERIES} SELECT "GP_ID", kp FROM hist LEFT JOIN kp ON datetime <= "EPOCH" AND datetime + INTERVAL 3 HOUR > "EPOCH" """)
def index_interval(spark, sf):
    return joins.covering(history(spark, sf), _series(spark, sf), "EPOCH", "datetime", "kp").select("GP_ID", "kp")


# As-of joins: purchases look up clicks of the same user.

SIDES = """l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS rt, max(event_id) AS rid FROM events WHERE event_type = 'click' GROUP BY ALL)"""


def _sides(spark, sf):
    e = table(spark, sf, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return left, e.filter("event_type = 'click'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("rid"))


@query(f"WITH {SIDES} SELECT event_id, rid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND ts >= rt")
def asof_backward(spark, sf):
    left, right = _sides(spark, sf)
    return joins.asof(left, right, ["user_id"], "ts", "at", ["rid"]).select("event_id", F.col("prev.rid").alias("rid"))


@query(f"WITH {SIDES} SELECT event_id, rid FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND ts > rt")
def asof_strict(spark, sf):
    left, right = _sides(spark, sf)
    return joins.asof(left, right, ["user_id"], "ts", "at", ["rid"], strict=True, bucket_seconds=86_400).select("event_id", F.col("prev.rid").alias("rid"))


@query(f"""WITH {SIDES}, n AS (SELECT event_id, rid, rt <= ts AS before, abs(epoch_us(rt) - epoch_us(ts)) AS far FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT event_id, rid FROM n QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY before DESC NULLS LAST, far) = 1""")
def asof_else_nearest(spark, sf):
    left, right = _sides(spark, sf)
    return joins.asof_else_next(left, right, ["user_id"], "ts", "at", ["rid"]).select("event_id", F.col("match.rid").alias("rid"))


@query(f"""WITH {SIDES}, n AS (SELECT event_id, rid, rt, abs(epoch_us(rt) - epoch_us(ts)) AS far FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT event_id, rid FROM n QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY far NULLS LAST, rt) = 1""")
def nearest_in_time(spark, sf):
    left, right = _sides(spark, sf)
    return joins.nearest(left, right, ["user_id"], "ts", "at", ["rid"]).select("event_id", F.col("match.rid").alias("rid"))


@query(f"""WITH {HISTORY} SELECT "NORAD_CAT_ID", "GP_ID" FROM hist QUALIFY row_number() OVER (PARTITION BY "NORAD_CAT_ID" ORDER BY "EPOCH" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 06:00:00' DESC,
  CASE WHEN "EPOCH" BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 06:00:00' THEN epoch_us("EPOCH") ELSE abs(epoch_us("EPOCH") - epoch_us(TIMESTAMP '2024-01-10')) END, "EPOCH") = 1""")
def inside_else_nearest(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return ephemeris.best_set(history(spark, sf), ["NORAD_CAT_ID"], at("2024-01-10"), at("2024-01-10 06:00:00")).select("NORAD_CAT_ID", "GP_ID")


@query(f"WITH {SIDES} SELECT event_id FROM l WHERE EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(epoch_us(rt) - epoch_us(ts)) <= 3600000000)")
def tolerance_semi(spark, sf):
    left, right = _sides(spark, sf)
    return joins.within_tolerance(left, right, ["user_id"], "ts", "at", 3600.0).select("event_id")


@query(f"WITH {SIDES} SELECT event_id FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = l.user_id AND abs(epoch_us(rt) - epoch_us(ts)) <= 3600000000)")
def tolerance_anti(spark, sf):
    left, right = _sides(spark, sf)
    return joins.within_tolerance(left, right, ["user_id"], "ts", "at", 3600.0, anti=True).select("event_id")


@query(f"""WITH {SIDES}, m AS (SELECT DISTINCT event_id FROM l JOIN r ON r.user_id = l.user_id AND abs(epoch_us(rt) - epoch_us(ts)) <= 3600000000),
n AS (SELECT DISTINCT r.user_id, rt FROM r JOIN l ON r.user_id = l.user_id AND abs(epoch_us(rt) - epoch_us(ts)) <= 3600000000)
SELECT (SELECT count(*) FROM l) AS "left", (SELECT count(DISTINCT (user_id, ts)) FROM l) AS left_distinct, (SELECT count(*) FROM r) AS "right", (SELECT count(DISTINCT (user_id, rt)) FROM r) AS right_distinct,
  (SELECT count(*) FROM m) AS left_matched, (SELECT count(DISTINCT (user_id, ts)) FROM l SEMI JOIN m USING (event_id)) AS left_matched_distinct, (SELECT count(*) FROM n) AS right_matched, (SELECT count(*) FROM n) AS right_matched_distinct""")
def reconcile_counts(spark, sf):
    left, right = _sides(spark, sf)
    return reconcile.summary(left.withColumnRenamed("ts", "epoch"), right.withColumnRenamed("at", "epoch"), ["user_id"], "epoch", 3600.0)


@query("""SELECT a.p_partkey AS one, b.p_partkey AS two FROM part a JOIN part b ON a.p_partkey < b.p_partkey AND a.p_retailprice <= b.p_retailprice + b.p_size / 10.0 AND b.p_retailprice <= a.p_retailprice + a.p_size / 10.0""")
def band_pairs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size") / 10.0).alias("hi"))
    return joins.overlapping_pairs(p, ("lo", "hi"), "p_partkey", 5.0)


@query(f"""WITH {INTERVALS} SELECT a.event_id AS one, b.event_id AS two FROM iv a JOIN iv b ON a.sensor = b.sensor AND a.event_id < b.event_id AND a.t_aos < b.t_los AND a.t_los > b.t_aos""")
def window_conflicts(spark, sf):
    i = intervals(spark, sf).withColumn("a", times.micros(F.col("t_aos"))).withColumn("l", times.micros(F.col("t_los")))
    return joins.overlaps(i, i, ("a", "l"), ("a", "l"), 3_600e6, ["sensor"], strict=True).filter("l.event_id < r.event_id").select(F.col("l.event_id").alias("one"), F.col("r.event_id").alias("two"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def seen_by_all(spark, sf):
    e = table(spark, sf, "events")
    return joins.in_all(e, "user_id", "event_type", e)


@query("""WITH g AS (SELECT user_id, day AS t FROM (SELECT DISTINCT user_id FROM events), (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS day)),
s AS (SELECT user_id, ts, value, lead(ts) OVER w AS t1, lead(value) OVER w AS v1, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT g.user_id, t, ts, value, t1, v1, ts <= t AS before FROM g JOIN s ON g.user_id = s.user_id AND t1 IS NOT NULL),
p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY user_id, t ORDER BY before DESC, CASE WHEN before THEN -epoch_us(ts) ELSE epoch_us(ts) END) = 1)
SELECT user_id, t, round((1 - (epoch_us(t) - epoch_us(ts)) / (epoch_us(t1) - epoch_us(ts))) * value + (epoch_us(t) - epoch_us(ts)) / (epoch_us(t1) - epoch_us(ts)) * v1, 4) AS value FROM p""")
def interpolated(spark, sf):
    e = table(spark, sf, "events")
    days = spark.range(31).select(F.timestamp_add("DAY", F.col("id"), F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")).alias("t"))
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(days))
    return joins.interpolate(grid, e.select("user_id", "ts", "value"), ["user_id"], "t", "ts", ["value"]).select("user_id", "t", F.round("value", 4).alias("value"))


# Runs: samples of a user above a value.

RUNS = """s AS (SELECT user_id, event_id, ts, value, value > 200 AS v FROM events), c AS (SELECT *, CASE WHEN v AND NOT coalesce(lag(v) OVER (PARTITION BY user_id ORDER BY ts), false) THEN 1 ELSE 0 END AS b FROM s),
i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM c)"""


def _samples(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value", (F.col("value") > 200).alias("v"))


@query(f"""WITH {RUNS} SELECT user_id, min(ts) AS aos, max(ts) + INTERVAL 30 SECOND AS los, max(value) AS max_el_deg, arg_min(ts, (-value, ts)) AS max_el_time, min(value) AS min_range_km, count(*) * 30.0::DOUBLE AS duration_s
FROM i WHERE v GROUP BY user_id, island HAVING count(*) * 30 >= 60""")
def passes(spark, sf):
    return windows.passes(_samples(spark, sf), ["user_id"], "ts", "v", "value", "value", 30.0, 60.0)


@query(f"""WITH {RUNS} SELECT user_id, min(ts) AS start, CASE WHEN count(*) = 1 THEN min(ts) + INTERVAL 15 SECOND ELSE max(ts) END AS "end" FROM i WHERE v GROUP BY user_id, island""")
def sub_intervals(spark, sf):
    return windows.sub_intervals(_samples(spark, sf), ["user_id"], "ts", "v")


@query("""WITH e AS (SELECT user_id, ts, event_id % 3 AS k FROM events WHERE event_id % 3 <> 1), p AS (SELECT *, lag(k) OVER w AS lk, lag(ts) OVER w AS lt FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, k))
SELECT user_id, lt AS rise, ts AS "set" FROM p WHERE k = 2 AND lk = 0""")
def rise_set(spark, sf):
    e = table(spark, sf, "events").select("user_id", "ts", (F.col("event_id") % 3).alias("k"))
    return windows.rise_set(e, ["user_id"], "ts", "k")


@query(f"""WITH {INTERVALS} SELECT event_id, CAST(floor(floor(greatest(0.0, (epoch_us(t_aos) - epoch_us(coalesce(lag(t_aos) OVER (PARTITION BY norad_id ORDER BY t_aos, event_id), TIMESTAMP '2024-01-01'))) / 1000000.0)) / 60) AS BIGINT) AS weight FROM iv""")
def opportunity_weights(spark, sf):
    return schedule.weights(intervals(spark, sf), F.lit("2024-01-01").cast("timestamp_ntz"), tie="event_id").select("event_id", "weight")


@query(f"""WITH {INTERVALS}, e AS (SELECT sensor, t_aos AS t, 1 AS d FROM iv UNION ALL SELECT sensor, t_los, -1 FROM iv), m AS (SELECT sensor, t, sum(d) AS d FROM e GROUP BY ALL),
a AS (SELECT sensor, t AS f, lead(t) OVER w AS u, sum(d) OVER w AS n FROM m WINDOW w AS (PARTITION BY sensor ORDER BY t)),
x AS (SELECT a.sensor, f, u, list_sort(list_distinct(list(norad_id))) AS items FROM a JOIN iv ON a.sensor = iv.sensor AND t_aos <= f AND t_los >= u WHERE n >= 2 AND u IS NOT NULL GROUP BY ALL),
k AS (SELECT *, CASE WHEN lag(u) OVER w = f AND lag(items) OVER w = items THEN 0 ELSE 1 END AS b FROM x WHERE len(items) >= 2 WINDOW w AS (PARTITION BY sensor ORDER BY f)),
r AS (SELECT *, sum(b) OVER (PARTITION BY sensor ORDER BY f) AS run FROM k)
SELECT sensor, min(f) AS "from", max(u) AS "to", array_to_string(items, ',') AS items, CAST(len(items) AS INTEGER) AS n FROM r GROUP BY sensor, run, items""")
def simultaneous_contacts(spark, sf):
    found = tasking.simultaneous(intervals(spark, sf))
    return found.withColumn("items", F.array_join(F.transform("items", lambda x: x.cast("string")), ","))


@query("""WITH p AS (SELECT user_id, ts, (event_id * 73) % 360 - 180 AS lon FROM events), j AS (SELECT *, CASE WHEN abs(lon - lag(lon) OVER (PARTITION BY user_id ORDER BY ts)) > 180 THEN 1 ELSE 0 END AS c FROM p)
SELECT user_id, ts, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS segment FROM j""")
def antimeridian(spark, sf):
    p = table(spark, sf, "events").select("user_id", "ts", ((F.col("event_id") * 73) % 360 - 180).alias("lon"))
    return windows.segments(p, ["user_id"], "ts", "lon").select("user_id", "ts", F.col("segment").cast("long").alias("segment"))


@query("""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, sum(event_id)::DOUBLE AS f FROM events GROUP BY ALL)
SELECT user_id, day, round(avg(f) OVER (PARTITION BY user_id ORDER BY day - DATE '1970-01-01' RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING), 4) AS mean FROM d""")
def centred_mean(spark, sf):
    d = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum("event_id").cast("double").alias("f"))
    return d.select("user_id", "day", F.round(windows.centred_mean(d, ["user_id"], "day", "f", 4), 4).alias("mean"))


@query(f"""WITH {INTERVALS}, s AS (SELECT *, event_id % 4 = 0 AS sel FROM iv), m AS (SELECT norad_id, t_aos AS t, 1 AS k FROM s WHERE sel UNION ALL SELECT DISTINCT norad_id, TIMESTAMP '2024-01-01', 0 FROM s UNION ALL SELECT DISTINCT norad_id, TIMESTAMP '2024-02-01', 0 FROM s),
g AS (SELECT *, (epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY norad_id ORDER BY t))) / 60000000.0 AS gap FROM m)
SELECT norad_id, CAST(sum(k) AS BIGINT) AS n_tracks, round(avg(gap), 4) AS avg_gap_min, round(max(gap), 4) AS max_gap_min FROM g GROUP BY 1""")
def revisit_stats(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    i = intervals(spark, sf).withColumn("selected", F.col("event_id") % 4 == 0)
    out = windows.revisit_gaps(i, "norad_id", "t_aos", "selected", at("2024-01-01"), at("2024-02-01"))
    return out.select("norad_id", "n_tracks", F.round("avg_gap_min", 4).alias("avg_gap_min"), F.round("max_gap_min", 4).alias("max_gap_min"))


@query("""WITH g AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-30', INTERVAL 6 HOUR)) AS t), k AS (SELECT user_id, t FROM g, (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')),
p AS (SELECT k.user_id, t, max(ts) AS last FROM k JOIN events e ON e.user_id = k.user_id AND e.event_type = 'click' AND ts <= t GROUP BY ALL)
SELECT t, round(avg((epoch_us(t) - epoch_us(last)) / 3600000000.0), 6) AS age_h, count(*) AS n FROM p GROUP BY 1""")
def fleet_age(spark, sf):
    tracks = table(spark, sf, "events").filter("event_type = 'click'").select("user_id", F.col("ts").alias("track"))
    grid = spark.range(28 * 4 + 1).select(F.timestamp_add("HOUR", F.col("id") * 6, F.expr("TIMESTAMP_NTZ'2024-01-02 00:00:00'")).alias("t"))
    return windows.fleet_age(tracks, "user_id", "track", grid, "t").select("t", F.round("age_h", 6).alias("age_h"), "n")


PHASES = """ph AS (SELECT * FROM (VALUES (0, 'one', TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-10'), (1, 'two', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-15'), (2, 'three', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-28'), (3, 'four', TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-02')) t(ordinal, phase, first, last))"""


def _phases(spark):
    from datetime import datetime as d

    return spark.createDataFrame([(0, "one", d(2024, 1, 2), d(2024, 1, 10)), (1, "two", d(2024, 1, 10), d(2024, 1, 15)), (2, "three", d(2024, 1, 20), d(2024, 1, 28)), (3, "four", d(2025, 1, 1), d(2025, 1, 2))], "ordinal int, phase string, first timestamp_ntz, last timestamp_ntz")


@query(f"""WITH {PHASES}, a AS (SELECT event_id, arg_min(phase, ordinal) AS phase FROM events JOIN ph ON ts BETWEEN first AND last GROUP BY 1) SELECT coalesce(phase, 'Gap/unphased') AS phase, count(*) AS n FROM events LEFT JOIN a USING (event_id) GROUP BY 1""")
def phase_counts(spark, sf):
    return proximity.phase_of(table(spark, sf, "events"), "ts", _phases(spark)).groupBy("phase").agg(F.count("*").alias("n"))


@query(f"""WITH {PHASES}, m AS (SELECT ordinal, arg_min(ts, (value, ts)) AS t, min(value) AS sep_km FROM ph JOIN events ON ts BETWEEN first AND last GROUP BY 1)
SELECT ph.ordinal, phase, t, coalesce(sep_km, 'infinity'::DOUBLE) AS sep_km FROM ph LEFT JOIN m USING (ordinal)""")
def phase_minimum(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").alias("t"), F.col("value").alias("sep_km"))
    return proximity.closest_by_phase(e, _phases(spark))


@query("SELECT ts AS t, value AS sep_km FROM events ORDER BY value, ts LIMIT 1")
def closest_approach(spark, sf):
    return proximity.closest(table(spark, sf, "events").select(F.col("ts").alias("t"), F.col("value").alias("sep_km")))


@query(f"""WITH {INTERVALS} SELECT sensor, count(*) AS contacts, round(sum((epoch_us(t_los) - epoch_us(t_aos)) / 60000000.0), 6) AS minutes FROM iv GROUP BY 1""")
def contact_summary(spark, sf):
    return tasking.contacts(intervals(spark, sf)).withColumn("minutes", F.round("minutes", 6))


@query(f"""WITH {INTERVALS} SELECT norad_id AS "NORAD_CAT_ID", count(*) FILTER (sensor = 0) AS p0, round(sum((epoch_us(t_los) - epoch_us(t_aos)) / 60000000.0) FILTER (sensor = 0), 6) AS m0, count(*) FILTER (sensor = 3) AS p3, max(event_id) FILTER (sensor = 3) AS b3, count(*) FILTER (sensor IN (1, 2, 4)) AS others FROM iv GROUP BY 1""")
def pass_matrix(spark, sf):
    i = intervals(spark, sf).select(F.col("norad_id").alias("NORAD_CAT_ID"), "sensor", (F.timestamp_diff("MICROSECOND", "t_aos", "t_los") / 1e6).alias("duration_s"), F.col("event_id").alias("max_el_deg"))
    who = i.select("NORAD_CAT_ID").distinct().select("NORAD_CAT_ID", *[F.lit("x").alias(c) for c in ("OBJECT_NAME", "OBJECT_TYPE", "RCS_SIZE")])
    m = visibility.matrix(i, who, [0, 1, 2, 3, 4])
    others = sum((F.coalesce(F.col(f"{s}_passes"), F.lit(0)) for s in (1, 2, 4)), F.lit(0))
    return m.select("NORAD_CAT_ID", F.coalesce("0_passes", F.lit(0)).alias("p0"), F.col("0_minutes").alias("m0"), F.coalesce("3_passes", F.lit(0)).alias("p3"), F.col("3_best_el_deg").alias("b3"), others.alias("others"))


@query(f"""WITH {INTERVALS} SELECT sensor, count(DISTINCT norad_id) AS objects, count(*) AS passes FROM iv GROUP BY 1""")
def sensor_totals(spark, sf):
    return visibility.by_sensor(intervals(spark, sf).withColumnRenamed("norad_id", "NORAD_CAT_ID"))


@query(f"""WITH {INTERVALS}, s AS (SELECT *, event_id % 3 = 0 AS selected FROM iv) SELECT sensor, count(*) FILTER (selected) AS scheduled, count(*) FILTER (NOT selected) AS skipped, count(*) AS available FROM s GROUP BY 1""")
def selection_counts(spark, sf):
    return tasking.selection(intervals(spark, sf).withColumn("selected", F.col("event_id") % 3 == 0))


@query(f"""WITH {INTERVALS}, s AS (SELECT *, event_id % 2 = 0 AS sel FROM iv), k AS (SELECT s.*, (epoch_us(t_aos) - epoch_us(coalesce((SELECT max(x.t_aos) FROM s x WHERE x.sel AND x.norad_id = s.norad_id AND x.t_aos < s.t_aos), TIMESTAMP '2024-01-01'))) / 1000000.0 AS st FROM s)
SELECT a.sensor, a.norad_id AS skipped, a.t_aos AS skipped_aos, round(a.st, 3) AS skipped_staleness_s, b.norad_id AS winner, b.t_aos AS winner_aos, round(b.st, 3) AS winner_staleness_s, b.st < a.st AS violation
FROM k a JOIN k b ON NOT a.sel AND b.sel AND a.sensor = b.sensor AND b.t_aos < a.t_los AND b.t_los > a.t_aos""")
def conflict_audit(spark, sf):
    i = intervals(spark, sf).withColumn("selected", F.col("event_id") % 2 == 0)
    out = schedule.audit(i, F.lit("2024-01-01").cast("timestamp_ntz"))
    return out.withColumn("skipped_staleness_s", F.round("skipped_staleness_s", 3)).withColumn("winner_staleness_s", F.round("winner_staleness_s", 3))


@query()
def tasking_schedule(spark, sf):
    """The best schedule itself is no SQL; tests hold it against exhaustive search."""
    weighted = schedule.weights(intervals(spark, sf), F.lit("2024-01-01").cast("timestamp_ntz"), tie="event_id")
    return schedule.choose(weighted).groupBy("sensor").agg(F.count_if("selected").alias("selected"), F.sum(F.when(F.col("selected"), F.col("weight"))).alias("weight"))


@query(f"""WITH RECURSIVE {INTERVALS}, w AS (SELECT sensor, event_id, epoch_us(t_aos) // 1000000 AS s, greatest(epoch_us(t_los) // 1000000, epoch_us(t_aos) // 1000000 + 15) AS e,
  CAST(floor(floor(greatest(0.0, (epoch_us(t_aos) - epoch_us(coalesce(lag(t_aos) OVER (PARTITION BY norad_id ORDER BY t_aos, event_id), TIMESTAMP '2024-01-01'))) / 1000000.0)) / 60) AS BIGINT) AS weight FROM iv),
o AS (SELECT *, row_number() OVER (PARTITION BY sensor ORDER BY e, s, event_id) AS k FROM w), m AS (SELECT sensor, e AS t, 0 AS kind, 1 AS n, CAST(NULL AS BIGINT) AS k FROM o UNION ALL SELECT sensor, s, 1, 0, k FROM o),
c AS (SELECT sensor, kind, k, CAST(sum(n) OVER (PARTITION BY sensor ORDER BY t, kind ROWS UNBOUNDED PRECEDING) AS BIGINT) AS j FROM m), j AS (SELECT o.sensor, o.k, o.weight, c.j FROM o JOIN c ON c.kind = 1 AND c.sensor = o.sensor AND c.k = o.k),
r AS (SELECT DISTINCT sensor, CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT)] AS v FROM w UNION ALL SELECT r.sensor, r.k + 1, list_append(r.v, greatest(r.v[r.k + 1], r.v[j.j + 1] + j.weight)) FROM r JOIN j ON j.sensor = r.sensor AND j.k = r.k + 1)
SELECT sensor, arg_max(v[k + 1], k) AS weight FROM r GROUP BY 1""")
def schedule_value(spark, sf):
    """The greatest sum of weights without overlap, which is one, whatever windows give it."""
    weighted = schedule.weights(intervals(spark, sf), F.lit("2024-01-01").cast("timestamp_ntz"), tie="event_id")
    return schedule.choose(weighted).groupBy("sensor").agg(F.sum(F.when(F.col("selected"), F.col("weight")).otherwise(0)).alias("weight"))


@query(f"""WITH {LATEST} SELECT "OBJECT_TYPE" AS object_type, round(quantile_cont("PERIAPSIS", 0.95), 6) AS p95 FROM gp GROUP BY 1""")
def percentile_95(spark, sf):
    return latest(spark, sf).groupBy(F.col("OBJECT_TYPE").alias("object_type")).agg(F.round(F.percentile("PERIAPSIS", F.lit(0.95)), 6).alias("p95"))

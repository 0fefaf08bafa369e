"""Questions to the catalogue.  Each returns a DataFrame; filters reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sensors import least_altitude
from .joins import overlaps

#: Kilometres of altitude in a bucket of `in_reach`.
REACH_KM = 500.0

# Names of the joined view that differ from those of its tables.
GP_NAMES = {"INCLINATION": "GP_INCLINATION", "PERIOD": "GP_PERIOD", "OBJECT_TYPE": "GP_OBJECT_TYPE", "RCS_SIZE": "GP_RCS_SIZE", "ingested_at": "gp_ingested_at"}
SAT_NAMES = {"OBJECT_TYPE": "SAT_OBJECT_TYPE", "RCS_SIZE": "SAT_RCS_SIZE", "ingested_at": "sat_ingested_at"}
VIEW_GP = "NORAD_CAT_ID OBJECT_NAME OBJECT_ID EPOCH MEAN_MOTION ECCENTRICITY INCLINATION RA_OF_ASC_NODE ARG_OF_PERICENTER MEAN_ANOMALY BSTAR SEMIMAJOR_AXIS PERIOD APOAPSIS PERIAPSIS OBJECT_TYPE RCS_SIZE COUNTRY_CODE DECAY_DATE TLE_LINE0 TLE_LINE1 TLE_LINE2".split()
VIEW_SAT = "SATNAME INTLDES OBJECT_TYPE COUNTRY LAUNCH SITE DECAY APOGEE PERIGEE RCS_SIZE CURRENT".split()


def catalog_view(gp: DataFrame, satcat: DataFrame) -> DataFrame:
    """Latest element sets with what the catalogue says of the object, if anything."""
    g, s = gp.alias("g"), satcat.alias("s")
    joined = g.join(s, F.col("g.NORAD_CAT_ID") == F.col("s.NORAD_CAT_ID"), "left")
    return joined.select(
        *[F.col(f"g.{c}").alias(GP_NAMES.get(c, c)) for c in VIEW_GP], *[F.col(f"s.{c}").alias(SAT_NAMES.get(c, c)) for c in VIEW_SAT],
        F.col("g.ingested_at").alias(GP_NAMES["ingested_at"]), F.col("s.ingested_at").alias(SAT_NAMES["ingested_at"]),
    )


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, if there is one."""
    return rows.filter(F.col(key) == value).limit(1)


def tle(gp: DataFrame, norad: int) -> DataFrame:
    return one(gp, "NORAD_CAT_ID", norad).select("TLE_LINE0", "TLE_LINE1", "TLE_LINE2")


def object_name(gp: DataFrame, norad: int) -> DataFrame:
    return one(gp, "NORAD_CAT_ID", norad).select("OBJECT_NAME")


def in_band(rows: DataFrame, lo: float, hi: float, peri: str = "PERIAPSIS", apo: str = "APOAPSIS") -> DataFrame:
    """Objects whose altitudes overlap [lo, hi], ends included."""
    return rows.filter((F.col(peri) <= hi) & (F.col(apo) >= lo))


def candidates(gp: DataFrame, primary: int, pad_km: float = 50.0) -> DataFrame:
    """Objects that can come near a primary: padded band, with element sets, without itself."""
    bounds = gp.filter(F.col("NORAD_CAT_ID") == primary).limit(1).select((F.col("PERIAPSIS") - pad_km).alias("__lo"), (F.col("APOAPSIS") + pad_km).alias("__hi"))
    found = gp.crossJoin(F.broadcast(bounds)).filter((F.col("PERIAPSIS") <= F.col("__hi")) & (F.col("APOAPSIS") >= F.col("__lo")))  # one row
    return found.filter((F.col("NORAD_CAT_ID") != primary) & F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull()).drop("__lo", "__hi")


def in_reach(gp: DataFrame, sensors: DataFrame) -> DataFrame:
    """(sensor columns, object columns) of all objects whose altitudes a sensor reaches: an overlap of two spans, of any number of sensors."""
    s = sensors.select(F.struct(*sensors.columns).alias("sensor"), F.col("MAX_RANGE_KM").cast("double").alias("__hi"), least_altitude(F.col("MIN_RANGE_KM"), F.col("MIN_EL_DEG")).alias("__lo"))
    flying = gp.filter(F.col("TLE_LINE1").isNotNull() & F.col("TLE_LINE2").isNotNull())
    met = overlaps(flying, s, ("PERIAPSIS", "APOAPSIS"), ("__lo", "__hi"), REACH_KM)
    return met.select("l.*", F.col("r.sensor").alias("sensor"))


def by_type(rows: DataFrame, object_type: str, column: str = "OBJECT_TYPE") -> DataFrame:
    return rows.filter(F.col(column) == object_type)


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Without regard to case."""
    return rows.filter(F.col(column).ilike(f"{prefix}%"))


def first_by_name(rows: DataFrame, column: str, part: str, order: str) -> DataFrame:
    """The first row whose name has the part, without regard to case; % and _ in it are wild."""
    return rows.filter(F.col(column).ilike(f"%{part}%")).orderBy(order).limit(1)


def sensors_named(sensors: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """For each name the sensors called so, or, if there is none, those whose name has it; `asked` is the name."""
    wanted = names.select(F.trim(F.col(name)).alias("asked")).distinct()  # what a command line or a report asks for
    exact = sensors.join(wanted, F.upper("NAME") == F.upper("asked"))
    rest = wanted.join(exact.select("asked").distinct(), "asked", "left_anti")
    like = sensors.join(F.broadcast(rest), F.ilike("NAME", F.concat(F.lit("%"), F.col("asked"), F.lit("%"))))
    return exact.unionByName(like)


def by_ids(rows: DataFrame, column: str, ids: list[int] | DataFrame) -> DataFrame:
    """Rows whose id is in the list (or in the first column of a DataFrame)."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")
    return rows.filter(F.col(column).isin(*ids)) if ids else rows.limit(0)


def where(rows: DataFrame, *tests: Column | None) -> DataFrame:
    """All of the tests that are given."""
    given = [t for t in tests if t is not None]
    return rows.filter(reduce(lambda a, b: a & b, given)) if given else rows


def maneuvers(found: DataFrame, gp: DataFrame, norad: int | None = None, since: str | None = None, limit: int = 100) -> DataFrame:
    """The latest detections with the object's name; since: epochs after this text."""
    tests = (F.col("NORAD_CAT_ID") == norad if norad is not None else None, F.date_format("EPOCH_AFTER", "yyyy-MM-dd'T'HH:mm:ss") > since if since is not None else None)
    kept = where(found, *tests)
    named = kept.join(gp.select("NORAD_CAT_ID", "OBJECT_NAME"), "NORAD_CAT_ID", "left")
    return named.orderBy(F.col("EPOCH_AFTER").desc_nulls_last(), "NORAD_CAT_ID", "EPOCH_BEFORE").limit(limit)


def maneuvering(found: DataFrame, since: str | None = None) -> DataFrame:
    """Objects with detections."""
    kept = where(found, F.date_format("EPOCH_AFTER", "yyyy-MM-dd'T'HH:mm:ss") > since if since is not None else None)
    return kept.select("NORAD_CAT_ID").distinct().orderBy("NORAD_CAT_ID")


def maneuver_history(found: DataFrame, norad: int) -> DataFrame:
    return found.filter(F.col("NORAD_CAT_ID") == norad).orderBy("EPOCH_AFTER", "EPOCH_BEFORE")


def counts(rows: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Rows of each value, most first, equal counts by value."""
    out = rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_first())
    return out.limit(top) if top is not None else out


def epoch_range(rows: DataFrame, column: str = "EPOCH") -> DataFrame:
    return rows.agg(F.min(column).alias("oldest_epoch"), F.max(column).alias("newest_epoch"))


def epoch_range_of(rows: DataFrame, ids: DataFrame, column: str, default_start: Column, default_end: Column) -> DataFrame:
    """The range over objects, or the defaults if they have no rows."""
    found = by_ids(rows, "NORAD_CAT_ID", ids).agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return found.select(F.coalesce("a", default_start).alias("start"), F.coalesce("b", default_end).alias("end"))


def range_by(rows: DataFrame, column: str, value: str) -> DataFrame:
    """Least and greatest of each group, greatest first."""
    return rows.groupBy(column).agg(F.min(value).alias("least"), F.max(value).alias("greatest")).orderBy(F.col("greatest").desc(), column)


def first_objects(rows: DataFrame, by: str, n: int = 50) -> DataFrame:
    """All rows of the first n objects, and `more`: how many objects there are besides."""
    first = rows.select(by).distinct().orderBy(by).limit(n)
    total = rows.agg(F.countDistinct(by).alias("__n"))  # one row
    kept = rows.join(F.broadcast(first), by, "left_semi").crossJoin(F.broadcast(total))
    return kept.withColumn("more", F.greatest(F.col("__n") - n, F.lit(0))).drop("__n")


def duplicates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Values that occur more than once, and how often."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def missing_from(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Distinct values of left that right does not have."""
    return left.select(column).distinct().join(right.select(column).distinct(), column, "left_anti")


def pivot_counts(rows: DataFrame, group: str, column: str, values: list[str] | None = None) -> DataFrame:
    """Rows of each group as a column for each value, 0 where there is none."""
    return rows.groupBy(group).pivot(column, values).count().na.fill(0)


def history_of(history: DataFrame, norad: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """The history of an object within dates, without sets of one epoch but the last; the day of `end` up to its last whole second."""
    from .dedupe import keep_last

    text = F.date_format("EPOCH", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kept = where(history.filter(F.col("NORAD_CAT_ID") == norad), text >= start if start else None, text <= f"{end}T23:59:59" if end else None)
    return keep_last(kept, ["NORAD_CAT_ID"], "EPOCH", "GP_ID").orderBy("EPOCH")

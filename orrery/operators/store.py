"""Tables as DataFrames: upserts, archiving, insert-or-ignore, watermarks.

Every operator takes the stored rows and the incoming rows and returns the new
rows; `save` replaces a table on disk, and `bootstrap` ends a replacement that
was broken off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import MANEUVER_KEY, SENSOR_KEY, TABLES

#: Rows in a file at most, the nearest thing to a batch of an insert.
BATCH_ROWS = 5_000_000


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[list[str]], order: Column | None = None) -> DataFrame:
    """Stored and incoming rows after each incoming row, in order, has replaced all rows it shares a key with.

    keys: the unique keys of the table, each a list of columns.  A row stays if
    no later row shares any of its keys, so a row that was replaced later has
    still replaced others.  A null in a key shares nothing.
    """
    order = F.monotonically_increasing_id() if order is None else order
    both = stored.withColumn("__src", F.lit(0)).withColumn("__seq", F.lit(None).cast("long")).unionByName(incoming.withColumn("__src", F.lit(1)).withColumn("__seq", order.cast("long")), allowMissingColumns=True)
    for i, key in enumerate(keys):
        known = F.col(key[0]).isNotNull()
        for c in key[1:]:
            known = known & F.col(c).isNotNull()
        # Rows without a key share nothing, so each is dealt by itself.
        both = both.withColumn("__alone", F.when(~known, F.monotonically_increasing_id()))
        w = Window.partitionBy(*key, "__alone").orderBy(F.col("__src"), F.col("__seq"))
        both = both.withColumn(f"__later{i}", known & F.lead(F.lit(True), 1, False).over(w)).drop("__alone")
    for i in range(len(keys)):
        both = both.filter(~F.col(f"__later{i}"))
    return both.drop("__src", "__seq", *[f"__later{i}" for i in range(len(keys))])


def upsert_elements(gp: DataFrame, incoming: DataFrame, order: Column | None = None) -> DataFrame:
    """The latest element set of each object: unique by set and by object."""
    return upsert(gp, incoming, [["GP_ID"], ["NORAD_CAT_ID"]], order)


def upsert_catalog(satcat: DataFrame, incoming: DataFrame, order: Column | None = None) -> DataFrame:
    """Metadata by object; objects that are missing from the incoming rows stay."""
    return upsert(satcat, incoming, [["NORAD_CAT_ID"]], order)


def upsert_sensors(sensors: DataFrame, incoming: DataFrame, order: Column | None = None) -> DataFrame:
    """Sensors by name and place; the id is a hash of these, so that it survives a replacement."""
    named = incoming.withColumn("SENSOR_ID", F.xxhash64(*SENSOR_KEY))
    return upsert(sensors, named, [list(SENSOR_KEY)], order)


def archive(gp: DataFrame, history: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gp, history) after the sets of all incoming objects have moved to the history, sets it has already left out."""
    ids = incoming.select("NORAD_CAT_ID").distinct()
    moved = gp.join(ids, "NORAD_CAT_ID", "left_semi").join(history.select("GP_ID"), "GP_ID", "left_anti")
    return gp.join(ids, "NORAD_CAT_ID", "left_anti"), history.unionByName(moved.select(history.columns))


def insert_ignore(stored: DataFrame, incoming: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """Stored rows, and the first incoming row of each key that is new."""
    order = F.monotonically_increasing_id() if order is None else order
    w = Window.partitionBy(*key).orderBy(order)
    first = incoming.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    fresh = first.join(stored.select(*key).distinct(), key, "left_anti")
    return stored.unionByName(fresh, allowMissingColumns=True)


def insert_counts(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """(inserted, skipped) of `insert_ignore`: one row."""
    fresh = incoming.select(*key).distinct().join(stored.select(*key).distinct(), key, "left_anti").agg(F.count("*").alias("inserted"))
    return incoming.agg(F.count("*").alias("n")).crossJoin(fresh).select("inserted", (F.col("n") - F.col("inserted")).alias("skipped"))


def detections(pairs: DataFrame) -> DataFrame:
    """Rows for the table of maneuvers: what was flagged, signed differences, null for elements that are not tracked."""
    none = F.lit(None).cast("double")
    return pairs.filter("likely_maneuver").select(
        F.col("NORAD_CAT_ID"), F.col("epoch_from").alias("EPOCH_BEFORE"), F.col("epoch_to").alias("EPOCH_AFTER"), F.col("delta_sma").alias("DELTA_SMA"), F.col("delta_ecc").alias("DELTA_ECCENTRICITY"),
        F.col("delta_inc").alias("DELTA_INCLINATION"), *[none.alias(c) for c in ("DELTA_RAAN", "DELTA_PERIOD", "DELTA_APOAPSIS", "DELTA_PERIAPSIS")],
        F.col("classification").alias("CLASSIFICATION"), F.col("kp").alias("KP"), F.col("vel_residual_ms").alias("VEL_RESIDUAL_MS"), F.col("delta_bstar").alias("BSTAR_DELTA"),
    )


def insert_detections(maneuvers: DataFrame, found: DataFrame) -> DataFrame:
    """New detections get an id from their key and the time of insertion."""
    named = found.withColumn("id", F.xxhash64(*MANEUVER_KEY)).withColumn("detected_at", F.current_timestamp().cast("timestamp_ntz"))
    return insert_ignore(maneuvers, named, list(MANEUVER_KEY))


def watermark(meta: DataFrame, key: str, value: Column | str) -> DataFrame:
    """The key-value table with one key set."""
    row = meta.sparkSession.range(1).select(F.lit(key).alias("key"), (F.lit(value) if isinstance(value, str) else value).cast("string").alias("value"))
    return meta.filter(F.col("key") != key).unionByName(row)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def bootstrap(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables below root; those that are missing are made, columns that are missing are null."""
    out = {}
    for name, schema in TABLES.items():
        path = f"{root}/{name}"
        if not settle(spark, path):
            empty(spark, schema).write.parquet(path)
        out[name] = migrate(spark.read.parquet(path), schema)
    return out


def migrate(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of the schema, in its order; a missing one is null, others are left out."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def _paths(spark: SparkSession, path: str) -> tuple:
    """The file system, and the table's folder, the one that is written, and the one that was replaced."""
    to, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new", f"{path}.old"))
    return to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to, new, old


def settle(spark: SparkSession, path: str) -> bool:
    """End a replacement that was broken off; whether there is a table.

    Where the folder is missing, the new rows take its place if they were
    written whole, else the old ones come back.
    """
    fs, to, new, old = _paths(spark, path)
    if not fs.exists(to):
        for other in (new, old):
            if fs.exists(other) and (other == old or fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.new/_SUCCESS"))):
                fs.rename(other, to)
                break
    return bool(fs.exists(to))


def save(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write beside the table, then put it in its place.

    Between the two moves there is no table; whoever comes then, or after a
    stop there, calls `settle`, as `bootstrap` does.
    """
    spark = rows.sparkSession
    writer = rows.write.mode("overwrite").option("maxRecordsPerFile", BATCH_ROWS)
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}.new")
    fs, to, new, old = _paths(spark, path)
    fs.delete(old, True)
    if fs.exists(to):
        fs.rename(to, old)
    fs.rename(new, to)
    fs.delete(old, True)

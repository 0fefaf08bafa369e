"""Element sets as text, precise orbits as XML, and conjunction messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import parse_time, tle_epoch


def tle_text(spark: SparkSession, path: str) -> DataFrame:
    """(name, line1, line2, epoch) of files with three-line and two-line records, mixed; lines that form no record are passed over.

    A file is read whole, as its lines only mean something in order.
    """
    return tle_records(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"))


def tle_records(files: DataFrame) -> DataFrame:
    """(file, line, name, line1, line2, epoch) of whole files (file, value)."""
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = files.select("file", lines.alias("l")).select("file", "l", F.posexplode("l").alias("i", "line1"))
    first, second = F.col("line1").startswith("1 "), F.coalesce(F.get("l", F.col("i") + 1).startswith("2 "), F.lit(False))
    before = F.when(F.col("i") > 0, F.get("l", F.col("i") - 1))
    title = before.isNotNull() & ~before.startswith("1 ") & ~before.startswith("2 ")
    found = rows.filter(first & second).select("file", F.col("i").alias("line"), F.when(title, before).otherwise(F.concat(F.lit("CATNR "), F.trim(F.substring("line1", 3, 5)))).alias("name"), "line1", F.get("l", F.col("i") + 1).alias("line2"))
    return found.withColumn("epoch", tle_epoch(F.col("line1"))).filter(F.col("epoch").isNotNull())


def precise_orbit(spark: SparkSession, path: str) -> DataFrame:
    """(utc, x, y, z, vx, vy, vz) of a file of orbit state vectors: metres and metres a second, Earth-fixed."""
    leaf = "struct<_VALUE:double,_unit:string>"
    schema = f"UTC string, X {leaf}, Y {leaf}, Z {leaf}, VX {leaf}, VY {leaf}, VZ {leaf}"
    rows = spark.read.format("xml").option("rowTag", "OSV").option("ignoreNamespace", "true").schema(schema).load(path)
    utc = parse_time(F.replace(F.trim("UTC"), F.lit("UTC="), F.lit("")))
    return rows.select(utc.alias("utc"), *[F.col(f"{c}._VALUE").alias(c.lower()) for c in ("X", "Y", "Z", "VX", "VY", "VZ")]).filter(F.col("utc").isNotNull())


def conjunction_messages(spark: SparkSession, path: str) -> DataFrame:
    """Typed messages; metres become kilometres, a missing or blank probability is null, a time that cannot be read raises."""
    return typed_messages(spark.read.schema(", ".join(f"{n} string" for n in MESSAGE)).json(path, multiLine=True, primitivesAsString=True))


# Fields of a conjunction message.
MESSAGE = ["CDM_ID", "TCA", "MIN_RNG", "PC", "SAT_1_ID", "SAT_1_NAME", "SAT1_OBJECT_TYPE", "SAT1_RCS", "SAT_2_ID", "SAT_2_NAME", "SAT2_OBJECT_TYPE", "SAT2_RCS"]


def typed_messages(raw: DataFrame) -> DataFrame:
    """`conjunction_messages` from records that are all text."""
    number = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")).cast("double")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    at = parse_time(F.col("TCA"))
    tca = F.when(at.isNull(), F.raise_error(F.concat(F.lit("no time: "), F.coalesce(F.col("TCA"), F.lit("null")))).cast("timestamp_ntz")).otherwise(at)
    return raw.select(
        F.col("CDM_ID").alias("cdm_id"), tca.alias("tca"), (F.nullif(number("MIN_RNG"), F.lit(0.0)) / 1000.0).alias("miss_distance_km"), number("PC").alias("collision_probability"),
        F.col("SAT_1_ID").cast("int").alias("sat1_norad"), text("SAT_1_NAME").alias("sat1_name"), text("SAT1_OBJECT_TYPE").alias("sat1_type"), text("SAT1_RCS").alias("sat1_rcs"),
        F.col("SAT_2_ID").cast("int").alias("sat2_norad"), text("SAT_2_NAME").alias("sat2_name"), text("SAT2_OBJECT_TYPE").alias("sat2_type"), text("SAT2_RCS").alias("sat2_rcs"),
    )


def message(messages: DataFrame, cdm_id: str) -> DataFrame:
    return messages.filter(F.col("cdm_id") == cdm_id).limit(1)

"""Element sets as a stream: landed files become the latest set of each object.

The batch operators poll with a watermark; this does the same continuously.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import save, settle
from ..schemas import GP


def landed(spark: SparkSession, folder: str, schema: T.StructType = GP, files_at_once: int = 100) -> DataFrame:
    """Typed element sets as files arrive in a folder (Parquet)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def latest(sets: DataFrame, late: str = "10 days") -> DataFrame:
    """The latest epoch and set of each object so far; sets later than the watermark are left out."""
    timed = sets.withColumn("epoch", F.col("EPOCH").cast("timestamp")).withWatermark("epoch", late)
    return timed.groupBy("NORAD_CAT_ID").agg(F.max("epoch").alias("epoch"), F.max_by("GP_ID", "epoch").alias("GP_ID"))


def arrivals(sets: DataFrame, width: str = "1 day", late: str = "10 days") -> DataFrame:
    """Sets of each window of epochs, final once the watermark has passed it."""
    timed = sets.withColumn("epoch", F.col("EPOCH").cast("timestamp")).withWatermark("epoch", late)
    return timed.groupBy(F.window("epoch", width)).agg(F.count("*").alias("n"), F.approx_count_distinct("NORAD_CAT_ID").alias("objects"))


def maintain(sets: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep gp and gp_history below root up to date: append what is replaced to the history, then replace.

    Of an object's sets, in the table and in the batch, that of the latest epoch
    is kept, so a set that comes late goes to the history at once.  A batch that
    runs twice, whole or broken off between the two tables, changes nothing the
    second time: sets that a table has are left out.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        gp_path, history_path = os.path.join(root, "gp"), os.path.join(root, "gp_history")
        settle(spark, gp_path)
        gp, history = (spark.read.schema(GP).parquet(p) for p in (gp_path, history_path))
        fresh = batch.dropDuplicates(["GP_ID"]).join(gp.select("GP_ID"), "GP_ID", "left_anti").select(GP.names)
        touched = gp.join(fresh.select("NORAD_CAT_ID").distinct(), "NORAD_CAT_ID", "left_semi").select(GP.names).unionByName(fresh)
        ranked = touched.withColumn("__n", F.row_number().over(Window.partitionBy("NORAD_CAT_ID").orderBy(F.col("EPOCH").desc_nulls_last(), F.col("GP_ID").desc_nulls_last())))
        passed = ranked.filter("__n > 1").drop("__n")
        known = history.select("GP_ID").join(passed.select("GP_ID"), "GP_ID", "left_semi")  # the few that are asked for
        passed.join(known, "GP_ID", "left_anti").select(GP.names).write.mode("append").parquet(history_path)
        save(gp.join(fresh.select("NORAD_CAT_ID").distinct(), "NORAD_CAT_ID", "left_anti").select(GP.names).unionByName(ranked.filter("__n = 1").drop("__n")), gp_path)

    return sets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

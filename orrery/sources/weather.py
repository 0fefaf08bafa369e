"""Space weather: the three-hourly Kp index and daily solar flux, from landed text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import micros

DEFAULT_AP = 9.0


def _fields(lines: DataFrame) -> DataFrame:
    """Fields of lines that are no comment."""
    text = F.trim(F.col("value"))
    return lines.filter(~F.col("value").startswith("#") & (text != "")).select(F.split(text, r"\s+").alias("p"))


def _at(i: int, kind: str = "double") -> Column:
    return F.get("p", F.lit(i)).try_cast(kind)


def _day() -> Column:
    return F.try_make_timestamp_ntz(_at(0, "int"), _at(1, "int"), _at(2, "int"), F.lit(0), F.lit(0), F.lit(0))


def kp(lines: DataFrame, kind: str = "nowcast") -> DataFrame:
    """(datetime, kp) of a text file read by `spark.read.text`; negative values are missing, broken lines are left out.

    kind: nowcast has a line for each three hours, daily one for each day.
    """
    rows = _fields(lines).withColumn("day", _day()).filter(F.col("day").isNotNull())
    if kind == "nowcast":
        hour = _at(3)
        minutes = F.floor(hour) * 60 + F.floor((hour - F.floor(hour)) * 60)
        out = rows.select(F.timestamp_add("MINUTE", minutes.cast("int"), F.col("day")).alias("datetime"), _at(7).alias("kp"))
    else:
        # A line that breaks off keeps the hours before the break.
        values = F.array(*[_at(7 + i) for i in range(8)])
        first = F.array_position(F.transform(values, lambda v: v.isNull()), True)
        whole = F.when(first > 0, F.slice(values, 1, F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(values)
        out = rows.select("day", F.posexplode(whole).alias("i", "kp")).select(F.timestamp_add("HOUR", F.col("i") * 3, F.col("day")).alias("datetime"), "kp")
    return out.filter(F.col("datetime").isNotNull() & (F.col("kp") >= 0))


def source_kind(since_year: int | None) -> str:
    """Which file to land: the short one for recent years."""
    return "nowcast" if since_year is not None and since_year >= 2024 else "daily"


def valid(series: DataFrame) -> Column:
    """An aggregate: all values are between 0 and 9."""
    return F.coalesce(F.min("kp") >= 0, F.lit(True)) & F.coalesce(F.max("kp") <= 9, F.lit(True))


def freshness(series: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: latest, age_days, valid, and what to do: reload (invalid), keep (a day old at most) or extend."""
    now = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    state = series.agg(F.max("datetime").alias("latest"), valid(series).alias("valid"))
    state = state.withColumn("age_days", F.floor((micros(now) - micros(F.col("latest"))) / F.lit(86_400e6)).cast("long"))
    action = F.when(F.col("latest").isNull() | ~F.col("valid"), "reload").when(F.col("age_days") <= 1, "keep").otherwise("extend")
    return state.withColumn("action", action)


def extend(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows from before the new ones begin, and the new ones; each time once."""
    begin = new.agg(F.min("datetime").alias("__begin"))  # one row
    kept = old.crossJoin(F.broadcast(begin)).filter(F.col("__begin").isNull() | (F.col("datetime") < F.col("__begin"))).drop("__begin")
    w = Window.partitionBy("datetime").orderBy("kp")
    return kept.unionByName(new).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def between(series: DataFrame, start: str, end: str, whole_last_day: bool = True) -> DataFrame:
    """Times from a day through another; without whole_last_day only midnight of the last."""
    first, last = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    upper = F.col("datetime") < F.timestamp_add("DAY", F.lit(1), last) if whole_last_day else F.col("datetime") <= last
    return series.filter((F.col("datetime") >= first) & upper)


def daily(lines: DataFrame) -> DataFrame:
    """(date, f107, ap8, ap_daily, f107_81): solar flux, its mean over 81 days around, eight indices.

    Lines that are short, broken or without a flux are left out.
    """
    rows = _fields(lines).filter(F.size("p") >= 27)
    rows = rows.select(F.to_date(_day()).alias("date"), _at(25).alias("f107"), F.array(*[_at(15 + i) for i in range(8)]).alias("ap8"), _at(23).alias("ap_daily"))
    rows = rows.filter(F.col("date").isNotNull() & (F.col("f107") > 0) & F.col("ap_daily").isNotNull() & ~F.exists("ap8", lambda a: a.isNull()))
    year = Window.partitionBy(F.lit(1)).orderBy(F.datediff(F.col("date"), F.lit("1970-01-01").cast("date"))).rangeBetween(-40, 40)  # a row a day
    return rows.dropDuplicates(["date"]).withColumn("f107_81", F.avg("f107").over(year))


def three_hourly(days: DataFrame) -> DataFrame:
    """(t, ap) of the eight indices of each day."""
    return days.select(F.col("date").cast("timestamp_ntz").alias("day"), F.posexplode("ap8").alias("i", "ap")).select(F.timestamp_add("HOUR", F.col("i") * 3, F.col("day")).alias("t"), "ap")


def ap_at(rows: DataFrame, days: DataFrame, time: str, name: str = "ap", hours_before: int = 0) -> DataFrame:
    """The index at a time, some hours before; 9 for days that are missing."""
    slot = F.floor(micros(F.col(time)) / F.lit(10_800_000_000)) - F.lit(hours_before // 3)
    series = three_hourly(days).select(F.floor(micros(F.col("t")) / F.lit(10_800_000_000)).alias("__s"), F.col("ap").alias("__ap"))
    return rows.withColumn("__slot", slot).join(series, F.col("__slot") == F.col("__s"), "left").withColumn(name, F.coalesce("__ap", F.lit(DEFAULT_AP))).drop("__slot", "__s", "__ap")


def flux_at(rows: DataFrame, days: DataFrame, time: str, column: str = "f107", name: str | None = None, previous: bool = False) -> DataFrame:
    """A value of the day (or the day before), of the nearest day where there is none."""
    from ..operators.joins import nearest

    day = F.date_trunc("DAY", F.col(time)).cast("timestamp_ntz")
    rows = rows.withColumn("__day", F.timestamp_add("DAY", F.lit(-1), day) if previous else day)
    series = days.select(F.col("date").cast("timestamp_ntz").alias("__at"), F.col(column).alias("__v"), F.lit(1).alias("__one"))
    asked = rows.select("__day", F.lit(1).alias("__one")).distinct()  # a row for each day
    found = nearest(asked, series, ["__one"], "__day", "__at", ["__v"]).select("__day", F.col("match.__v").alias("__found"))
    return rows.join(found, "__day", "left").withColumn(name or column, F.col("__found")).drop("__found", "__day")


def atmosphere_inputs(rows: DataFrame, days: DataFrame, time: str) -> DataFrame:
    """Inputs of an empirical atmosphere: flux (of the day before), flux_mean, and ap, an array of seven.

    ap: the day's, now, 3, 6 and 9 hours before, and the means 12 to 33 and 36
    to 57 hours before.  The lags are one array of twenty three-hour slots.
    """
    rows = flux_at(flux_at(rows, days, time, "f107", "flux", previous=True), days, time, "f107_81", "flux_mean")
    slot = F.floor(micros(F.col(time)) / F.lit(10_800_000_000))
    series = three_hourly(days).select(F.floor(micros(F.col("t")) / F.lit(10_800_000_000)).alias("__s"), "ap")
    lags = rows.select(time).distinct().withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("__slot", slot - F.col("__k"))
    found = lags.join(series, F.col("__slot") == F.col("__s"), "left").groupBy(time).agg(F.sort_array(F.collect_list(F.struct("__k", F.coalesce("ap", F.lit(DEFAULT_AP)).alias("a")))).alias("__l"))
    mean = lambda a, b: F.aggregate(F.slice("__l", a + 1, b - a), F.lit(0.0), lambda s, x: s + x["a"]) / F.lit(float(b - a))
    day = days.select(F.col("date").alias("__date"), F.col("ap_daily").alias("__daily"))
    joined = rows.join(found, time).join(day, F.to_date(time) == F.col("__date"), "left")
    ap = F.array(F.coalesce("__daily", F.lit(DEFAULT_AP)), *[F.col("__l")[i]["a"] for i in range(4)], mean(4, 12), mean(12, 20))
    return joined.withColumn("ap", ap).drop("__l", "__date", "__daily")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def save_cache(series: DataFrame, path: str) -> None:
    """The cache of an index: CSV with a header."""
    series.orderBy("datetime").coalesce(1).write.mode("overwrite").csv(path, header=True)


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("datetime timestamp_ntz, kp double").csv(path, header=True)

"""Joins that Spark has no operator for: as of, nearest, within a tolerance, overlapping.

None of them compares all pairs.  As-of and nearest joins are one union, one
shuffle by key and a running value; tolerance and overlap joins give each row
the few buckets it touches, join on the bucket, and check exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import micros


def _merged(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], right_first: bool) -> tuple[DataFrame, list[str]]:
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(by)]
    lefts = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1 if right_first else 0).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"))
    known = F.col(right_time).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    rights = right.filter(known).select(*keys, F.col(right_time).alias("__t"), F.lit(0 if right_first else 1).alias("__side"), F.struct(F.col(right_time).alias("time"), *[F.col(c) for c in take]).alias("__right"))
    return lefts.unionByName(rights, allowMissingColumns=True), [f"__k{i}" for i in range(len(by))]


def _carry(rows: DataFrame, keys: list[str], forward: bool, bucket: Column | None) -> Column | DataFrame:
    """The last value of __right up to each row in time (or from it on, for the next)."""
    order = [F.col("__t").asc_nulls_first(), F.col("__side"), F.col("__right")] if forward else [F.col("__t").desc_nulls_last(), F.col("__side").desc(), F.col("__right").desc()]
    name = "prev" if forward else "next"
    if bucket is None:
        own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.last("__right", ignorenulls=True).over(own))
    rows = rows.withColumn("__b", bucket)
    own = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn(name, F.last("__right", ignorenulls=True).over(own))
    at = F.when(F.col("__right").isNotNull(), F.struct("__t", "__right"))
    edge = F.max_by("__right", at) if forward else F.min_by("__right", at)
    ends = rows.groupBy(*keys, "__b").agg(edge.alias("__edge"))
    before = Window.partitionBy(*keys).orderBy(F.col("__b").asc_nulls_first() if forward else F.col("__b").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__edge", ignorenulls=True).over(before)).drop("__edge")
    same = F.col("__b").eqNullSafe(F.col("__cb"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__c{k}"))
    joined = within.join(carried.select(*[F.col(k).alias(f"__c{k}") for k in keys], F.col("__b").alias("__cb"), "__carry"), same, "left")
    return joined.withColumn(name, F.coalesce(name, "__carry")).drop("__carry", "__cb", "__b", *[f"__c{k}" for k in keys])


def around(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], strict: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """Each left row with `prev` and `next`: structs of the right time (`time`) and `take` columns.

    prev is the last right row at or before the left time (before it, if
    strict), next the first after prev's range.  bucket_seconds: part a key's
    rows by time, where one key may have too many for a task.  Of right rows of
    the same key and time, prev is the greatest and next the least by the
    columns taken, in their order.
    """
    merged, keys = _merged(left, right, by, left_time, right_time, take, right_first=not strict)
    bucket = None if bucket_seconds is None else F.floor(micros(F.col("__t")) / F.lit(bucket_seconds * 1_000_000))
    rows = _carry(merged, keys, True, bucket)
    rows = _carry(rows, keys, False, bucket)
    timed = F.col("__t").isNotNull()
    return rows.filter(F.col("__left").isNotNull()).select("__left.*", F.when(timed, F.col("prev")).alias("prev"), F.when(timed, F.col("next")).alias("next"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str], strict: bool = False, bucket_seconds: int | None = None) -> DataFrame:
    """`around` without `next`, in one pass over the rows of a key."""
    merged, keys = _merged(left, right, by, left_time, right_time, take, right_first=not strict)
    bucket = None if bucket_seconds is None else F.floor(micros(F.col("__t")) / F.lit(bucket_seconds * 1_000_000))
    rows = _carry(merged, keys, True, bucket)
    return rows.filter(F.col("__left").isNotNull()).select("__left.*", F.when(F.col("__t").isNotNull(), F.col("prev")).alias("prev"))


def asof_else_next(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """`match`: the last right row at or before; where there is none, the nearest, which is the next."""
    found = around(left, right, by, left_time, right_time, take)
    return found.withColumn("match", F.coalesce("prev", "next")).drop("prev", "next")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, take: list[str]) -> DataFrame:
    """`match`: the right row at the least distance in time, the earlier of two at the same."""
    found = around(left, right, by, left_time, right_time, take)
    t = micros(F.col(left_time))
    before, after = t - micros(F.col("prev.time")), micros(F.col("next.time")) - t
    pick = F.when(F.col("next").isNull() | (before <= after), F.col("prev")).otherwise(F.col("next"))
    return found.withColumn("match", F.coalesce(pick, "next")).drop("prev", "next")


def inside_else_nearest(rows: DataFrame, by: list[str], time: str, start: Column, end: Column) -> DataFrame:
    """One row for each key: the earliest within [start, end], else the one nearest to start."""
    inside = F.col(time).between(start, end)
    far = F.abs(micros(F.col(time)) - micros(start))
    rank = F.struct((~inside).alias("out"), F.when(inside, micros(F.col(time))).otherwise(far).alias("by"), micros(F.col(time)).alias("t"))
    kept = rows.filter(F.col(time).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rows.columns), rank).alias("row"))
    return kept.select("row.*")


def covering(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, hours: int = 3) -> DataFrame:
    """The value whose interval [t, t + hours) holds the left time; else of the nearest t.

    The right times are multiples of the interval, as a three-hourly index has
    them, so the interval is found by an equality; of rows that repeat one, the
    greatest value holds.
    """
    width = F.lit(hours * 3_600_000_000)
    slot = F.floor(micros(F.col(left_time)) / width)
    series = right.filter(F.col(right_time).isNotNull()).groupBy(F.floor(micros(F.col(right_time)) / width).alias("__slot")).agg(F.max(value).alias(value))
    return left.withColumn("__slot", slot).join(series, "__slot", "left").drop("__slot")


def covering_else_nearest(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, hours: int = 3) -> DataFrame:
    """`covering`, and for times in no interval the value nearest in time (the earlier on a tie).

    Neighbours in the series are the same for all times of an interval, so they
    are found once for each interval that occurs, and joined to the rows.
    """
    width = F.lit(hours * 3_600_000_000)
    slot = F.floor(micros(F.col(left_time)) / width)
    slots = left.select(slot.alias("__slot")).distinct().filter("__slot IS NOT NULL")
    slots = slots.select("__slot", F.lit(1).alias("__one"), F.timestamp_add("MICROSECOND", F.col("__slot") * width, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).alias("__begin"))
    series = right.select(F.col(right_time).alias("__at"), F.col(value).alias("__v"), F.lit(1).alias("__one"))
    found = around(slots, series, ["__one"], "__begin", "__at", ["__v"])  # a row for each three hours
    rows = left.withColumn("__slot", slot).join(found.select("__slot", "prev", "next"), "__slot", "left")
    t = micros(F.col(left_time))
    before, after = t - micros(F.col("prev.time")), micros(F.col("next.time")) - t
    pick = F.when((before < width) | F.col("next").isNull() | (before <= after), F.col("prev.__v")).otherwise(F.col("next.__v"))
    return rows.withColumn(value, F.when(F.col("prev").isNull(), F.col("next.__v")).otherwise(pick)).drop("prev", "next", "__slot")


def _touched(t: Column, tolerance_us: int) -> Column:
    return F.floor(t / F.lit(max(1, tolerance_us)))


def within_tolerance(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, seconds: float, anti: bool = False) -> DataFrame:
    """Left rows for which a right row of the same key is at most `seconds` away (or none is, with anti).

    A right row goes to its bucket of that width and to both neighbours.
    """
    us = round(seconds * 1e6)
    ls = left.withColumn("__t", micros(F.col(left_time))).withColumn("__b", _touched(F.col("__t"), us))
    rs = right.filter(F.col(right_time).isNotNull()).select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(by)], micros(F.col(right_time)).alias("__rt")).distinct()
    rs = rs.withColumn("__rb", F.explode(F.array(*[_touched(F.col("__rt"), us) + F.lit(d) for d in (-1, 0, 1)])))
    on = (F.col("__b") == F.col("__rb")) & (F.abs(F.col("__t") - F.col("__rt")) <= F.lit(us))
    for i, c in enumerate(by):
        on = on & (F.col(c) == F.col(f"__r{i}"))
    return ls.join(rs, on, "left_anti" if anti else "left_semi").drop("__t", "__b")


def overlaps(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: float, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Pairs of rows whose spans [lo, hi] overlap, as structs `l` and `r`; strict: more than touch.

    Spans go to all buckets of `width` they touch.  A pair meets in each bucket
    both touch and is kept in the first, which is the greater of their first
    buckets, so nothing has to be made distinct.
    """
    by = by or []

    def spread(rows: DataFrame, span: tuple[str, str], name: str) -> DataFrame:
        lo, hi = (F.floor(F.col(c) / F.lit(width)) for c in span)
        kept = rows.filter(F.col(span[0]) <= F.col(span[1]))
        return kept.select(F.struct(*rows.columns).alias(name), *[F.col(c).alias(f"__{name}{i}") for i, c in enumerate(by)], lo.alias(f"__{name}first"), F.explode(F.sequence(lo, hi)).alias(f"__{name}b"))

    ls, rs = spread(left, left_span, "l"), spread(right, right_span, "r")
    a, b, c, d = F.col(f"l.{left_span[0]}"), F.col(f"l.{left_span[1]}"), F.col(f"r.{right_span[0]}"), F.col(f"r.{right_span[1]}")
    on = (F.col("__lb") == F.col("__rb")) & (F.greatest("__lfirst", "__rfirst") == F.col("__lb"))
    on = on & ((a < d) & (c < b) if strict else (a <= d) & (c <= b))
    for i in range(len(by)):
        on = on & (F.col(f"__l{i}") == F.col(f"__r{i}"))
    return ls.join(rs, on).select("l", "r")


def overlapping_pairs(rows: DataFrame, span: tuple[str, str], key: str, width: float, block: int = 2048) -> DataFrame:
    """(one, two) of all pairs of rows whose spans [lo, hi] overlap or touch, each pair once: one is the lesser key; rows of the same key are no pair.

    In the order of lo, the partners of a row that come after it are those up
    to its hi: a run of places.  So the places are counted (bucket by bucket of
    `width`), rows are dealt into blocks of `block` places, blocks meet those
    that their runs reach, and the runs are written out.  Work and rows grow
    with the pairs there are, and no key or bucket is one task's work.

    Two spans overlap if each begins by the end of the other, so one that ends
    before it begins has the partners that hold both its ends.
    """
    from .windows import carried

    lo, hi = span
    bucket = lambda x: F.when(F.isnan(x), F.lit((1 << 63) - 1)).otherwise(F.floor(F.col(x) / F.lit(width)))
    own = rows.select(F.col(key).alias("__key"), F.col(lo).cast("double").alias("__lo"), F.col(hi).cast("double").alias("__hi")).filter("__key IS NOT NULL AND __lo IS NOT NULL AND __hi IS NOT NULL")
    placed = carried(own.withColumn("__b", bucket("__lo")), [], "__b", {"__n": F.count("*")}, {"__sofar": F.sum("__n")})
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__lo", "__key", "__hi")) - 1 + F.coalesce("__sofar", F.lit(0))
    placed = placed.select("__key", "__lo", "__hi", place.alias("__at"), F.lit(0).alias("__low"), F.col("__hi").alias("__x"))

    counted = placed.unionByName(own.select(F.col("__lo").alias("__x"), F.lit(1).alias("__low")), allowMissingColumns=True)
    counted = carried(counted.withColumn("__b", bucket("__x")), [], "__b", {"__n": F.sum("__low")}, {"__sofar": F.sum("__n")})
    upto = F.sum("__low").over(Window.partitionBy("__b").orderBy("__x", F.col("__low").desc()).rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("__sofar", F.lit(0))
    ended = counted.withColumn("__end", upto).filter("__low = 0")  # the first place after a row's run

    places = lambda x: F.floor(x / F.lit(block))
    held = ended.groupBy(places(F.col("__at")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("__at", "__key", "__hi"))).alias("rows"))
    held = held.select("block", F.col("rows.__key").alias("keys"), F.col("rows.__hi").alias("his"))
    runs = ended.select(F.col("__key").alias("a"), F.col("__lo").alias("lo"), (F.col("__at") + 1).alias("first"), (F.col("__end") - 1).alias("last")).filter("first <= last")
    runs = runs.select("*", F.explode(F.sequence(places(F.col("first")), places(F.col("last")))).alias("block"))
    begin = F.col("block") * F.lit(block)
    part = F.sequence((F.greatest("first", begin) - begin).cast("int"), (F.least("last", begin + F.lit(block - 1)) - begin).cast("int"))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = runs.repartition(tasks, "block")  # dealt by number, as the pairs are far more than the runs
    each = runs.join(held.hint("merge"), "block").select("a", "lo", "keys", "his", F.explode(part).alias("q"))
    pairs = each.select("a", F.get("keys", "q").alias("b"), (F.col("lo") <= F.get("his", "q")).alias("meet")).filter("meet AND a <> b")
    return pairs.select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("two"))


def in_all(rows: DataFrame, item: str, group: str, wanted: int | DataFrame) -> DataFrame:
    """Items that occur with every group (relational division); wanted: how many there are, or the groups."""
    n = wanted if isinstance(wanted, int) else wanted.select(group).distinct().count()
    return rows.groupBy(item).agg(F.countDistinct(group).alias("__n")).filter(F.col("__n") == n).select(item)


def interpolate(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Linear between the samples around a time.

    Before the first and after the last sample the line through the two at
    that end goes on.
    """
    w = Window.partitionBy(*by).orderBy(right_time)
    span = right.select(*by, right_time, *values, F.lead(right_time).over(w).alias("__t1"), *[F.lead(v).over(w).alias(f"__{v}1") for v in values])
    span = span.filter(F.col("__t1").isNotNull())
    found = around(left, span, by, left_time, right_time, ["__t1", *values, *[f"__{v}1" for v in values]])
    s = F.coalesce("prev", "next")
    part = (micros(F.col(left_time)) - micros(s["time"])) / (micros(s["__t1"]) - micros(s["time"]))
    return found.select(*left.columns, *[((F.lit(1.0) - part) * s[v] + part * s[f"__{v}1"]).alias(v) for v in values])

"""Computations over neighbours in order: pairs, runs, passes, concurrency."""

from __future__ import annotations

from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import days_between, micros, seconds_between


def lead_pairs(rows: DataFrame, by: list[str], time: str, columns: list[str], tie: str | None = None) -> DataFrame:
    """Each row with the next of its key: next_<column>, next_<time>, gap_days; the last row of a key is left out."""
    w = Window.partitionBy(*by).orderBy(time, *([tie] if tie else []))
    out = rows.withColumn(f"next_{time}", F.lead(time).over(w))
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(w))
    return out.filter(F.col(f"next_{time}").isNotNull()).withColumn("gap_days", days_between(F.col(time), F.col(f"next_{time}")))


def gap_ok(gap: Column, least: float = 1e-4, most: float = 10.0, open_at_least: bool = False) -> Column:
    """Gaps worth comparing over; open_at_least: the least gap itself is too short."""
    return ((gap > least) if open_at_least else (gap >= least)) & (gap <= most)


def drag_change(before: Column, after: Column) -> Column:
    """How far the drag term moved; 0 where either is zero, as that means it was not fitted."""
    return F.when((before != 0) & (after != 0), F.abs(after - before)).otherwise(F.lit(0.0))


def carried(rows: DataFrame, by: list[str], bucket: str, totals: dict[str, Column], running: dict[str, Column]) -> DataFrame:
    """Rows with what the buckets before theirs come to.

    totals: an aggregate of a bucket for each name; running: for each new
    column an expression of these totals over the buckets before, as in
    F.sum("x").  A key with too many rows for a task is so summed bucket by
    bucket, and only a row for each bucket meets in one.
    """
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, bucket).agg(*[c.alias(n) for n, c in totals.items()])
    sums = sums.select(*[F.col(c).alias(f"__c_{c}") for c in (*by, bucket)], *[c.over(before).alias(n) for n, c in running.items()])
    same = F.lit(True)
    for c in (*by, bucket):
        same = same & F.col(c).eqNullSafe(F.col(f"__c_{c}"))
    return rows.join(sums, same).drop(*[f"__c_{c}" for c in (*by, bucket)])


def islands(rows: DataFrame, by: list[str], time: str, flag: str, bucket_seconds: int | None = None) -> DataFrame:
    """Rows with `island`: a number for each run of rows for which flag is true; null where it is not.

    bucket_seconds: part a key's rows by time, where one key may have too many for a task.
    """
    on = F.coalesce(F.col(flag), F.lit(False))
    if bucket_seconds is None:
        w = Window.partitionBy(*by).orderBy(time)
        begins = on & ~F.coalesce(F.lag(on).over(w), F.lit(False))
        number = F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn("island", F.when(on, number))
    rows = rows.withColumn("__b", F.floor(micros(F.col(time)) / F.lit(bucket_seconds * 1_000_000))).withColumn("__on", on)
    w = Window.partitionBy(*by, "__b").orderBy(time)
    rows = carried(rows, by, "__b", {"__t": F.max_by("__on", time)}, {"__was": F.last("__t")})
    rows = rows.withColumn("__begins", (F.col("__on") & ~F.coalesce(F.lag("__on").over(w), "__was", F.lit(False))).cast("int"))
    rows = carried(rows, by, "__b", {"__n": F.sum("__begins")}, {"__sofar": F.sum("__n")})
    number = F.coalesce("__sofar", F.lit(0)) + F.sum("__begins").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", F.when(F.col("__on"), number)).drop("__b", "__on", "__was", "__begins", "__sofar")


def passes(samples: DataFrame, by: list[str], time: str, flag: str, elevation: str, slant: str, step_s: float, least_s: float = 10.0) -> DataFrame:
    """Passes of visibility on a regular grid: aos, los (one step after the last sample), the best elevation, its first time, the least range."""
    runs = islands(samples, by, time, flag).filter(F.col("island").isNotNull())
    step = F.lit(round(step_s * 1e6))
    out = runs.groupBy(*by, "island").agg(
        F.min(time).alias("aos"), F.max(time).alias("__last"), F.max(elevation).alias("max_el_deg"),
        F.max_by(time, F.struct(F.col(elevation), -micros(F.col(time)))).alias("max_el_time"), F.min(slant).alias("min_range_km"), F.count("*").alias("__n"),
    )
    out = out.withColumn("los", F.timestamp_add("MICROSECOND", step, F.col("__last"))).withColumn("duration_s", F.col("__n") * F.lit(float(step_s)))
    return out.filter(F.col("duration_s") >= least_s).drop("island", "__last", "__n")


def sub_intervals(samples: DataFrame, by: list[str], time: str, flag: str, single_s: float = 15.0) -> DataFrame:
    """Runs of true samples as [start, end], end being the last of them; one sample alone lasts `single_s`."""
    runs = islands(samples, by, time, flag).filter(F.col("island").isNotNull())
    out = runs.groupBy(*by, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"))
    alone = F.timestamp_add("MICROSECOND", F.lit(round(single_s * 1e6)), F.col("start"))
    return out.withColumn("end", F.when(F.col("start") == F.col("end"), alone).otherwise(F.col("end"))).drop("island")


def rise_set(events: DataFrame, by: list[str], time: str, event: str, rise: int = 0, fall: int = 2) -> DataFrame:
    """(rise, set) pairs: a set with the last rise since the set before it; what has no partner is left out."""
    w = Window.partitionBy(*by).orderBy(time, event)
    kept = events.filter(F.col(event).isin(rise, fall))
    last_rise = F.last(F.when(F.col(event) == rise, F.col(time)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    before = F.lag(event).over(w)
    return kept.withColumn("rise", F.when(before == rise, last_rise)).filter((F.col(event) == fall) & F.col("rise").isNotNull()).select(*by, "rise", F.col(time).alias("set"))


def since_previous(rows: DataFrame, by: list[str], time: str, start: Column, tie: str) -> Column:
    """Seconds since the previous time of the key, or since start, never below 0."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    return F.greatest(F.lit(0.0), seconds_between(F.coalesce(F.lag(time).over(w), start), F.col(time)))


def _changes(s: np.ndarray, e: np.ndarray, item: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, array]]:
    """(t, items active from t on) for each t within [begin, end) at which they change; the items are sorted, in one array that goes on changing."""
    held = np.bincount(item[s < begin], minlength=int(item.max()) + 1 if len(item) else 0).tolist()
    active = array("i", [x for x, n in enumerate(held) if n])
    starts, ends = (s >= begin) & (s < end), (e >= begin) & (e < end)
    t, x = np.concatenate([s[starts], e[ends]]), np.concatenate([item[starts], item[ends]])
    step = np.repeat([1, -1], [starts.sum(), ends.sum()])
    order = np.argsort(t, kind="stable")  # at one time starts come first, so an item that ends and starts again does not change
    last, changed = None, False
    for k in range(0, len(order), 1 << 16):
        part = order[k : k + (1 << 16)]
        for now, what, by in zip(t[part].tolist(), x[part].tolist(), step[part].tolist(), strict=True):
            if now != last:
                if changed:
                    yield last, active
                last, changed = now, False
            held[what] += by
            if by > 0 and held[what] == 1:
                insort(active, what)
                changed = True
            elif by < 0 and not held[what]:
                del active[bisect_left(active, what)]
                changed = True
    if changed:
        yield last, active


def concurrent(intervals: DataFrame, by: list[str], start: str, end: str, item: str, batch_items: int = 1 << 19) -> DataFrame:
    """Stretches during which two items or more are active: (by, items, from, to, n), neighbours with equal items as one.

    A sweep over starts and ends that carries the items that are active.  A key
    may have a third of all intervals, so each of its days is swept apart, by
    the intervals that touch it, for the stretches that begin in it.  What goes
    on over midnight ends with the first change of a later day, which a sweep
    before this one finds; so a list of items is made once, is not shuffled, and
    a task holds those of batch_items items and not those of its days.  Intervals
    without an item, a start or an end, or that end when they start, are active
    in no stretch.
    """
    day = 86_400_000_000
    kind, when = intervals.schema[item].dataType.simpleString(), intervals.schema[start].dataType
    spans = intervals.select(*by, micros(F.col(start)).alias("__s"), micros(F.col(end)).alias("__e"), F.col(item).alias("__item")).filter("__s < __e AND __item IS NOT NULL")
    spans = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / F.lit(day)), F.floor(F.col("__e") / F.lit(day)))))  # what ends at midnight is seen to end by the next day

    def sweep(table: pa.Table) -> tuple[pa.Array, Iterator[tuple[int, array]]]:
        """The items in order, and the changes of the day by their numbers."""
        coded = table.column("__item").combine_chunks().dictionary_encode()
        found = coded.dictionary.to_pylist()
        order = np.array(sorted(range(len(found)), key=found.__getitem__), np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        begin = table.column("__b")[0].as_py() * day
        changes = _changes(table.column("__s").to_numpy(), table.column("__e").to_numpy(), rank[coded.indices.to_numpy()], begin, begin + day)
        return coded.dictionary.take(pa.array(order)), changes

    def first(table: pa.Table) -> pa.Table:
        t = next((t for t, _ in sweep(table)[1]), None)
        return table.select([*by, "__b"]).slice(0, 1).append_column("__first", pa.array([t], pa.int64()))

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        mark = pc.is_null(table.column("__s"))
        after = table.filter(mark).column("__e")[0].as_py()
        table = table.filter(pc.invert(mark))
        own = table.select(by).slice(0, 1)
        items, changes = sweep(table)
        froms, tos, offsets, codes = [], [], [0], array("i")

        def batch() -> pa.RecordBatch:
            n = len(tos)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items.take(pa.array(np.frombuffer(codes, np.int32))))
            keys = [c.combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in own.columns]
            return pa.RecordBatch.from_arrays([*keys, pa.array(froms, pa.int64()), pa.array(tos, pa.int64()), lists], [*by, "__from", "__to", "items"])

        for t, active in changes:
            if len(froms) > len(tos):
                tos.append(t)
                if len(codes) >= batch_items:
                    yield batch()
                    froms, tos, offsets, codes = [], [], [0], array("i")
            if len(active) > 1:
                froms.append(t)
                codes.extend(active)
                offsets.append(len(codes))
        if len(froms) > len(tos):
            tos.append(after)
        yield batch()

    kinds = "".join(f"`{c}` {intervals.schema[c].dataType.simpleString()}, " for c in by)
    tasks = max(intervals.sparkSession.sparkContext.defaultParallelism, int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    firsts = spans.groupBy(*by, "__b").applyInArrow(first, f"{kinds}__b long, __first long")
    later = Window.partitionBy(*by).orderBy("__b").rowsBetween(1, Window.unboundedFollowing)  # a row for each day
    marks = firsts.select(*by, F.lit(None).cast("long").alias("__s"), F.min("__first").over(later).alias("__e"), F.lit(None).cast(intervals.schema[item].dataType).alias("__item"), "__b")
    dealt = spans.unionByName(marks).repartition(tasks, *by, "__b")  # dealt by number, as the lists are far larger than the spans
    named = dealt.groupBy(*by, "__b").applyInArrow(stretches, f"{kinds}__from long, __to long, items array<{kind}>")
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")).cast(when)
    return named.select(*by, "items", at("__from").alias("from"), at("__to").alias("to"), F.size("items").alias("n"))


def segments(points: DataFrame, by: list[str], time: str, lon: str, jump: float = 180.0) -> DataFrame:
    """Points with `segment`: a new one where the longitude jumps across the antimeridian."""
    w = Window.partitionBy(*by).orderBy(time)
    cut = F.coalesce(F.abs(F.col(lon) - F.lag(lon).over(w)) > jump, F.lit(False))
    return points.withColumn("segment", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def centred_mean(rows: DataFrame, by: list[str], day: str, value: str, days: int = 40) -> Column:
    """Mean over the days from `days` before to `days` after; `day` is a date."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return F.avg(value).over(Window.partitionBy(*by).orderBy(number).rangeBetween(-days, days))


def revisit_gaps(intervals: DataFrame, by: str, time: str, selected: str, t0: Column, t1: Column) -> DataFrame:
    """(by, n_tracks, avg_gap_min, max_gap_min) over [t0, selected times ..., t1]; items never selected have the one gap."""
    ends = intervals.select(by).distinct()
    marks = intervals.filter(F.col(selected)).select(by, F.col(time).alias("t"), F.lit(1).alias("track"))
    marks = marks.unionByName(ends.select(by, t0.alias("t"), F.lit(0).alias("track"))).unionByName(ends.select(by, t1.alias("t"), F.lit(0).alias("track")))
    w = Window.partitionBy(by).orderBy("t")
    gap = seconds_between(F.lag("t").over(w), F.col("t")) / F.lit(60.0)
    return marks.withColumn("gap", gap).groupBy(by).agg(F.sum("track").cast("long").alias("n_tracks"), F.avg("gap").alias("avg_gap_min"), F.max("gap").alias("max_gap_min"))


def fleet_age(tracks: DataFrame, by: str, time: str, grid: DataFrame, at: str) -> DataFrame:
    """(at, age_h, n): at each grid time the mean hours since the last track, over items tracked at least once by then."""
    from .joins import asof

    items = tracks.select(by).distinct()
    points = items.crossJoin(F.broadcast(grid.select(at)))  # each item against the grid, which the report states
    seen = asof(points, tracks, [by], at, time, []).filter(F.col("prev").isNotNull())
    return seen.groupBy(at).agg(F.avg(seconds_between(F.col("prev.time"), F.col(at)) / F.lit(3600.0)).alias("age_h"), F.count("*").alias("n"))

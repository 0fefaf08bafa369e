from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from orrery.operators import joins, schedule, windows

T0 = datetime(2024, 1, 1)
SECONDS = st.integers(0, 200)
FEW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows, name):
    return spark.createDataFrame([(i, k, None if s is None else T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], f"{name} int, k int, t{name} timestamp_ntz")


SIDES = st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), SECONDS)), max_size=25)


@FEW
@given(left=SIDES, right=st.lists(st.tuples(st.integers(0, 2), SECONDS), max_size=25, unique=True), strict=st.booleans(), bucket=st.sampled_from([None, 10, 60]))
def test_around(spark, left, right, strict, bucket):
    got = {r.l: (r.prev and r.prev.r, r.next and r.next.r) for r in joins.around(_frame(spark, left, "l"), _frame(spark, right, "r"), ["k"], "tl", "tr", ["r"], strict=strict, bucket_seconds=bucket).collect()}
    for i, (k, s) in enumerate(left):
        same = [(u, j) for j, (q, u) in enumerate(right) if q == k and s is not None]
        before = max(((u, j) for u, j in same if (u < s if strict else u <= s)), default=(0, None))[1]
        after = min(((u, j) for u, j in same if (u >= s if strict else u > s)), default=(0, None))[1]
        assert got[i] == (before, after)


@FEW
@given(left=SIDES, right=SIDES, width=st.sampled_from([1.0, 7.0, 50.0]))
def test_tolerance(spark, left, right, width):
    ls, rs = _frame(spark, left, "l"), _frame(spark, right, "r")
    want = {i for i, (k, s) in enumerate(left) if s is not None and any(q == k and u is not None and abs(u - s) <= width for q, u in right)}
    assert {r.l for r in joins.within_tolerance(ls, rs, ["k"], "tl", "tr", width).collect()} == want
    assert {r.l for r in joins.within_tolerance(ls, rs, ["k"], "tl", "tr", width, anti=True).collect()} == set(range(len(left))) - want


@FEW
@given(spans=st.lists(st.tuples(st.integers(0, 100), st.integers(0, 40)), max_size=20), width=st.sampled_from([1.0, 9.0, 1000.0]), strict=st.booleans())
def test_overlaps(spark, spans, width, strict):
    rows = spark.createDataFrame([(i, float(a), float(a + n)) for i, (a, n) in enumerate(spans)], "i int, lo double, hi double")
    got = sorted((r.l.i, r.r.i) for r in joins.overlaps(rows, rows, ("lo", "hi"), ("lo", "hi"), width, strict=strict).collect())
    test = (lambda a, b, c, d: a < d and c < b) if strict else (lambda a, b, c, d: a <= d and c <= b)
    assert got == sorted((i, j) for i, (a, n) in enumerate(spans) for j, (c, m) in enumerate(spans) if test(a, a + n, c, c + m))


@FEW
@given(flags=st.lists(st.booleans(), max_size=30), bucket=st.sampled_from([None, 1, 4]))
def test_islands(spark, flags, bucket):
    rows = spark.createDataFrame([(1, T0 + timedelta(seconds=i), f) for i, f in enumerate(flags)], "k int, t timestamp_ntz, f boolean")
    got = [r.island for r in windows.islands(rows, ["k"], "t", "f", bucket).orderBy("t").collect()]
    want, n, last = [], 0, False
    for f in flags:
        n += f and not last
        want.append(n if f else None)
        last = f
    assert got == want


def _exhaustive(spans):
    best = 0
    for mask in range(1 << len(spans)):
        took = [s for i, s in enumerate(spans) if mask >> i & 1]
        if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(took) for b in took[:i]):
            best = max(best, sum(s[2] for s in took))
    return best


@settings(max_examples=200, deadline=None)
@given(spans=st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10), st.integers(0, 9)).map(lambda x: (x[0], x[0] + x[1], x[2])), max_size=9))
def test_schedule_is_the_best(spans):
    chosen = [s for s, c in zip(spans, schedule.best(spans), strict=True) if c]
    assert all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(chosen) for b in chosen[:i])
    assert sum(s[2] for s in chosen) == _exhaustive(spans)


def test_touching_windows_can_both_be_chosen(spark):
    rows = spark.createDataFrame([("a", 1, T0, T0 + timedelta(seconds=60), 5), ("a", 2, T0 + timedelta(seconds=60), T0 + timedelta(seconds=90), 5), ("a", 3, T0, T0 + timedelta(seconds=90), 9)], "sensor string, norad_id int, t_aos timestamp_ntz, t_los timestamp_ntz, weight long")
    assert sorted(r.norad_id for r in schedule.choose(rows).filter("selected").collect()) == [1, 2]


def test_overlap_of_three_is_told_apart_and_joined(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = spark.createDataFrame([("a", 1, at(0), at(30)), ("a", 2, at(10), at(20)), ("a", 3, at(15), at(40)), ("b", 1, at(0), at(5)), ("b", 2, at(5), at(9))], "sensor string, norad_id int, t_aos timestamp_ntz, t_los timestamp_ntz")
    got = [((r["from"] - T0).seconds, (r.to - T0).seconds, r["items"]) for r in windows.concurrent(rows, ["sensor"], "t_aos", "t_los", "norad_id").orderBy("from").collect()]
    assert got == [(10, 15, [1, 2]), (15, 20, [1, 2, 3]), (20, 30, [1, 3])]


def test_unpaired_rises_and_sets_are_left_out(spark):
    rows = spark.createDataFrame([(1, T0 + timedelta(seconds=i), e) for i, e in enumerate([2, 0, 1, 0, 1, 2, 2, 0])], "k int, t timestamp_ntz, e int")
    got = [((r.rise - T0).seconds, (r.set - T0).seconds) for r in windows.rise_set(rows, ["k"], "t", "e").collect()]
    assert got == [(3, 5)]


def test_tolerance_at_exactly_the_bound(spark):
    left = spark.createDataFrame([(1, T0), (2, T0 + timedelta(seconds=10))], "l int, t timestamp_ntz").selectExpr("l", "1 k", "t")
    right = spark.createDataFrame([(T0 + timedelta(seconds=1),), (T0 + timedelta(seconds=11, microseconds=1),)], "u timestamp_ntz").selectExpr("1 k", "u")
    assert [r.l for r in joins.within_tolerance(left, right, ["k"], "t", "u", 1.0).collect()] == [1]


ENDS = st.one_of(st.none(), st.integers(-20, 40).map(float), st.sampled_from([float("inf"), float("-inf"), float("nan")]))


@FEW
@given(spans=st.lists(st.tuples(st.integers(0, 15), ENDS, ENDS), max_size=25), width=st.sampled_from([1.0, 9.0, 1000.0]), block=st.sampled_from([1, 3, 2048]))
def test_overlapping_pairs(spark, spans, width, block):
    """Any two of a table: ends in either order, nulls, infinities, repeated rows and keys."""
    rows = spark.createDataFrame(spans, "k int, lo double, hi double")
    got = sorted(map(tuple, joins.overlapping_pairs(rows, ("lo", "hi"), "k", width, block).collect()))
    place = lambda x: (x != x, x)  # noqa: E731  (NaN is the greatest)
    up_to = lambda x, y: y != y or (x == x and x <= y)
    known = sorted((s for s in spans if None not in s), key=lambda s: (s[0], place(s[1]), place(s[2])))
    assert got == sorted((a[0], b[0]) for i, a in enumerate(known) for b in known[i + 1 :] if a[0] != b[0] and up_to(a[1], b[2]) and up_to(b[1], a[2]))


def test_band_pairs_agree_with_their_sql(spark, tmp_path):
    """Sizes below zero, which end a band before it begins, and sizes that are null."""
    import duckdb

    import __spark_entry__ as entry

    rows = [(i, 900.0 + i * 7 % 60 / 10.0, None if i % 11 == 0 else i * 13 % 60 - 20) for i in range(300)]
    spark.createDataFrame(rows, "p_partkey long, p_retailprice double, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = sorted(con.execute(entry.oracle_sql()["band_pairs"]).fetchall())
    assert sorted(map(tuple, entry.queries()["band_pairs"](spark, str(tmp_path)).collect())) == want


def test_pairs_are_written_out_by_runs(spark):
    """Spans that do not meet are not compared: bands of one bucket, each of which meets its neighbour only."""
    rows = spark.range(3000).selectExpr("id AS k", "CAST(id AS double) AS lo", "CAST(id + 1 AS double) AS hi")
    found = joins.overlapping_pairs(rows, ("lo", "hi"), "k", 1e6, 64)
    assert found.count() == 2999 and found.filter("two <> one + 1").count() == 0
    found.collect()
    made, todo = [], [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("SortMergeJoin", "Generate", "BroadcastHashJoin", "ShuffledHashJoin"):
            n = node.metrics().get("numOutputRows")
            made.append(n.get().value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        todo += [node.finalPhysicalPlan()] if node.nodeName() == "AdaptiveSparkPlan" else []
        todo += [node.plan()] if node.nodeName().endswith("QueryStage") else []
    assert 2999 <= max(made) <= 4 * 3000


@FEW
@given(spans=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 300_000), st.integers(1, 120_000)), max_size=25))
def test_stretches_are_parted_where_the_sensor_is_idle(spark, spans):
    rows = spark.createDataFrame([(i, k, a, a + n) for i, (k, a, n) in enumerate(spans)], "i int, sensor int, __s long, __e long")
    got = {r.i: r["__busy"] for r in schedule._stretches(rows, "sensor").collect()}
    for sensor in (0, 1):
        end = begin = None
        for a, b, i in sorted((a, a + n, i) for i, (k, a, n) in enumerate(spans) if k == sensor):
            if end is None or a >= end:
                begin = a
            end = b if end is None else max(end, b)
            assert got[i] == begin


def test_sweeps_over_many_days_equal_brute_force(spark):
    """Intervals that touch, nest, repeat and go on over midnights; null keys and items."""
    import random

    rng = random.Random(6)
    rows = []
    for _ in range(120):
        a = rng.randrange(0, 4 * 86400, 1800)
        rows.append((rng.choice([1, None]), rng.randrange(5), T0 + timedelta(seconds=a), T0 + timedelta(seconds=a + rng.choice([0, 1800, 7200, 100_000]))))
    rows += [(1, None, T0, T0 + timedelta(days=2)), (1, 3, None, T0)]
    got = windows.concurrent(spark.createDataFrame(rows, "sensor int, norad_id int, t_aos timestamp_ntz, t_los timestamp_ntz"), ["sensor"], "t_aos", "t_los", "norad_id")
    want = []
    for sensor in (1, None):
        mine = [r for r in rows if r[0] == sensor and r[1] is not None and r[2] is not None and r[2] < r[3]]
        moments = sorted({t for r in mine for t in r[2:]})
        for f, u in zip(moments, moments[1:], strict=False):
            items = sorted({r[1] for r in mine if r[2] <= f and r[3] >= u})
            if len(items) > 1:
                if want and want[-1][0] == sensor and want[-1][2] == f and want[-1][3] == items:
                    want[-1] = (sensor, want[-1][1], u, items)
                else:
                    want.append((sensor, f, u, items))
    assert sorted(((r.sensor, r["from"], r.to, r["items"]) for r in got.collect()), key=repr) == sorted(want, key=repr) and len(want) > 20


def test_a_list_of_active_items_is_made_once(spark):
    """The lists of a day go out bit by bit, and nothing after the sweep shuffles, sorts or holds them."""
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("a", f"{i % 40:02d}", at(i), at(i + 30)) for i in range(100)] + [("b", "x", at(1), at(24)), ("b", "y", at(2), at(24)), ("b", "x", at(24), at(72)), ("b", "y", at(20), at(72)), ("b", "z", at(24), at(48))]
    frame = spark.createDataFrame(rows, "sensor string, norad_id string, t_aos timestamp_ntz, t_los timestamp_ntz")
    found = [windows.concurrent(frame, ["sensor"], "t_aos", "t_los", "norad_id", **more) for more in ({}, {"batch_items": 1})]
    one, other = (sorted(map(tuple, f.select("sensor", "from", "to", "items", "n").collect())) for f in found)
    assert one == other
    assert [r[1:] for r in one if r[0] == "b"] == [(at(2), at(24), ["x", "y"], 2), (at(24), at(48), ["x", "y", "z"], 3), (at(48), at(72), ["x", "y"], 2)]
    above = found[0]._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert above.split()[0].endswith("Project") and not any(x in above for x in ("Aggregate", "Window", "Join", "Sort", "Repartition"))

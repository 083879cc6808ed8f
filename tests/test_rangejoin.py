"""Interval and as-of joins against plain loops, on both ways that they can go."""

import random
import time

import pytest
from pyspark.sql import functions as F

from cohortwire.operators import rangejoin as R
from cohortwire.operators import windows as W

EVENT = "device_id string, table_name string, timestamp long, _id long"
WINDOW = "subject_id string, device_id string, table_name string, start_ms long, end_ms long, no long"


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    return request.param


def some_events(n, seed, devices="abcd"):
    rng = random.Random(seed)
    rows = [(rng.choice(devices), rng.choice("xy"), rng.randint(-500, 2000), i) for i in range(n)]
    return rows + [(None, "x", 5, n), ("a", None, 5, n + 1), ("a", "x", None, n + 2)] + [("h", "x", 7, n + 3 + i) for i in range(40)]


def some_windows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.randint(-600, 2100)
        length = rng.choice([0, 1, 3, 20, 20, 400, 3000, -5])
        rows.append(("s" + rng.choice("12"), rng.choice("abceh"), rng.choice("xy"), start, start + length, i))
    return rows + [("s", "a", "x", None, 10, n), ("s", "a", "x", 0, None, n + 1), ("s", None, "x", 0, 10, n + 2), ("s", "h", "x", 0, 10, n + 3)]


def matches(events, windows, by_table, closed):
    return sorted(
        (e[3], w[5]) for e in events for w in windows
        if e[2] is not None and w[3] is not None and w[4] is not None and e[0] is not None and e[0] == w[1] and (not by_table or (e[1] is not None and e[1] == w[2]))
        and w[3] <= e[2] and (e[2] <= w[4] if closed else e[2] < w[4])
    )


@pytest.mark.parametrize("by_table,closed", [(True, False), (False, True)])
def test_range_join_equals_a_loop(spark, way, by_table, closed):
    events, windows = some_events(300, 1), some_windows(60, 2)
    ev, win = spark.createDataFrame(events, EVENT), spark.createDataFrame(windows, WINDOW)
    win = win if by_table else win.drop("table_name")
    got = R.range_join(ev, win, by_table, closed, hot_rows=15)
    assert sorted((r["_id"], r["no"]) for r in got.collect()) == matches(events, windows, by_table, closed)
    assert set(got.columns) == {*ev.columns, *win.columns}


def test_outer_and_semi_range_joins(spark, way):
    events, windows = some_events(200, 3), some_windows(20, 4)
    ev, win = spark.createDataFrame(events, EVENT), spark.createDataFrame(windows, WINDOW)
    want = matches(events, windows, True, False)
    hit = {e for e, _ in want}
    left = R.range_join(ev, win, how="left", hot_rows=15)
    assert sorted((r["_id"], r["no"] if r["no"] is not None else -1) for r in left.collect()) == sorted(want + [(e[3], -1) for e in events if e[3] not in hit])
    assert {r["_id"] for r in R.range_join(ev, win, how="left_semi", hot_rows=15).collect()} == hit
    assert {r["_id"] for r in R.range_join(ev, win, how="left_anti", hot_rows=15).collect()} == {e[3] for e in events} - hit


def test_nothing_to_join(spark, way):
    ev, win = spark.createDataFrame([], EVENT), spark.createDataFrame([], WINDOW)
    assert R.range_join(ev, win).isEmpty()
    assert R.range_join(spark.createDataFrame(some_events(5, 1), EVENT), win, how="left").count() == 48


def test_the_bin_is_a_join_key_and_windows_repeat_thrice_at_most(spark, capsys):
    windows = spark.createDataFrame(some_windows(200, 5), WINDOW).filter("end_ms > start_ms")
    width = R.bin_width(R.fetched(windows))
    assert R._binned(windows, width, False).count() <= 3 * windows.count()
    R.range_join(spark.createDataFrame(some_events(50, 1), EVENT), windows).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin [device_id" in plan and "_bin" in plan.split("BroadcastHashJoin")[1].split("]")[0]


def test_a_thousand_probes_cost_little_more_than_one(spark):
    """Events meet the probes of their bin only: a thousand a device don't make a thousand comparisons an event."""
    ev = spark.range(2_000_000).select((F.col("id") % 10).cast("string").alias("device_id"), (F.col("id") * 7919 % 86_400_000).alias("timestamp")).cache()
    ev.count()

    def seconds(probes):
        span = 86_400_000 // probes
        rows = [("s", str(d), i, i * span, i * span + span // 2) for d in range(10) for i in range(probes)]
        win = spark.createDataFrame(rows, "subject_id string, device_id string, probe_no int, start_ms long, end_ms long")
        best = []
        for _ in range(2):
            start = time.perf_counter()
            assert R.range_join(ev, win, by_table=False).count() > 900_000
            best.append(time.perf_counter() - start)
        return min(best)

    one, many = seconds(1), seconds(1000)
    ev.unpersist()
    assert many < 10 * one


def test_only_hot_bins_are_salted(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_ROWS", 0)
    events, windows = some_events(60, 8), some_windows(30, 9)
    ev, win = spark.createDataFrame(events, EVENT), spark.createDataFrame(windows, WINDOW)
    w = R._binned(win.withColumnsRenamed({"device_id": "w_device_id", "table_name": "w_table_name"}), 50, False)
    e, w = R._salted(ev.withColumn("_bin", F.floor(F.col("timestamp") / 50)), w, ["device_id", "table_name", "_bin"], 15)
    salts = {r["device_id"]: r["n"] for r in e.groupBy("device_id").agg(F.max("_salt").alias("n")).collect()}
    assert salts["h"] == 2 and {n for d, n in salts.items() if d != "h"} == {0}
    assert {r[0] for r in w.filter("w_salt > 0").select("w_device_id").distinct().collect()} == {"h"}


def nearest(events, anchors, backward, horizon):
    out = set()
    for subject, device, at in anchors:
        if device is None or at is None:
            continue
        for table in {e[1] for e in events if e[0] == device}:
            own = [e[2] for e in events if e[:2] == (device, table) and e[2] is not None]
            own = [t for t in own if (at - horizon <= t < at if backward else at <= t <= at + horizon)]
            if own:
                out.add((subject, device, table, at, max(own) if backward else min(own)))
    return out


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("slice_ms", [1, 37, 100_000])
def test_as_of_equals_a_loop(spark, backward, slice_ms):
    rng = random.Random(slice_ms)
    events = [(rng.choice("abcd"), rng.choice("xy"), rng.randint(-500, 2000), i) for i in range(250)] + [("a", "x", None, 900), (None, "x", 3, 901)]
    anchors = [("s" + rng.choice("12"), rng.choice("abce"), rng.choice([e[2] for e in events[:250]]) + rng.choice([0, 0, 1, -1])) for _ in range(40)]
    anchors += [anchors[0], ("s1", None, 5), ("s1", "a", None), ("s1", "a", -9999), ("s1", "a", 9999)]
    ev, a = spark.createDataFrame(events, EVENT), spark.createDataFrame(anchors, "subject_id string, device_id string, anchor_ms long")
    got = R.as_of(ev, a, backward, slice_ms)
    assert {tuple(r) for r in got.select("subject_id", "device_id", "table_name", "anchor_ms", "found_ms").collect()} == nearest(events, anchors, backward, 10**9)
    assert got.count() == len(set(tuple(r) for r in got.collect()))


@pytest.mark.parametrize("n_anchors", [3, 40])
def test_first_and_last_events_keep_to_the_horizon(spark, way, n_anchors):
    """Few anchors are joined, many merged, with the same answer."""
    events = some_events(300, 11)
    rng = random.Random(5)
    anchors = [("s1", rng.choice("abcdh"), rng.randint(-400, 2100)) for _ in range(n_anchors)]
    ev, a = spark.createDataFrame(events, EVENT).filter("table_name is not null"), spark.createDataFrame(anchors, "subject_id string, device_id string, anchor_ms long")
    events = [e for e in events if e[1] is not None]
    columns = ["subject_id", "device_id", "table_name", "anchor_ms", "found_ms"]
    assert {tuple(r) for r in R.first_event_after(ev, a, 30).select(columns).collect()} == nearest(events, anchors, False, 30)
    assert {tuple(r) for r in R.last_event_before(ev, a, 30).select(columns).collect()} == nearest(events, anchors, True, 30)


def test_events_without_tables(spark):
    ev = spark.createDataFrame([("a", 5), ("a", 9)], "device_id string, timestamp long")
    a = spark.createDataFrame([("s", "a", i) for i in range(12)], "subject_id string, device_id string, anchor_ms long")
    assert {(r.anchor_ms, r.found_ms) for r in R.first_event_after(ev, a, 3).collect()} == {(i, 5) for i in range(2, 6)} | {(i, 9) for i in range(6, 10)}


def test_probes_meet_their_hits(spark, way):
    spans = spark.createDataFrame([("s", "a", 0, 100), ("s", "b", 0, 100)], "subject_id string, device_id string, start_ms long, end_ms long")
    ev = spark.createDataFrame([("a", "x", 31, 1), ("a", "x", 32, 2), ("a", "x", 79, 3), ("a", "x", 55, 4)], EVENT)
    got = {r.device_id: (r.probes, r.first_hit, r.last_hit, r.hits) for r in W.probe_hits(ev, W.probe_windows(spans, 10, 5)).collect()}
    assert got == {"a": (11, 3, 3, 1), "b": (11, None, None, 0)}


def test_what_is_fetched_is_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(10).mapInArrow(count, "id long")
    found = R.fetched(df)
    assert found.rows.num_rows == 10 and found.df.join(spark.range(3), "id").count() == 3
    assert seen.value <= 10
    assert R.fetched(spark.range(100), 99).rows is None and R.fetched(spark.range(100), 100, 10).rows is None

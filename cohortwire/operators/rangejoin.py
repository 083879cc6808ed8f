"""Events to windows by time bins, and first and last events around anchors by merging."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A table is broadcast up to this many rows and bytes; beyond either the join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Events of one device and bin beyond which a shuffled join deals them over several tasks.
HOT_ROWS = 1_000_000
#: Anchors a device beyond which its events are merged with them, not joined to each.
FEW_ANCHORS = 4
#: Length of the stretches of time that an as-of join sums up.
SLICE_MS = 6 * 3_600_000


@dataclass
class Fetched:
    """A table and, where it is small enough to be broadcast, its rows, for which it was derived once."""

    df: DataFrame
    rows: object = None

    def most_per(self, column: str) -> int:
        counts = pc.value_counts(self.rows[column]).field("counts")
        return pc.max(counts).as_py() or 0


def fetched(df: DataFrame, rows: int | None = None, limit: int | None = None) -> Fetched:
    """df with its rows if there are at most `rows` in at most `limit` bytes; no more than that comes to the driver.

    What is fetched is not derived again when it is broadcast.
    """
    rows, limit = BROADCAST_ROWS if rows is None else rows, BROADCAST_BYTES if limit is None else limit
    few = df.limit(rows + 1).toArrow()
    if few.num_rows > rows or few.nbytes > limit:
        return Fetched(df)
    return Fetched(F.broadcast(df.sparkSession.createDataFrame(few, df.schema)), few)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if it turns out to be small."""
    return fetched(df, rows).df


def bin_width(win: Fetched) -> int:
    """The windows' mean length: with bins of that width all windows together lie in at most three bins each."""
    if win.rows is not None:
        mean = pc.mean(pc.subtract(win.rows["end_ms"], win.rows["start_ms"])).as_py()
    else:
        mean = win.df.agg(F.avg(F.col("end_ms") - F.col("start_ms"))).first()[0]
    return max(1, int(mean or 1))


def _time_bin(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("long")


def _binned(win: DataFrame, width: int, closed: bool) -> DataFrame:
    """A row per window and bin that it touches; windows without length, or without a bound, touch none."""
    last = F.col("end_ms") if closed else F.col("end_ms") - 1
    win = win.filter(F.col("start_ms") <= last)
    return win.withColumn("w_bin", F.explode(F.sequence(_time_bin(F.col("start_ms"), width), _time_bin(last, width))))


def _salted(ev: DataFrame, win: DataFrame, keys: list[str], hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt, by which the events of a device and bin of over hot_rows rows are dealt over several tasks."""
    hot = ev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows)
    hot = fetched(hot.select(*[F.col(k).alias(f"h_{k}") for k in keys], F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")))
    if hot.rows is not None and not hot.rows.num_rows:
        return ev.withColumn("_salt", F.lit(0)), win.withColumn("w_salt", F.lit(0))

    def with_salts(df: DataFrame, prefix: str) -> DataFrame:
        same = [df[f"{prefix}{k.lstrip('_') if prefix else k}"].eqNullSafe(F.col(f"h_{k}")) for k in keys]
        return df.join(hot.df, same, "left").drop(*[f"h_{k}" for k in keys]).withColumn("salts", F.coalesce("salts", F.lit(1)))

    events = with_salts(ev, "").withColumn("_salt", F.pmod(F.xxhash64(*ev.columns), F.col("salts")).cast("int")).drop("salts")
    windows = with_salts(win, "w_").withColumn("w_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return events, windows


def range_join(ev: DataFrame, win: DataFrame, by_table: bool = True, closed: bool = False, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events in [start_ms, end_ms) of their device's windows (closed: end included).

    An equi-join on the device and a bin of time, with the range as residual condition: each event meets only the
    windows of its device that touch its bin, however many there are.  Bins are as wide as the mean window, so windows
    are repeated at most three times over, and events never.  Windows that are few are broadcast; otherwise both sides
    are shuffled by device and bin, and a bin of over hot_rows events is dealt over several tasks.  With by_table, a
    window's table_name must be the event's, too.  Windows without length or a bound match nothing; with how="left",
    events that match nothing are kept.
    """
    keys = ["device_id"] + (["table_name"] if by_table else [])
    found = fetched(win)
    width = bin_width(found)
    w = _binned(found.df.withColumnsRenamed({k: f"w_{k}" for k in keys}), width, closed)
    e = ev.withColumn("_bin", _time_bin(F.col("timestamp"), width))
    equal = [*keys, "_bin"]
    if found.rows is not None:
        w = F.broadcast(w)
    else:
        e, w = _salted(e, w, equal, hot_rows)
        equal.append("_salt")
    inside = (F.col("timestamp") >= F.col("start_ms")) & (F.col("timestamp") <= F.col("end_ms") if closed else F.col("timestamp") < F.col("end_ms"))
    for k in equal:
        inside = inside & (e[k] == w[f"w_{k.lstrip('_')}"])
    out = e.join(w, inside, how).drop("_bin", "_salt")
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"w_{k.lstrip('_')}" for k in equal])


def _joined_around(ev: DataFrame, anchors: DataFrame, low, high, pick) -> DataFrame:
    """For few anchors a device: all rows of the horizon by one join, reduced before they are shuffled."""
    a = anchors.withColumnRenamed("device_id", "a_device_id")
    table = [c for c in ("table_name",) if c in ev.columns]
    near = ev.select("device_id", *table, "timestamp").join(a, (F.col("device_id") == F.col("a_device_id")) & F.col("timestamp").between(low, high))
    return near.groupBy("subject_id", "device_id", *table, "anchor_ms").agg(pick("timestamp").alias("found_ms"))


def as_of(ev: DataFrame, anchors: DataFrame, backward: bool, slice_ms: int = SLICE_MS) -> DataFrame:
    """found_ms: the first event at or after each anchor, or the last before it, by subject, device and table.

    Time is cut into slices.  Of each device, table and slice only the first and the last event are kept, but for slices
    that hold an anchor: their events are merged with the anchors in order of time and the nearest value is carried over.
    Where an anchor's slice has none on its side, the boundary value of the nearest slice that has is carried over in the
    same way.  So a device of very many events is cut by time, and each event is sorted once however many anchors there
    are.  Anchors without an event on their side have no row.
    """
    table = [c for c in ("table_name",) if c in ev.columns]
    group = ["device_id", *table]
    slice_of = lambda c: _time_bin(F.col(c), slice_ms)
    a = anchors.select("subject_id", "device_id", "anchor_ms").distinct().filter("device_id is not null and anchor_ms is not null")
    devices = a.groupBy(F.col("device_id").alias("a_device_id")).agg(F.min("anchor_ms").alias("first_anchor"), F.max("anchor_ms").alias("last_anchor"))
    side = F.col("timestamp") < F.col("last_anchor") if backward else F.col("timestamp") >= F.col("first_anchor")
    e = ev.select(*group, "timestamp").join(small(devices), (F.col("device_id") == F.col("a_device_id")) & side, "left_semi").withColumn("slice", slice_of("timestamp"))
    slices = e.groupBy(*group, "slice").agg((F.max if backward else F.min)("timestamp").alias("found_ms"))
    asked = a.withColumn("slice", slice_of("anchor_ms"))
    if table:
        asked = asked.join(slices.select(*group).distinct(), "device_id")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in a.dtypes if c != "device_id"]
    order = F.col("slice") if backward else F.desc("slice")

    def merged(found: DataFrame, window) -> DataFrame:
        rows = found.select(*group, "slice", *nothing, "found_ms").unionByName(asked.withColumn("found_ms", F.lit(None).cast("long")))
        rows = rows.withColumn("at", F.coalesce("anchor_ms", "found_ms")).withColumn("carried", F.last("found_ms", ignorenulls=True).over(window))
        return rows.filter("anchor_ms is not null").select("subject_id", *group, "anchor_ms", F.col("carried").alias("found_ms"))

    before = merged(slices, Window.partitionBy(*group).orderBy(order).rangeBetween(Window.unboundedPreceding, -1))
    own = asked.select(F.col("device_id").alias("a_device_id"), F.col("slice").alias("a_slice")).distinct()
    inside = e.join(small(own), (F.col("device_id") == F.col("a_device_id")) & (F.col("slice") == F.col("a_slice")), "left_semi")
    # At the same time a backward search meets the anchor first, so that "before" is strict; a forward one the event.
    ties = F.col("anchor_ms").isNull() if backward else F.col("anchor_ms").isNotNull()
    by_time = [F.col("at") if backward else F.desc("at"), ties]
    within = merged(inside.withColumn("found_ms", F.col("timestamp")), Window.partitionBy(*group, "slice").orderBy(*by_time).rowsBetween(Window.unboundedPreceding, 0))
    out = within.unionByName(before).groupBy("subject_id", *group, "anchor_ms").agg((F.max if backward else F.min)("found_ms").alias("found_ms"))
    return out.filter("found_ms is not null")


def _around(ev: DataFrame, anchors: DataFrame, horizon_ms: int, backward: bool) -> DataFrame:
    a = fetched(anchors.select("subject_id", "device_id", "anchor_ms"))
    at, found = F.col("anchor_ms"), F.col("found_ms")
    if a.rows is not None and a.most_per("device_id") <= FEW_ANCHORS:
        low, high = (at - horizon_ms, at - 1) if backward else (at, at + horizon_ms)
        return _joined_around(ev, a.df, low, high, F.max if backward else F.min)
    return as_of(ev, a.df, backward).filter(found >= at - horizon_ms if backward else found <= at + horizon_ms)


def first_event_after(ev: DataFrame, anchors: DataFrame, horizon_ms: int) -> DataFrame:
    """found_ms: the first event in [anchor, anchor + horizon], both included, by subject, device and table."""
    return _around(ev, anchors, horizon_ms, backward=False)


def last_event_before(ev: DataFrame, anchors: DataFrame, horizon_ms: int) -> DataFrame:
    """found_ms: the last event in [anchor - horizon, anchor)."""
    return _around(ev, anchors, horizon_ms, backward=True)


def has_rows(ev: DataFrame, win: DataFrame, by_table: bool = False) -> DataFrame:
    """The windows in which their device has any event.

    The events are reduced to the different windows that they fall into before anything is joined back.
    """
    key = [c for c in ("device_id", "table_name", "start_ms", "end_ms") if c in win.columns and (c != "table_name" or by_table)]
    hit = range_join(ev.select("device_id", *(["table_name"] if by_table else []), "timestamp"), win.select(*key).distinct(), by_table=by_table)
    return win.join(hit.select(*key).distinct(), key, "left_semi")

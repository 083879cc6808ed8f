"""Which rows count: rules that choose a time window for each subject and table.

Subjects have subject_id, t1_ms and t2_ms (local midnights, or any anchor), and for the calendar rules t1_date and
t2_date.  Devices are (subject_id, device_id).  Each rule reads the events once or twice for all subjects and tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_TZ, local_midnight_ms, percentile
from .rangejoin import first_event_after, range_join, small

HOUR, DAY = 3_600_000, 86_400_000


def early_late_windows(subjects: DataFrame, days: int = 7, tz: str = DEFAULT_TZ, keep: list[str] = ()) -> DataFrame:
    """Calendar windows: early [T1, T1+days), late [T2-days, T2), t1_day [T1 00:00, next 00:00 - 1 ms], at local
    midnights, so 23 or 25 hours a day where summer time changes."""

    def window(rule: str, first, last, less: int = 0):
        return F.struct(F.lit(rule).alias("window_rule"), local_midnight_ms(first, tz).alias("start_ms"), (local_midnight_ms(last, tz) - less).alias("end_ms"))

    rows = F.array(
        window("early", F.col("t1_date"), F.date_add("t1_date", days)),
        window("late", F.date_sub("t2_date", days), F.col("t2_date")),
        window("t1_day", F.col("t1_date"), F.date_add("t1_date", 1), 1),
    )
    return subjects.select("subject_id", *keep, F.explode(rows).alias("w")).select("subject_id", *keep, "w.*")


def absolute_window(start, hours: int = 24):
    """[start, start + hours) in absolute time: unlike a calendar day it is as long on every date."""
    return F.struct(start.alias("start_ms"), (start + hours * HOUR).alias("end_ms"))


def _devices(ev: DataFrame, subjects: DataFrame, devices: DataFrame, *columns: str) -> DataFrame:
    who = small(subjects.select("subject_id", *columns).join(devices, "subject_id"))
    return ev.select("device_id", "table_name", "timestamp").join(who, "device_id")


def _all_tables(ev_or_found: DataFrame, subjects: DataFrame, tables: list[str] | None) -> DataFrame:
    if tables is None:
        return ev_or_found
    grid = subjects.select("subject_id", F.explode(F.array(*[F.lit(t) for t in tables])).alias("table_name"))
    return grid.join(ev_or_found, ["subject_id", "table_name"], "left")


def t1_day_or_fallback(ev, subjects, devices, hours: int = 24, tables: list[str] | None = None) -> DataFrame:
    """[T1+1d, +hours) if any device has a row there, else [first event in [T1, T1+7d-hours], +hours), else none."""
    e = _devices(ev, subjects, devices, "t1_ms")
    t, t1 = F.col("timestamp"), F.col("t1_ms")
    e = e.filter((t >= t1) & (t <= F.greatest(t1 + DAY + hours * HOUR, t1 + 7 * DAY)))
    found = e.groupBy("subject_id", "table_name", "t1_ms").agg(
        F.coalesce(F.bool_or((t >= t1 + DAY) & (t < t1 + DAY + hours * HOUR)), F.lit(False)).alias("primary"),
        F.min(F.when((t >= t1) & (t <= t1 + 7 * DAY - hours * HOUR), t)).alias("first_ms"),
    )
    start = F.when(F.col("primary"), F.col("t1_ms") + DAY).otherwise(F.col("first_ms"))
    out = _all_tables(found.withColumn("start_ms", start).drop("t1_ms"), subjects, tables)
    rule = F.when(F.coalesce("primary", F.lit(False)), "t1_primary_day").when(F.col("start_ms").isNotNull(), "t1_week_fallback").otherwise("no_window")
    return out.select("subject_id", "table_name", rule.alias("window_rule"), "start_ms", (F.col("start_ms") + hours * HOUR).alias("end_ms"))


def first_available_after(ev, subjects, devices, days: int = 7, min_rows: int = 20, bounded: bool = True) -> DataFrame:
    """Each device's first event (at or after T1 if bounded) starts a window of `days`; of the devices with min_rows
    in theirs the earliest start wins, then the smaller device_id."""
    e = _devices(ev, subjects, devices, "t1_ms")
    e = e.filter(F.col("timestamp") >= F.col("t1_ms")) if bounded else e
    key = ["subject_id", "table_name", "device_id"]
    starts = e.groupBy(*key, "t1_ms").agg(F.min("timestamp").alias("start_ms"))
    counted = e.drop("t1_ms").join(starts, key).filter(F.col("timestamp") < F.col("start_ms") + days * DAY)
    counted = counted.groupBy(*key, "t1_ms", "start_ms").agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    best = Window.partitionBy("subject_id", "table_name").orderBy("start_ms", "device_id")
    chosen = counted.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    after = F.floor((F.col("start_ms") - F.col("t1_ms")) / DAY).cast("long")
    return chosen.select(*key, F.lit("first_available").alias("window_rule"), "start_ms", (F.col("start_ms") + days * DAY).alias("end_ms"), "n_rows", after.alias("days_after_t1"))


def t2_week_or_fallback(ev, subjects, devices, hours: int = 24, adjusted: bool = False) -> DataFrame:
    """The week before T2, else the 30 days before; the chosen device's rows only.

    24-hour tables: the earliest first event in [T2-7d, T2-hours] starts the window; else the latest event in
    [T2-30d, T2-hours] ends it, [latest-hours, latest+1).  Adjusted tables: all of [T2-7d, T2) of the device with the
    earliest event there; else [max(T2-30d, latest-7d), latest+1).
    """
    e = _devices(ev, subjects, devices, "t2_ms")
    t, t2 = F.col("timestamp"), F.col("t2_ms")
    week_end, back_end = (t2 - 1, t2 - 1) if adjusted else (t2 - hours * HOUR, t2 - hours * HOUR)
    e = e.filter(t.between(t2 - 30 * DAY, F.greatest(week_end, back_end)))
    found = e.groupBy("subject_id", "table_name", "device_id", "t2_ms").agg(
        F.min(F.when(t.between(t2 - 7 * DAY, week_end), t)).alias("first_ms"), F.max(F.when(t.between(t2 - 30 * DAY, back_end), t)).alias("latest_ms")
    )
    best = Window.partitionBy("subject_id", "table_name").orderBy(F.asc_nulls_last("first_ms"), F.desc("latest_ms"), "device_id")
    chosen = found.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    week = F.col("first_ms").isNotNull()
    if adjusted:
        start = F.when(week, t2 - 7 * DAY).otherwise(F.greatest(t2 - 30 * DAY, F.col("latest_ms") - 7 * DAY))
        end = F.when(week, t2).otherwise(F.col("latest_ms") + 1)
    else:
        start = F.when(week, F.col("first_ms")).otherwise(F.col("latest_ms") - hours * HOUR)
        end = F.when(week, F.col("first_ms") + hours * HOUR).otherwise(F.col("latest_ms") + 1)
    return chosen.select("subject_id", "table_name", "device_id", F.when(week, "t2_week").otherwise("t2_30d_fallback").alias("window_rule"), start.alias("start_ms"), end.alias("end_ms"))


def availability_anchored(ev, subjects, devices, endpoint: str = "t1", days: int = 10) -> DataFrame:
    """T1: first event in [T1, T1+days] and `days` from it.  T2: last event in [T2-30d, T2] and `days` back from it,
    that event included.  One device a subject and table."""
    anchor = F.col(f"{endpoint}_ms")
    e = _devices(ev, subjects, devices, f"{endpoint}_ms")
    t = F.col("timestamp")
    first = endpoint == "t1"
    e = e.filter(t.between(anchor, anchor + days * DAY) if first else t.between(anchor - 30 * DAY, anchor))
    found = e.groupBy("subject_id", "table_name", "device_id").agg((F.min if first else F.max)("timestamp").alias("found_ms"))
    best = Window.partitionBy("subject_id", "table_name").orderBy(F.asc("found_ms") if first else F.desc("found_ms"), "device_id")
    chosen = found.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    start = F.col("found_ms") if first else F.col("found_ms") - days * DAY
    end = F.col("found_ms") + days * DAY if first else F.col("found_ms") + 1
    return chosen.select("subject_id", "table_name", "device_id", F.lit(f"{endpoint}_{days}d_anchored").alias("window_rule"), start.alias("start_ms"), end.alias("end_ms"))


def fixed_windows(subjects: DataFrame, days: list[int] = (7, 14, 30)) -> DataFrame:
    """[T1, T1 + d) for each d."""
    rows = subjects.select("subject_id", "t1_ms", F.explode(F.array(*[F.lit(d) for d in days])).alias("d"))
    return rows.select("subject_id", F.format_string("t1_%dd", "d").alias("window_rule"), F.col("t1_ms").alias("start_ms"), (F.col("t1_ms") + F.col("d").cast("long") * DAY).alias("end_ms"))


def day_boundary_windows(subjects: DataFrame) -> DataFrame:
    """The day after T1, [T1, T1+1d), and the day before T2, [T2-1d, T2)."""
    w = lambda rule, a, b: F.struct(F.lit(rule).alias("window_rule"), a.alias("start_ms"), b.alias("end_ms"))
    t1, t2 = F.col("t1_ms"), F.col("t2_ms")
    rows = F.array(w("t1_plus_1d", t1, t1 + DAY), w("t2_minus_1d", t2 - DAY, t2))
    return subjects.select("subject_id", F.explode(rows).alias("w")).select("subject_id", "w.*").where("start_ms is not null")


def metadata_anchor_windows(qc: DataFrame, hours: int = 24) -> DataFrame:
    """Windows that start where another table's QC row (subject_id, device_id, first_ms) starts."""
    return qc.where("first_ms is not null").select("subject_id", "device_id", F.lit("metadata_anchor").alias("window_rule"), F.col("first_ms").alias("start_ms"), (F.col("first_ms") + hours * HOUR).alias("end_ms"))


def first_raw_candidate(ev, ranked_subjects: DataFrame, devices, min_rows: int = 1000, hours: int = 24) -> DataFrame:
    """The first subject by rank_no whose earliest event in the week after T1 starts `hours` with min_rows rows."""
    e = _devices(ev, ranked_subjects, devices, "t1_ms", "rank_no").filter(F.col("timestamp").between(F.col("t1_ms"), F.col("t1_ms") + 7 * DAY))
    first = e.groupBy("subject_id", "rank_no", "table_name", "device_id").agg(F.min("timestamp").alias("start_ms"))
    n = e.select("device_id", "table_name", "timestamp", "subject_id").join(first, ["subject_id", "table_name", "device_id"])
    n = n.filter(F.col("timestamp") < F.col("start_ms") + hours * HOUR).groupBy("subject_id", "rank_no", "table_name", "device_id", "start_ms").agg(F.count(F.lit(1)).alias("n_rows"))
    best = Window.partitionBy("table_name").orderBy("rank_no", "start_ms", "device_id")
    chosen = n.filter(F.col("n_rows") >= min_rows).withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    return chosen.select("table_name", "subject_id", "device_id", "start_ms", (F.col("start_ms") + hours * HOUR).alias("end_ms"), "n_rows")


def first_row_windows(ev: DataFrame, subjects: DataFrame, devices: DataFrame, days: int = 120, hours: int = 24) -> DataFrame:
    """For each subject's device and table the `hours` from its first event in the `days` after T1."""
    anchors = subjects.select("subject_id", F.col("t1_ms").alias("anchor_ms")).join(devices, "subject_id")
    found = first_event_after(ev, anchors, days * DAY)
    return found.select("subject_id", "device_id", *[c for c in ("table_name",) if c in found.columns], F.col("found_ms").alias("start_ms"), (F.col("found_ms") + hours * HOUR).alias("end_ms"))


def hourly_density(ev: DataFrame, win: DataFrame, cap: int = 5000) -> DataFrame:
    """For each hour of each window: rows seen (up to cap), median interval (ms), estimated rows (from the interval
    where the cap is reached).  Hours without rows are kept with 0."""
    hours = win.select("subject_id", "device_id", "start_ms", F.explode(F.sequence(F.lit(0), F.ceil((F.col("end_ms") - F.col("start_ms")) / HOUR).cast("int") - 1)).alias("hour_no"))
    e = range_join(ev, win, by_table=False).withColumn("hour_no", F.floor((F.col("timestamp") - F.col("start_ms")) / HOUR).cast("int"))
    order = Window.partitionBy("subject_id", "device_id", "start_ms", "hour_no").orderBy("timestamp", "_id")
    e = e.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= cap).withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(order))
    key = ["subject_id", "device_id", "start_ms", "hour_no"]
    stats = e.groupBy(*key).agg(F.count(F.lit(1)).alias("rows_seen"), percentile("gap", 0.5).alias("median_gap_ms"))
    out = hours.join(stats, key, "left").withColumn("rows_seen", F.coalesce("rows_seen", F.lit(0)))
    estimate = F.when((F.col("rows_seen") >= cap) & (F.col("median_gap_ms") > 0), F.round(HOUR / F.col("median_gap_ms")).cast("long")).otherwise(F.col("rows_seen"))
    return out.select(*key, "rows_seen", "median_gap_ms", estimate.alias("estimated_rows"), (F.col("rows_seen") > 0).alias("has_rows"))


def probe_windows(spans: DataFrame, step_ms: int, width_ms: int, lead_ms: int = 0, backward: bool = False) -> DataFrame:
    """Windows [anchor - lead, anchor - lead + width) at anchors that step through [start_ms, end_ms], from its end if
    backward; probe_no counts from 0."""
    anchors = F.sequence(F.col("end_ms"), F.col("start_ms"), F.lit(-step_ms).cast("long")) if backward else F.sequence(F.col("start_ms"), F.col("end_ms"), F.lit(step_ms).cast("long"))
    rows = spans.select("subject_id", "device_id", F.posexplode(anchors).alias("probe_no", "anchor_ms"))
    return rows.select("subject_id", "device_id", "probe_no", "anchor_ms", (F.col("anchor_ms") - lead_ms).alias("start_ms"), (F.col("anchor_ms") - lead_ms + width_ms).alias("end_ms"))


def probe_hits(ev: DataFrame, probes: DataFrame) -> DataFrame:
    """First and last probe with a row, and how many have one, by subject and device."""
    e = range_join(ev.select("device_id", "timestamp"), probes, by_table=False).select("subject_id", "device_id", "probe_no").distinct()
    hits = e.groupBy("subject_id", "device_id").agg(F.min("probe_no").alias("first_hit"), F.max("probe_no").alias("last_hit"), F.count(F.lit(1)).alias("hits"))
    tried = probes.groupBy("subject_id", "device_id").agg(F.count(F.lit(1)).alias("probes"))
    return tried.join(hits, ["subject_id", "device_id"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def window_status(subjects: DataFrame, anchored: DataFrame, pending: DataFrame, broad: DataFrame, weekly: DataFrame) -> DataFrame:
    """One status and next action per subject (subject_id, has_metadata) from several validations.

    anchored: subject_id, score, status of the first pilot, of which the subject's row of largest score counts; pending
    and broad: subject_id, status of later probes; weekly: subject_id, hit of backward probes, all of which must miss.
    """
    pilot = anchored.groupBy("subject_id").agg(F.max_by("status", F.coalesce("score", F.lit(float("-inf")))).alias("_a"))
    one = lambda df, name: df.groupBy("subject_id").agg(F.min("status").alias(name))
    missed = weekly.groupBy("subject_id").agg((~F.bool_or("hit")).alias("_no_hit"))
    rows = subjects.select("subject_id", "has_metadata")
    for part in (pilot, one(pending, "_p"), one(broad, "_b"), missed):
        rows = rows.join(part, "subject_id", "left")
    a, p, b = (F.coalesce(F.trim(c), F.lit("")) for c in ("_a", "_p", "_b"))
    found = a.isin("raw_window_found_from_sensor_anchor_probe", "raw_window_found_from_sensor_daily_jump_probe") | (p == "raw_window_found_from_pending_metadata_probe") | (b == "raw_window_found_from_weekly_t1_t2_probe")
    daily = p == "missing_no_raw_rows_in_bounded_daily_probes"
    status = (
        F.when(found, "raw_24h_window_validated")
        .when(F.coalesce("_no_hit", F.lit(False)), "likely_no_usable_raw_accelerometer")
        .when(daily & (b == "missing_no_raw_rows_in_weekly_t1_t2_probes"), "no_raw_rows_in_broad_weekly_t1_t2_probe")
        .when(daily, "no_raw_rows_in_validated_metadata_window")
        .when(F.coalesce("has_metadata", F.lit(False)), "sensor_metadata_window_candidate_pending_raw_validation")
        .otherwise("no_sensor_accelerometer_metadata_after_T1")
    )
    s = F.col("data_window_status")
    action = (
        F.when(s == "raw_24h_window_validated", "ready_for_raw_24h_feature_extraction")
        .when(s == "sensor_metadata_window_candidate_pending_raw_validation", "run_raw_probe_validation_before_feature_extraction")
        .when(s == "no_sensor_accelerometer_metadata_after_T1", "not_ready_for_raw_accelerometer_phase")
        .otherwise("exclude_from_raw_accelerometer_phase_or_revisit_with_broader_manual_probe")
    )
    scope = F.when(F.col("_a").isNotNull(), "top10_pilot").when(F.col("_b").isNotNull(), "broad_weekly_t1_t2_validation").when(F.col("_p").isNotNull(), "pending_67_validation").otherwise("")
    known = F.coalesce(*[F.nullif(x, F.lit("")) for x in (a, b, p)], F.lit(""))
    out = rows.select("subject_id", scope.alias("raw_validation_scope"), known.alias("raw_validation_status"), status.alias("data_window_status"))
    return out.withColumn("next_action", action)


def first_valid_by_rank(long: DataFrame, subjects: DataFrame) -> DataFrame:
    """Of each table the first subject by score (ties by id) with any feature that isn't NULL."""
    valid = long.where("value is not null").select("subject_id", "table_name").distinct().join(subjects.select("subject_id", "score"), "subject_id")
    best = Window.partitionBy("table_name").orderBy(F.desc_nulls_last("score"), "subject_id")
    return valid.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("table_name", "subject_id", "score")

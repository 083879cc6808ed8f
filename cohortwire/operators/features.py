"""Behavioural features per subject, table and window.

Input is the output of range_join: subject_id, table_name, window_rule, device_id, timestamp, _id, data.  A group
without rows has no row here, so its features are NULL after the join with the windows, never 0.  Order within a
group is (timestamp, device_id, _id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

KEY = ["subject_id", "table_name", "window_rule"]
ORDER = ["timestamp", "device_id", "_id"]


def _get(name: str) -> Column:
    return F.col("payload")[name]


def _seq(*more: str) -> Window:
    return Window.partitionBy(*KEY, *more).orderBy(*ORDER)


class _Pass:
    """One pass over a table's windowed events: payloads are parsed once, everything that needs an order or a count is a
    window within KEY, and one aggregate by KEY follows, so the events are shuffled once.

    `ok` says which rows count: with skip_bad not those that are no JSON object, and of rows that agree in KEY and in
    the columns `once` the first only.
    """

    def __init__(self, we: DataFrame, values: dict[str, Column], skip_bad: bool, once: list[str] | None = None):
        self.rows = S.parse_json(we).select(*KEY, *ORDER, "parse_error", *[v.alias(k) for k, v in values.items()])
        ok = ~F.col("parse_error") if skip_bad else F.lit(True)
        if once:
            first = Window.partitionBy(*KEY, "parse_error", *once).orderBy(*ORDER)
            ok = ok & (F.row_number().over(first) == 1)
        self.rows = self.rows.withColumn("ok", ok)
        self.outputs: list[Column] = []

    def only(self, condition: Column) -> _Pass:
        """Rows where the condition doesn't hold, or is NULL, don't count either."""
        self.rows = self.rows.withColumn("ok", F.col("ok") & F.coalesce(condition, F.lit(False)))
        return self

    def add(self, **columns: Column) -> _Pass:
        self.rows = self.rows.withColumns(columns)
        return self

    def where_ok(self, value: Column) -> Column:
        return F.when(F.col("ok"), value)

    def previous(self, column: str, *within: str) -> Column:
        """The last value before a row that isn't NULL, of rows that count."""
        return F.last(F.when(F.col("ok"), F.col(column)), ignorenulls=True).over(_seq(*within).rowsBetween(Window.unboundedPreceding, -1))

    def entropy(self, column: str, name: str, distinct: str | None = None) -> _Pass:
        """Bits of the counts of a column's values: log2 N less the mean over the rows of log2 of their value's count."""
        value = F.when(F.col("ok"), F.col(column))
        self.rows = self.rows.withColumn(f"_{name}_v", value)
        self.rows = self.rows.withColumn(f"_{name}_n", F.count(f"_{name}_v").over(Window.partitionBy(*KEY, f"_{name}_v")))
        n = F.count(f"_{name}_v")
        bits = F.log2(n) - F.avg(F.when(F.col(f"_{name}_v").isNotNull(), F.log2(f"_{name}_n")))
        self.outputs.append(F.when(n > 0, F.abs(F.round(bits, 12))).alias(name))
        if distinct:
            self.outputs.append(F.when(n > 0, F.count_distinct(f"_{name}_v")).alias(distinct))
        return self

    def transitions(self, column: str, name: str) -> _Pass:
        """Changes between consecutive non-null values; NULL without any."""
        self.rows = self.rows.withColumn(f"_{name}", F.when(F.col("ok") & F.col(column).isNotNull(), F.col(column) != self.previous(column)))
        there = F.count(F.when(F.col("ok"), F.col(column)))
        self.outputs.append(F.when(there > 0, F.count_if(f"_{name}")).alias(name))
        return self

    def out(self, **columns: Column) -> DataFrame:
        """A row per group: the columns (aggregates over the rows that count; NULL if there is none), those added before,
        rows_in_window, json_parse_errors and feature_status."""
        there = F.count_if("ok")
        base = [F.count(F.lit(1)).alias("rows_in_window"), F.count_if("parse_error").alias("json_parse_errors")]
        out = self.rows.groupBy(*KEY).agg(*base, *[F.when(there > 0, v).alias(k) for k, v in columns.items()], *self.outputs)
        status = F.when(F.col("rows_in_window") == F.col("json_parse_errors"), "no_valid_rows").otherwise("computed")
        return out.withColumn("feature_status", status)


def _n(condition: Column | None = None) -> Column:
    ok = F.col("ok")
    return F.count_if(ok if condition is None else ok & F.coalesce(condition, F.lit(False)))


def _distinct(value: Column) -> Column:
    return F.count_distinct(F.when(F.col("ok"), value))


def _active_hours(tz: str) -> Column:
    return _distinct(S.local_hour_bucket("timestamp", tz))


# --------------------------------------------------------------------------------------------------- by table


def features_app(we: DataFrame) -> DataFrame:
    p = _Pass(we, {"app": S.first_text(_get("package_name"), _get("application_name"))}, skip_bad=False)
    return p.entropy("app", "app_entropy", "app_unique_count").out(app_event_count=_n())


def features_battery(we: DataFrame) -> DataFrame:
    p = _Pass(we, {"percent": S.battery_percent(_get("battery_level"), _get("battery_scale")), "plugged": S.charging_flag(_get("battery_adaptor"), _get("battery_status"))}, skip_bad=False)
    n_level, n_plug = F.count("percent"), F.count("plugged")
    return p.out(
        battery_low_count=F.when(n_level > 0, F.count_if(F.col("percent") <= 20)), battery_charging_count=F.when(n_plug > 0, F.count_if("plugged")),
        battery_level_rows=n_level, battery_charging_rows=n_plug,
    )


def features_bluetooth(we: DataFrame) -> DataFrame:
    """A missing address is missing, not a device of its own."""
    p = _Pass(we, {"address": F.nullif(F.trim(_get("bt_address")), F.lit("")), "rssi": _get("bt_rssi")}, True, ["timestamp", "device_id", "address", "rssi"])
    unique = _distinct(F.col("address"))
    return p.out(bt_observations=_n(), bt_unique_devices=unique, bt_unique_ratio=unique / _n())


def features_calls(we: DataFrame) -> DataFrame:
    p = _Pass(we, {"kind": S.to_number(_get("call_type")).cast("int"), "seconds": S.to_number(_get("call_duration"))}, skip_bad=False)
    kind = F.col("kind")
    return p.out(
        call_count=_n(), call_incoming=_n(kind == 1), call_outgoing=_n(kind == 2), call_missed=_n(kind.isin(3, 5, 6)), call_total_seconds=F.sum("seconds"), call_duration_rows=F.count("seconds")
    )


def _cells(p: _Pass, prefix: str) -> DataFrame:
    n = _n(F.col("cell").isNotNull())
    return p.transitions("cell", f"{prefix}_cell_transitions").out(
        **{f"{prefix}_unique_cells": F.when(n > 0, _distinct(F.col("cell"))), f"{prefix}_unique_areas": F.when(n > 0, _distinct(F.col("area")))}
    )


def _cell_text(name: str) -> Column:
    """Numeric 0 and blanks are no cell."""
    return F.nullif(F.nullif(F.trim(_get(name)), F.lit("")), F.lit("0"))


def features_gsm(we: DataFrame) -> DataFrame:
    return _cells(_Pass(we, {"cell": _cell_text("cid"), "area": _cell_text("lac")}, skip_bad=False), "gsm")


def features_gsm_neighbor(we: DataFrame) -> DataFrame:
    names = ("cid", "lac", "psc", "signal_strength")
    # Order within a millisecond is that of the cells, not of the rows.
    of_cells = F.concat_ws("|", *[F.coalesce(F.get_json_object("data", f"$.{n}"), F.lit("")) for n in names[:3]])
    we = we.withColumn("_id", of_cells).withColumn("device_id", F.lit(""))
    p = _Pass(we, {n: _get(n) for n in names} | {"cell": S.valid_cell(_get("cid")), "area": S.valid_cell(_get("lac"))}, True, ["timestamp", *names])
    return _cells(p, "gsm_neighbor")


def _keyboard(we: DataFrame) -> _Pass:
    names = {"before_text": "before", "current_text": "current", "package_name": "package", "is_password": "password"}
    values = {v: S.strip_brackets(_get(k)) if k.endswith("text") else _get(k) for k, v in names.items()}
    p = _Pass(we, values, True, ["timestamp", "device_id", *names.values()])
    # What comes before is of the same device and package, and of rows that count.
    within = Window.partitionBy(*KEY, "device_id", "package", "ok").orderBy(*ORDER)
    return p.add(gap_ms=F.col("timestamp") - F.lag("timestamp").over(within), previous=F.lag("current").over(within))


def features_keyboard(we: DataFrame, pause_s: float = 2, burst_s: float = 30) -> DataFrame:
    p = _keyboard(we)
    gap = F.when(F.col("ok"), F.col("gap_ms") / 1000.0)
    used = F.when((gap > 0) & (gap <= burst_s), gap)
    shorter = (F.length("current") < F.length("before")) | (F.length("current") < F.length("previous"))
    return p.out(
        key_event_count=_n(), key_gap_median_s=S.percentile(used, 0.5), key_gap_iqr_s=S.percentile(used, 0.75) - S.percentile(used, 0.25), key_long_pauses=F.count_if(gap > pause_s),
        key_bursts=_n(F.col("gap_ms").isNull() | (gap > burst_s)), key_deletions=_n(shorter),
    )


def features_keyboard_words(we: DataFrame, burst_s: float = 30) -> DataFrame:
    """Words completed and their median duration.

    A segment ends with each event that completes a word (its text ends in a space, the text before did not), and at
    each gap over burst_s.  Within a segment the word starts at the last event whose text before ended in a space, else
    at the first that shows a letter; without a start nothing is complete.
    """
    p = _keyboard(we)
    p.rows = p.rows.withColumn("current", F.coalesce("current", F.lit(""))).withColumn("before", F.coalesce("before", F.lit("")))
    within = Window.partitionBy(*KEY, "device_id", "package", "ok").orderBy(*ORDER)
    done = F.col("current").endswith(" ") & ~F.col("before").endswith(" ")
    shows = ~F.col("current").endswith(" ") & (F.trim("current") != "")
    p.add(done=done, cut=(F.coalesce(F.lag(done).over(within), F.lit(False)) | F.coalesce(F.col("gap_ms") > burst_s * 1000, F.lit(False))).cast("int"))
    p.add(segment=F.sum("cut").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy(*KEY, "device_id", "package", "ok", "segment")
    at = F.col("timestamp")
    start = F.coalesce(F.max(F.when(shows & F.col("before").endswith(" "), at)).over(whole), F.min(F.when(shows, at)).over(whole))
    # The event that completes the word is the segment's last, so each word counts once.
    p.add(seconds=F.when(F.col("ok") & F.col("done"), (at - start) / 1000.0))
    return p.out(key_words_completed=F.count("seconds"), key_word_median_s=S.percentile("seconds", 0.5))


def features_light(we: DataFrame, dark: float = 10, tz: str = S.DEFAULT_TZ) -> DataFrame:
    p = _Pass(we, {"lux": S.json_field("data", "$.double_light_lux", "decimal(18,6)").cast("double")}, skip_bad=False).only(F.col("lux").isNotNull() & F.col("timestamp").isNotNull())
    lux = F.when(F.col("ok"), F.col("lux"))
    return p.out(
        light_samples=_n(), light_median_lux=S.percentile(lux, 0.5), light_dark_percent=100.0 * F.count_if(lux < dark) / _n(),
        light_night_mean_lux=F.avg(F.when(S.is_night("timestamp", tz), lux)), light_iqr_lux=S.percentile(lux, 0.75) - S.percentile(lux, 0.25),
    )


def features_locations(we: DataFrame) -> DataFrame:
    names = {"double_latitude": "raw_lat", "double_longitude": "raw_lon", "provider": "provider", "accuracy": "accuracy"}
    p = _Pass(we, {v: _get(k) for k, v in names.items()}, True, ["timestamp", *names.values()])
    p.add(lat=S.to_number("raw_lat"), lon=S.to_number("raw_lon"))
    p.add(place=F.when(F.col("ok") & S.valid_position("lat", "lon"), F.struct("lat", "lon")))
    p.add(last=p.previous("place"))
    p.add(km=F.when(F.col("place").isNotNull(), S.haversine_km(F.col("last.lat"), F.col("last.lon"), F.col("lat"), F.col("lon"))))
    n = F.count("place")
    return p.out(location_observations=_n(), location_path_km=F.sum("km"), location_valid_points=F.when(n > 0, n))


def features_messages(we: DataFrame) -> DataFrame:
    p = _Pass(we, {"trace": _get("trace"), "kind": F.trim(_get("message_type"))}, True, ["timestamp", "trace", "kind"])
    return p.out(message_count=_n(), message_outgoing=_n(F.col("kind") == "2"))


def features_activity(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    p = _Pass(we, {"activity": F.lower(S.best_activity("data")["label"])}, skip_bad=True).only(F.col("activity").isNotNull())
    p.entropy("activity", "activity_entropy").transitions("activity", "activity_transitions")
    of = lambda label: _n(F.col("activity") == label) / _n()
    return p.out(activity_events=_n(), activity_still_fraction=of("still"), activity_unknown_fraction=of("unknown"), activity_active_hours=_active_hours(tz))


def _screen(we: DataFrame) -> _Pass:
    return _Pass(we, {"status": S.to_number(_get("screen_status")).cast("int")}, skip_bad=True).only(F.col("status").isNotNull())


def features_screen(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    p = _screen(we).transitions("status", "screen_transitions")
    counts = {f"screen_{name}_count": _n(F.col("status") == k) for k, name in ((0, "off"), (1, "on"), (3, "unlock"))}
    return p.out(screen_events=_n(), **counts, screen_active_hours=_active_hours(tz), screen_night_events=_n(S.is_night("timestamp", tz)))


def features_screen_sessions(we: DataFrame) -> DataFrame:
    """Sessions from the last unlock (3) since the last close to the next close (0 or 2)."""
    p = _screen(we)
    closes = F.col("ok") & F.col("status").isin(0, 2)
    p.add(session=F.coalesce(F.sum(closes.cast("int")).over(_seq().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    unlocked = F.max(F.when(F.col("ok") & (F.col("status") == 3), F.col("timestamp"))).over(Window.partitionBy(*KEY, "session"))
    # A session has one close, its last event.
    p.add(seconds=F.when(closes, (F.col("timestamp") - unlocked) / 1000.0))
    return p.out(screen_sessions=F.count("seconds"), screen_session_median_s=S.percentile("seconds", 0.5))


def features_telephony(we: DataFrame) -> DataFrame:
    p = _Pass(we, {"enabled": S.data_enabled(_get("data_enabled")), "network": F.nullif(F.trim(_get("network_type")), F.lit(""))}, skip_bad=True)
    p.entropy("network", "telephony_network_entropy")
    return p.out(telephony_events=_n(), telephony_data_fraction=_n(F.col("enabled")) / F.nullif(_n(F.col("enabled").isNotNull()), F.lit(0)))


def features_touch(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    names = {"touch_app": "raw_app", "touch_action": "action", "touch_action_text": "said", "scroll_items": "items", "scroll_from_index": "from_i", "scroll_to_index": "to_i"}
    p = _Pass(we, {v: _get(k) for k, v in names.items()}, True, ["timestamp", "device_id", *names.values()])
    p.add(app=F.nullif(F.trim("raw_app"), F.lit("")), upper_action=F.upper(F.coalesce("action", F.lit(""))), direction=S.scroll_direction("action"))
    p.entropy("app", "touch_app_entropy").transitions("direction", "touch_direction_changes")
    start, stop = S.to_number("from_i"), S.to_number("to_i")
    distance = F.when(F.col("ok") & (start >= 0) & (stop >= 0), F.abs(stop - start))
    return p.out(
        touch_events=_n(), touch_clicks=_n(F.col("upper_action") == "ACTION_AWARE_TOUCH_CLICKED"), touch_scrolls=_n(F.col("upper_action").contains("SCROLLED")),
        touch_unique_apps=_distinct(F.col("app")), touch_active_hours=_active_hours(tz), touch_scroll_median=S.percentile(distance, 0.5),
    )


def features_significant(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    p = _Pass(we, {"moving": S.is_moving(_get("is_moving"))}, skip_bad=False).transitions("moving", "significant_transitions")
    known = F.nullif(F.count("moving"), F.lit(0))
    return p.out(significant_events=_n(), significant_moving=F.count_if("moving"), significant_moving_fraction=F.count_if("moving") / known, significant_active_hours=_active_hours(tz))


def features_sensor_meta(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    names = {"double_sensor_resolution": "resolution", "double_sensor_maximum_range": "range", "double_sensor_power_ma": "power", "double_sensor_minimum_delay": "min_delay"}
    p = _Pass(we, {v: S.to_number(_get(k)) for k, v in names.items()}, skip_bad=True)
    return p.out(sensor_events=_n(), sensor_active_hours=_active_hours(tz), **{f"sensor_median_{v}": S.percentile(F.when(F.col("ok"), F.col(v)), 0.5) for v in names.values()})


# ---------------------------------------------------------------------------------------- first-phase counts


def features_window_counts(we: DataFrame, tz: str = S.DEFAULT_TZ, value: Column | None = None) -> DataFrame:
    """Events, active local days, night events, events per active day, and the entropy of a value if one is named."""
    n, days = F.count(F.lit(1)), F.count_distinct(S.local_day("timestamp", tz))
    out = [n.alias("event_count"), days.alias("active_days"), F.count_if(S.is_night("timestamp", tz)).alias("night_events"), (n / days).alias("events_per_active_day")]
    rows = we.select(*KEY, "timestamp", *([] if value is None else [value.alias("_v")]))
    if value is not None:
        rows = rows.withColumn("_n", F.count("_v").over(Window.partitionBy(*KEY, "_v")))
        bits = F.log2(F.count("_v")) - F.avg(F.when(F.col("_v").isNotNull(), F.log2("_n")))
        out.append(F.when(F.count("_v") > 0, F.abs(F.round(bits, 12))).alias("value_entropy"))
    return rows.groupBy(*KEY).agg(*out)


def features_activity_counts(we: DataFrame, confident: float = 50) -> DataFrame:
    p = we.withColumn("best", S.best_activity("data")).where("best is not null")
    label, conf = F.lower(F.col("best.label")), F.col("best.confidence")
    return p.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("activity_events"), *[F.count_if(label == k).alias(f"activity_{k}_count") for k in ("still", "walking", "in_vehicle")],
        F.count_distinct(label).alias("activity_diversity"), F.count_if(conf >= confident).alias("activity_confident_count"), F.avg(conf).alias("activity_mean_confidence"),
    )


#: Worst first: the roll-up of several devices takes the first of these that any has.
STATUS_ORDER = ["error", "json_parse_error", "missing_device_id", "missing_time_window", "ok_no_data", "ok_has_data"]


def roll_up_subjects(device_rows: DataFrame, value_counts: DataFrame | None = None, days: DataFrame | None = None) -> DataFrame:
    """Device rows (KEY, device_id, n_rows, night_events, status) to subjects: sums, the worst status, the union of
    active days (KEY, day) and the entropy of merged counts (KEY, value, n), none of which is an average."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status"))
    base = device_rows.groupBy(*KEY).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("night_events").alias("night_events"), F.count_distinct("device_id").alias("n_devices"), F.min_by("status", rank).alias("status")
    )
    if days is not None:
        base = base.join(days.groupBy(*KEY).agg(F.count_distinct("day").alias("active_days")), KEY, "left")
    if value_counts is not None:
        merged = value_counts.groupBy(*KEY, "value").agg(F.sum("n").alias("n"))
        total = F.sum("n")
        merged = merged.groupBy(*KEY).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("value_entropy"), F.count(F.lit(1)).alias("value_unique"))
        base = base.join(merged, KEY, "left")
    return base


def stream_qc(we: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Quality of a metadata stream in its window: span, active days and hours, gaps, values seen, implied rate."""
    w = we.withColumn("gap_s", (F.col("timestamp") - F.lag("timestamp").over(_seq())) / 1000.0).withColumn("min_delay", S.json_field("data", "$.double_sensor_minimum_delay", "double"))
    gap = F.col("gap_s")
    out = w.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), ((F.max("timestamp") - F.min("timestamp")) / 3_600_000.0).alias("span_hours"),
        F.count_distinct(S.local_day("timestamp", tz)).alias("active_days"), F.count_distinct(S.local_hour_bucket("timestamp", tz)).alias("active_hours"),
        S.percentile(gap, 0.5).alias("gap_median_s"), S.percentile(gap, 0.95).alias("gap_p95_s"), F.max(gap).alias("gap_max_s"),
        F.count_if(gap > 300).alias("gaps_over_5min"), F.count_if(gap > 3600).alias("gaps_over_1h"), (1e6 / F.nullif(F.min("min_delay"), F.lit(0.0))).alias("implied_max_hz"),
    )
    seen = w.groupBy(*KEY, F.col("min_delay").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).where("v is not null")
    seen = seen.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "v", "n"))), ";").alias("delay_values"))
    level = F.when(F.col("active_hours") >= 20, "ready").when(F.col("active_hours") >= 6, "partial").otherwise("sparse")
    return out.join(seen, KEY, "left").withColumn("readiness", level)

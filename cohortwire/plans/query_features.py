"""Queries: the flagship, features by table, signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import reshape as L
from ..operators import signal as G
from ..operators.rangejoin import small
from . import stand_ins as A
from .register import Register, rounded

REGISTER = query = Register()
DAY = 86_400_000
KEY = "subject_id, table_name, window_rule"
LOCAL = f"make_timestamp((timestamp + {A.SHIFT}) * 1000)"
NIGHT = f"(hour({LOCAL}) >= 22 OR hour({LOCAL}) < 6)"
HOUR = f"strftime({LOCAL}, '%Y-%m-%d %H')"


def _from_payload(fields: str, where: str = "true") -> str:
    return f"{A.ALL}, p AS (SELECT *, {fields} FROM we WHERE {where})"


@query(f"""{A.ALL}, w AS (SELECT subject_id, window_rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT CAST({LOCAL} AS DATE)) AS DOUBLE) AS d, CAST(count_if({NIGHT}) AS DOUBLE) AS g FROM we GROUP BY ALL),
    p AS (SELECT s.subject_id, e.n AS early_events, e.d AS early_active_days, e.g AS early_night_events, e.n / e.d AS e_rate, l.n AS late_events, l.d AS late_active_days, l.g AS late_night_events, l.n / l.d AS l_rate
          FROM sub s LEFT JOIN (SELECT * FROM w WHERE window_rule = 'early') e USING (subject_id) LEFT JOIN (SELECT * FROM w WHERE window_rule = 'late') l USING (subject_id))
    SELECT subject_id, early_events, early_active_days, early_night_events, round(e_rate, 6) AS early_events_per_day, late_events, late_active_days, late_night_events, round(l_rate, 6) AS late_events_per_day,
        late_events - early_events AS events_delta, round(CASE WHEN early_events > 0 THEN 100.0 * (late_events - early_events) / early_events END, 6) AS events_pct_change,
        CASE WHEN early_events IS NOT NULL AND late_events IS NOT NULL THEN 'both' WHEN early_events IS NOT NULL THEN 'early_only' WHEN late_events IS NOT NULL THEN 'late_only' ELSE 'none' END AS events_delta_status FROM p""")
def flagship_window_features(spark, sf_dir):
    """Events, active days, night events and events per day of each subject in the early and the late window, and
    their change where both windows have data."""
    e = A.events(spark, sf_dir)
    f = X.features_window_counts(A.windowed(e).withColumn("table_name", F.lit("all")), A.TZ)
    f = f.withColumn("table_has_data", F.lit(True)).withColumn("status", F.lit("ok_has_data"))
    names = ["event_count", "active_days", "night_events", "events_per_active_day"]
    wide = L.early_late_wide(f, names, "{window}_{name}", ["all"])
    for w in ("early", "late"):
        wide = wide.withColumnsRenamed({f"{w}_event_count": f"{w}_events", f"{w}_events_per_active_day": f"{w}_events_per_day"})
        wide = wide.withColumns({c: F.col(c).cast("double") for c in (f"{w}_events", f"{w}_active_days", f"{w}_night_events")})
    out = A.subjects(e).select("subject_id").join(L.add_deltas(wide, {"events": ("early_events", "late_events")}), "subject_id", "left")
    out = out.withColumn("events_delta_status", F.coalesce("events_delta_status", F.lit("none")))
    return rounded(out, "early_events_per_day", "late_events_per_day", "events_pct_change")


@query(f"""{A.ALL}, c AS (SELECT {KEY}, CAST(user_id % 4 AS VARCHAR) AS v, count(*) AS n FROM we GROUP BY ALL), h AS (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS u, sum(n) AS t FROM c GROUP BY ALL)
    SELECT {KEY}, CAST(t AS BIGINT) AS app_event_count, round(abs(h), 6) AS app_entropy, u AS app_unique_count FROM h""")
def features_app(spark, sf_dir):
    e = A.events(spark, sf_dir)
    data = A.payload(package_name=F.lit(""), application_name=(F.col("user_id") % 4).cast("string"))
    f = X.features_app(A.windowed(e.withColumn("data", data)))
    return rounded(f.select(*X.KEY, "app_event_count", "app_entropy", "app_unique_count"), "app_entropy")


@query(f"""{_from_payload("CASE WHEN value > 60 THEN NULL ELSE value END AS pct, _id % 3 AS ad, _id % 7 AS st")}
    SELECT {KEY}, CASE WHEN count(pct) > 0 THEN count_if(pct <= 20) END AS battery_low_count, count_if(ad <> 0 OR st IN (2, 5)) AS battery_charging_count, count(pct) AS battery_level_rows, count(*) AS battery_charging_rows, count(*) AS rows_in_window FROM p GROUP BY ALL""")
def features_battery(spark, sf_dir):
    e = A.events(spark, sf_dir)
    level = F.when(F.col("value") <= 60, F.col("value") * 2).cast("string")
    data = A.payload(battery_level=level, battery_scale=F.lit("200"), battery_adaptor=(F.col("_id") % 3).cast("string"), battery_status=(F.col("_id") % 7).cast("string"))
    f = X.features_battery(A.windowed(e.withColumn("data", data)))
    return f.select(*X.KEY, "battery_low_count", "battery_charging_count", "battery_level_rows", "battery_charging_rows", "rows_in_window")


@query(f"""{A.ALL}, p AS (SELECT DISTINCT {KEY}, timestamp, device_id, CASE WHEN _id % 5 <> 0 THEN 'b' || (_id % 9) END AS a, _id % 2 AS r FROM we)
    SELECT {KEY}, count(*) AS bt_observations, count(DISTINCT a) AS bt_unique_devices, round(count(DISTINCT a) / count(*), 6) AS bt_unique_ratio FROM p GROUP BY ALL""")
def features_bluetooth(spark, sf_dir):
    """Every event is read twice: the copies fall to the de-duplication."""
    e = A.events(spark, sf_dir)
    data = A.payload(bt_address=F.when(F.col("_id") % 5 != 0, F.concat(F.lit("b"), F.col("_id") % 9)), bt_rssi=(F.col("_id") % 2).cast("string"))
    e = e.withColumn("data", data)
    f = X.features_bluetooth(A.windowed(e.unionByName(e)))
    return rounded(f.select(*X.KEY, "bt_observations", "bt_unique_devices", "bt_unique_ratio"), "bt_unique_ratio")


@query(f"""{_from_payload("_id % 7 AS k, CASE WHEN _id % 4 <> 0 THEN value END AS s")} SELECT {KEY}, count(*) AS call_count, coalesce(count_if(k = 1), 0) AS call_incoming, count_if(k = 2) AS call_outgoing,
    count_if(k IN (3, 5, 6)) AS call_missed, round(sum(s), 4) AS call_total_seconds, count(s) AS call_duration_rows FROM p GROUP BY ALL""")
def features_calls(spark, sf_dir):
    e = A.events(spark, sf_dir)
    data = A.payload(call_type=(F.col("_id") % 7).cast("string"), call_duration=F.when(F.col("_id") % 4 != 0, F.col("value").cast("string")))
    f = X.features_calls(A.windowed(e.withColumn("data", data))).select(*X.KEY, "call_count", "call_incoming", "call_outgoing", "call_missed", "call_total_seconds", "call_duration_rows")
    return rounded(f, "call_total_seconds", digits=4)


_CELL = "CASE WHEN CAST(value AS BIGINT) % 5 = 0 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 5 AS VARCHAR) END"


@query(f"""{A.ALL}, p AS (SELECT *, CASE WHEN k > 0 THEN 'c' || k END AS cid, CASE WHEN k > 0 THEN 'l' || (k % 2) END AS lac FROM (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS k FROM we)),
    q AS (SELECT *, lag(cid) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id) AS b FROM p WHERE cid IS NOT NULL),
    t AS (SELECT {KEY}, coalesce(count_if(cid <> b), 0) AS gsm_cell_transitions FROM q GROUP BY ALL)
    SELECT u.*, t.gsm_cell_transitions FROM (SELECT {KEY}, CASE WHEN count(cid) > 0 THEN count(DISTINCT cid) END AS gsm_unique_cells, CASE WHEN count(cid) > 0 THEN count(DISTINCT lac) END AS gsm_unique_areas FROM p GROUP BY ALL) u LEFT JOIN t USING ({KEY})""")
def features_gsm(spark, sf_dir):
    e = A.events(spark, sf_dir)
    k = F.floor("value") % 5
    data = A.payload(cid=F.when(k > 0, F.concat(F.lit("c"), k)).otherwise(""), lac=F.when(k > 0, F.concat(F.lit("l"), k % 2)))
    return X.features_gsm(A.windowed(e.withColumn("data", data))).select(*X.KEY, "gsm_unique_cells", "gsm_unique_areas", "gsm_cell_transitions")


@query(f"""{A.ALL}, p AS (SELECT DISTINCT {KEY}, timestamp, CASE WHEN k = 0 THEN '-1' ELSE 'c' || k END AS raw, 'l' || (k % 2) AS lac, 'p' AS psc FROM (SELECT *, CAST(floor(value) AS BIGINT) % 5 AS k FROM we)),
    v AS (SELECT *, CASE WHEN raw <> '-1' THEN raw END AS cid FROM p),
    q AS (SELECT *, lag(cid) OVER (PARTITION BY {KEY} ORDER BY timestamp, raw, lac, psc) AS b FROM v WHERE cid IS NOT NULL), t AS (SELECT {KEY}, coalesce(count_if(cid <> b), 0) AS n FROM q GROUP BY ALL)
    SELECT u.*, t.n AS gsm_neighbor_cell_transitions FROM (SELECT {KEY}, CASE WHEN count(cid) > 0 THEN count(DISTINCT cid) END AS gsm_neighbor_unique_cells, CASE WHEN count(cid) > 0 THEN count(DISTINCT lac) END AS gsm_neighbor_unique_areas FROM v GROUP BY ALL) u LEFT JOIN t USING ({KEY})""")
def features_gsm_neighbor(spark, sf_dir):
    e = A.events(spark, sf_dir)
    k = F.floor("value") % 5
    data = A.payload(cid=F.when(k == 0, F.lit("-1")).otherwise(F.concat(F.lit("c"), k)), lac=F.concat(F.lit("l"), k % 2), psc=F.lit("p"), signal_strength=F.lit("1"))
    f = X.features_gsm_neighbor(A.windowed(e.withColumn("data", data)))
    return f.select(*X.KEY, "gsm_neighbor_unique_cells", "gsm_neighbor_unique_areas", "gsm_neighbor_cell_transitions")


_KEYS = f"""{A.ALL}, p AS (SELECT *, repeat('x', CAST(floor(value) AS INTEGER) % 6) || CASE WHEN _id % 4 = 0 THEN ' ' ELSE '' END AS cur, repeat('x', CAST(floor(value) AS INTEGER) % 6) || CASE WHEN _id % 7 = 0 THEN ' ' ELSE '' END AS bef FROM we),
    q AS (SELECT *, timestamp - lag(timestamp) OVER w AS gap_ms, lag(cur) OVER w AS prev FROM p WINDOW w AS (PARTITION BY {KEY}, device_id ORDER BY timestamp, device_id, _id))"""


def _typing(spark, sf_dir):
    e = A.events(spark, sf_dir)
    base = F.repeat(F.lit("x"), (F.floor("value") % 6).cast("int"))
    data = A.payload(before_text=F.concat(base, F.when(F.col("_id") % 7 == 0, " ").otherwise("")), current_text=F.concat(base, F.when(F.col("_id") % 4 == 0, " ").otherwise("")), package_name=F.lit("a"), is_password=F.lit("0"))
    return A.windowed(e.withColumn("data", data))


@query(f"""{_KEYS} SELECT {KEY}, count(*) AS key_event_count, round(quantile_cont(g, 0.5), 6) AS key_gap_median_s, round(quantile_cont(g, 0.75) - quantile_cont(g, 0.25), 6) AS key_gap_iqr_s, coalesce(count_if(gap_ms > 20000), 0) AS key_long_pauses,
    count_if(gap_ms IS NULL OR gap_ms > 40000000) AS key_bursts, count_if(coalesce(length(cur) < length(bef) OR length(cur) < length(prev), false)) AS key_deletions
    FROM (SELECT *, CASE WHEN gap_ms > 0 AND gap_ms <= 40000000 THEN gap_ms / 1000 END AS g FROM q) GROUP BY ALL""")
def features_keyboard(spark, sf_dir):
    f = X.features_keyboard(_typing(spark, sf_dir), pause_s=20, burst_s=40_000)
    f = f.select(*X.KEY, "key_event_count", "key_gap_median_s", "key_gap_iqr_s", "key_long_pauses", "key_bursts", "key_deletions")
    return rounded(f, "key_gap_median_s", "key_gap_iqr_s")


@query(f"""{_KEYS}, c AS (SELECT *, CASE WHEN coalesce(lag(cur LIKE '% ' AND bef NOT LIKE '% ') OVER w, false) OR coalesce(gap_ms > 400000000, false) THEN 1 ELSE 0 END AS cut FROM q WINDOW w AS (PARTITION BY {KEY}, device_id ORDER BY timestamp, _id)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY {KEY}, device_id ORDER BY timestamp, _id ROWS UNBOUNDED PRECEDING) AS seg FROM c),
    g AS (SELECT {KEY}, device_id, seg, max(CASE WHEN cur NOT LIKE '% ' AND trim(cur) <> '' AND bef LIKE '% ' THEN timestamp END) AS o, min(CASE WHEN cur NOT LIKE '% ' AND trim(cur) <> '' THEN timestamp END) AS st,
          max(CASE WHEN cur LIKE '% ' AND bef NOT LIKE '% ' THEN timestamp END) AS en FROM s GROUP BY ALL), d AS (SELECT {KEY}, (en - coalesce(o, st)) / 1000 AS sec FROM g)
    SELECT {KEY}, count(sec) AS key_words_completed, round(quantile_cont(sec, 0.5), 6) AS key_word_median_s FROM d GROUP BY ALL""")
def features_keyboard_words(spark, sf_dir):
    f = X.features_keyboard_words(_typing(spark, sf_dir), burst_s=400_000)
    return rounded(f.select(*X.KEY, "key_words_completed", "key_word_median_s"), "key_word_median_s")


@query(f"""{A.ALL} SELECT {KEY}, count(*) AS light_samples, round(quantile_cont(value, 0.5), 6) AS light_median_lux, round(100.0 * count_if(value < 10) / count(*), 6) AS light_dark_percent,
    round(avg(CASE WHEN {NIGHT} THEN value END), 6) AS light_night_mean_lux, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS light_iqr_lux FROM we GROUP BY ALL""")
def features_light(spark, sf_dir):
    e = A.events(spark, sf_dir)
    f = X.features_light(A.windowed(e.withColumn("data", A.payload(double_light_lux=F.col("value")))), tz=A.TZ)
    return rounded(f.select(*X.KEY, "light_samples", "light_median_lux", "light_dark_percent", "light_night_mean_lux", "light_iqr_lux"), "light_median_lux", "light_dark_percent", "light_night_mean_lux", "light_iqr_lux")


@query(f"""{A.ALL}, p AS (SELECT *, value - 60 AS lat, (_id * 37 % 300) - 150.0 AS lon FROM we), v AS (SELECT * FROM p WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180),
    l AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b FROM v WINDOW w AS (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id)),
    h AS (SELECT *, pow(sin((radians(lat) - radians(a)) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(b)) / 2), 2) AS h FROM l)
    SELECT o.*, round(s.km, 3) AS location_path_km, s.n AS location_valid_points FROM (SELECT {KEY}, count(*) AS location_observations FROM p GROUP BY ALL) o
    LEFT JOIN (SELECT {KEY}, sum(2 * 6371.0088 * atan2(sqrt(h), sqrt(greatest(1 - h, 0)))) AS km, count(*) AS n FROM h GROUP BY ALL) s USING ({KEY})""")
def features_locations(spark, sf_dir):
    e = A.events(spark, sf_dir)
    data = A.payload(double_latitude=F.col("value") - 60, double_longitude=F.col("_id") * 37 % 300 - 150.0, provider=F.lit("gps"), accuracy=F.col("_id"))
    f = X.features_locations(A.windowed(e.withColumn("data", data))).select(*X.KEY, "location_observations", "location_path_km", "location_valid_points")
    return rounded(f, "location_path_km", digits=3)


@query(f"{A.ALL} SELECT {KEY}, count(*) AS message_count, count_if(_id % 3 = 2) AS message_outgoing FROM we GROUP BY ALL")
def features_messages(spark, sf_dir):
    e = A.events(spark, sf_dir)
    e = e.withColumn("data", A.payload(trace=F.col("_id").cast("string"), message_type=(F.col("_id") % 3).cast("string")))
    return X.features_messages(A.windowed(e.unionByName(e))).select(*X.KEY, "message_count", "message_outgoing")


_ACT = "list_extract(['still', 'walking', 'unknown', 'in_vehicle'], CAST(_id % 4 + 1 AS INTEGER))"


@query(f"""{A.ALL}, p AS (SELECT *, {_ACT} AS act FROM we), c AS (SELECT {KEY}, act, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL),
    q AS (SELECT *, lag(act) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id) AS b FROM p)
    SELECT {KEY}, count(*) AS activity_events, round(count_if(act = 'still') / count(*), 6) AS activity_still_fraction, round(count_if(act = 'unknown') / count(*), 6) AS activity_unknown_fraction, count(DISTINCT {HOUR}) AS activity_active_hours,
        round(abs(any_value(h.h)), 6) AS activity_entropy, coalesce(count_if(act <> b), 0) AS activity_transitions FROM q JOIN h USING ({KEY}) GROUP BY ALL""")
def features_activity(spark, sf_dir):
    e = A.events(spark, sf_dir)
    act = F.element_at(F.array(*[F.lit(a) for a in ("still", "walking", "unknown", "in_vehicle")]), (F.col("_id") % 4 + 1).cast("int"))
    other = F.lit("other")
    items = F.to_json(F.array(F.struct(other.alias("activity"), F.lit(20).alias("confidence")), F.struct(act.alias("activity"), F.lit(70).alias("confidence"))))
    f = X.features_activity(A.windowed(e.withColumn("data", A.payload(activities=items))), A.TZ)
    f = f.select(*X.KEY, "activity_events", "activity_still_fraction", "activity_unknown_fraction", "activity_active_hours", "activity_entropy", "activity_transitions")
    return rounded(f, "activity_still_fraction", "activity_unknown_fraction", "activity_entropy")


def _screens(spark, sf_dir):
    return A.windowed(A.events(spark, sf_dir).withColumn("data", A.payload(screen_status=(F.floor("value") % 4).cast("string"))))


_STATUS = f"{A.ALL}, p AS (SELECT *, CAST(floor(value) AS BIGINT) % 4 AS st FROM we)"


@query(f"""{_STATUS}, q AS (SELECT *, lag(st) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id) AS b FROM p)
    SELECT {KEY}, count(*) AS screen_events, count_if(st = 0) AS screen_off_count, count_if(st = 1) AS screen_on_count, count_if(st = 3) AS screen_unlock_count, count(DISTINCT {HOUR}) AS screen_active_hours,
        count_if({NIGHT}) AS screen_night_events, coalesce(count_if(st <> b), 0) AS screen_transitions FROM q GROUP BY ALL""")
def features_screen(spark, sf_dir):
    f = X.features_screen(_screens(spark, sf_dir), A.TZ)
    return f.drop("rows_in_window", "json_parse_errors", "feature_status")


@query(f"""{_STATUS}, q AS (SELECT *, coalesce(sum(CASE WHEN st IN (0, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sess FROM p),
    g AS (SELECT {KEY}, sess, max(CASE WHEN st = 3 THEN timestamp END) AS s, max(CASE WHEN st IN (0, 2) THEN timestamp END) AS e FROM q GROUP BY ALL)
    SELECT {KEY}, count((e - s) / 1000) AS screen_sessions, round(quantile_cont((e - s) / 1000, 0.5), 6) AS screen_session_median_s FROM g GROUP BY ALL""")
def features_screen_sessions(spark, sf_dir):
    f = X.features_screen_sessions(_screens(spark, sf_dir)).select(*X.KEY, "screen_sessions", "screen_session_median_s")
    return rounded(f, "screen_session_median_s")


@query(f"""{A.ALL}, p AS (SELECT *, CASE _id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS en, 'n' || (_id % 3) AS net FROM we), c AS (SELECT {KEY}, net, count(*) AS n FROM p GROUP BY ALL),
    h AS (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL)
    SELECT {KEY}, count(*) AS telephony_events, round(coalesce(count_if(en), 0) / nullif(count(en), 0), 6) AS telephony_data_fraction, round(abs(any_value(h.h)), 6) AS telephony_network_entropy FROM p JOIN h USING ({KEY}) GROUP BY ALL""")
def features_telephony(spark, sf_dir):
    e = A.events(spark, sf_dir)
    said = F.element_at(F.array(*[F.lit(x) for x in ("enabled", "0", "2", "perhaps")]), (F.col("_id") % 4 + 1).cast("int"))
    f = X.features_telephony(A.windowed(e.withColumn("data", A.payload(data_enabled=said, network_type=F.concat(F.lit("n"), F.col("_id") % 3)))))
    return rounded(f.select(*X.KEY, "telephony_events", "telephony_data_fraction", "telephony_network_entropy"), "telephony_data_fraction", "telephony_network_entropy")


@query(f"""{A.ALL}, p AS (SELECT *, 'a' || (_id % 3) AS app, list_extract(['ACTION_AWARE_TOUCH_CLICKED', 'ACTION_AWARE_TOUCH_SCROLLED_UP', 'ACTION_AWARE_TOUCH_SCROLLED_DOWN'], CAST(CAST(floor(value) AS BIGINT) % 3 + 1 AS INTEGER)) AS act, _id % 11 - 2 AS f, _id % 7 AS t FROM we),
    c AS (SELECT {KEY}, app, count(*) AS n FROM p GROUP BY ALL), h AS (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL),
    d AS (SELECT *, lag(act) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id) AS b FROM p WHERE act LIKE '%SCROLLED%'), x AS (SELECT {KEY}, coalesce(count_if(act <> b), 0) AS n FROM d GROUP BY ALL)
    SELECT {KEY}, count(*) AS touch_events, count_if(act LIKE '%CLICKED') AS touch_clicks, count_if(act LIKE '%SCROLLED%') AS touch_scrolls, count(DISTINCT app) AS touch_unique_apps, count(DISTINCT {HOUR}) AS touch_active_hours,
        CAST(quantile_cont(CASE WHEN f >= 0 AND t >= 0 THEN abs(t - f) END, 0.5) AS DOUBLE) AS touch_scroll_median, round(abs(any_value(h.h)), 6) AS touch_app_entropy, any_value(x.n) AS touch_direction_changes
    FROM p JOIN h USING ({KEY}) LEFT JOIN x USING ({KEY}) GROUP BY ALL""")
def features_touch(spark, sf_dir):
    e = A.events(spark, sf_dir)
    act = F.element_at(F.array(*[F.lit(f"ACTION_AWARE_TOUCH_{x}") for x in ("CLICKED", "SCROLLED_UP", "SCROLLED_DOWN")]), (F.floor("value") % 3 + 1).cast("int"))
    data = A.payload(touch_app=F.concat(F.lit("a"), F.col("_id") % 3), touch_action=act, touch_action_text=F.col("_id").cast("string"), scroll_items=F.lit("9"), scroll_from_index=(F.col("_id") % 11 - 2).cast("string"), scroll_to_index=(F.col("_id") % 7).cast("string"))
    f = X.features_touch(A.windowed(e.withColumn("data", data)), A.TZ).drop("rows_in_window", "json_parse_errors", "feature_status")
    return rounded(f, "touch_app_entropy", "touch_scroll_median")


@query(f"""{A.ALL}, p AS (SELECT *, CASE _id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS mv FROM we), d AS (SELECT *, lag(mv) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id) AS b FROM p WHERE mv IS NOT NULL), x AS (SELECT {KEY}, coalesce(count_if(mv <> b), 0) AS n FROM d GROUP BY ALL)
    SELECT {KEY}, count(*) AS significant_events, coalesce(count_if(mv), 0) AS significant_moving, round(coalesce(count_if(mv), 0) / nullif(count(mv), 0), 6) AS significant_moving_fraction, count(DISTINCT {HOUR}) AS significant_active_hours, any_value(x.n) AS significant_transitions
    FROM p LEFT JOIN x USING ({KEY}) GROUP BY ALL""")
def features_significant(spark, sf_dir):
    e = A.events(spark, sf_dir)
    said = F.element_at(F.array(F.lit("true"), F.lit("0"), F.lit("?")), (F.col("_id") % 3 + 1).cast("int"))
    f = X.features_significant(A.windowed(e.withColumn("data", A.payload(is_moving=said))), A.TZ).drop("rows_in_window", "json_parse_errors", "feature_status")
    return rounded(f, "significant_moving_fraction")


@query(f"""{A.ALL} SELECT {KEY}, count(*) AS sensor_events, count(DISTINCT {HOUR}) AS sensor_active_hours, round(quantile_cont(value, 0.5), 6) AS sensor_median_resolution, round(quantile_cont(value * 2, 0.5), 6) AS sensor_median_range, CAST(NULL AS DOUBLE) AS sensor_median_power, 5000.0::DOUBLE AS sensor_median_min_delay FROM we GROUP BY ALL""")
def features_sensor_meta(spark, sf_dir):
    e = A.events(spark, sf_dir)
    data = A.payload(double_sensor_resolution=F.col("value"), double_sensor_maximum_range=F.col("value") * 2, double_sensor_minimum_delay=F.lit(5000))
    f = X.features_sensor_meta(A.windowed(e.withColumn("data", data)), A.TZ).drop("rows_in_window", "json_parse_errors", "feature_status")
    return rounded(f, "sensor_median_resolution", "sensor_median_range")


@query(f"""{A.ALL}, c AS (SELECT {KEY}, CAST(floor(value / 20) AS BIGINT) AS v, count(*) AS n FROM we GROUP BY ALL), h AS (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM c GROUP BY ALL)
    SELECT {KEY}, count(*) AS event_count, count(DISTINCT CAST({LOCAL} AS DATE)) AS active_days, count_if({NIGHT}) AS night_events, round(count(*) / count(DISTINCT CAST({LOCAL} AS DATE)), 6) AS events_per_active_day, round(abs(any_value(h.h)), 6) AS value_entropy FROM we JOIN h USING ({KEY}) GROUP BY ALL""")
def features_window_counts(spark, sf_dir):
    f = X.features_window_counts(A.windowed(A.events(spark, sf_dir)), A.TZ, F.floor(F.col("value") / 20))
    return rounded(f, "events_per_active_day", "value_entropy")


@query(f"""{A.ALL}, p AS (SELECT *, {_ACT} AS act FROM we) SELECT {KEY}, count(*) AS activity_events, count_if(act = 'still') AS activity_still_count, count_if(act = 'walking') AS activity_walking_count, count_if(act = 'in_vehicle') AS activity_in_vehicle_count,
    count(DISTINCT act) AS activity_diversity, count_if(value >= 50) AS activity_confident_count, round(avg(value), 6) AS activity_mean_confidence FROM p GROUP BY ALL""")
def features_activity_counts(spark, sf_dir):
    e = A.events(spark, sf_dir)
    act = F.element_at(F.array(*[F.lit(a) for a in ("still", "walking", "unknown", "in_vehicle")]), (F.col("_id") % 4 + 1).cast("int"))
    return rounded(X.features_activity_counts(A.windowed(e.withColumn("data", A.payload(activity_name=act, confidence=F.col("value"))))), "activity_mean_confidence")


@query(f"""{A.ALL}, d AS (SELECT {KEY}, device_id, count(*) AS n, count_if({NIGHT}) AS g FROM we GROUP BY ALL), c AS (SELECT {KEY}, CAST(floor(value / 20) AS BIGINT) AS v, count(*) AS n FROM we GROUP BY ALL)
    SELECT {KEY}, CAST(sum(d.n) AS BIGINT) AS n_rows, CAST(sum(g) AS BIGINT) AS night_events, count(*) AS n_devices, CASE WHEN count_if(d.n < 3) > 0 THEN 'ok_no_data' ELSE 'ok_has_data' END AS status, any_value(a.k) AS active_days, round(any_value(b.h), 6) AS value_entropy, any_value(b.u) AS value_unique FROM d
    JOIN (SELECT {KEY}, count(DISTINCT CAST({LOCAL} AS DATE)) AS k FROM we GROUP BY ALL) a USING ({KEY}) JOIN (SELECT {KEY}, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS u FROM c GROUP BY ALL) b USING ({KEY}) GROUP BY ALL""")
def roll_up_subjects(spark, sf_dir):
    from ..functions import scalars as S

    we = A.windowed(A.events(spark, sf_dir))
    d = we.groupBy(*X.KEY, "device_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(S.is_night("timestamp", A.TZ)).alias("night_events"))
    d = d.withColumn("status", F.when(F.col("n_rows") < 3, "ok_no_data").otherwise("ok_has_data"))
    counts = we.groupBy(*X.KEY, F.floor(F.col("value") / 20).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    days = we.select(*X.KEY, S.local_day("timestamp", A.TZ).alias("day")).distinct()
    return rounded(X.roll_up_subjects(d, counts, days), "value_entropy")


@query(f"""{A.ALL}, q AS (SELECT *, (timestamp - lag(timestamp) OVER (PARTITION BY {KEY} ORDER BY timestamp, device_id, _id)) / 1000 AS gap FROM we),
    s AS (SELECT {KEY}, string_agg(v || ':' || n, ';' ORDER BY v || ':' || n) AS delay_values FROM (SELECT {KEY}, CASE WHEN _id % 2 = 0 THEN '5000.0' ELSE '10000.0' END AS v, count(*) AS n FROM we GROUP BY ALL) GROUP BY ALL),
    a AS (SELECT {KEY}, count(*) AS n_rows, round((max(timestamp) - min(timestamp)) / 3600000, 3) AS span_hours, count(DISTINCT CAST({LOCAL} AS DATE)) AS active_days, count(DISTINCT {HOUR}) AS active_hours, round(quantile_cont(gap, 0.5), 6) AS gap_median_s,
        round(quantile_cont(gap, 0.95), 6) AS gap_p95_s, round(max(gap), 6) AS gap_max_s, coalesce(count_if(gap > 300), 0) AS gaps_over_5min, coalesce(count_if(gap > 3600), 0) AS gaps_over_1h, 1000000.0::DOUBLE / min(CASE WHEN _id % 2 = 0 THEN 5000 ELSE 10000 END) AS implied_max_hz FROM q GROUP BY ALL)
    SELECT *, CASE WHEN active_hours >= 20 THEN 'ready' WHEN active_hours >= 6 THEN 'partial' ELSE 'sparse' END AS readiness FROM a JOIN s USING ({KEY})""")
def stream_qc(spark, sf_dir):
    e = A.events(spark, sf_dir)
    f = X.stream_qc(A.windowed(e.withColumn("data", A.payload(double_sensor_minimum_delay=F.when(F.col("_id") % 2 == 0, 5000).otherwise(10000)))), A.TZ)
    return rounded(rounded(f, "gap_median_s", "gap_p95_s", "gap_max_s"), "span_hours", digits=3)


@query(f"""{A.ALL}, p AS (SELECT *, CASE WHEN value * 10 BETWEEN 300 AND 1100 THEN value * 10 END AS pr FROM we)
    SELECT {KEY}, count(pr) AS pressure_rows, count_if(pr IS NULL) AS pressure_outliers, round(max(pr) - min(pr), 6) AS pressure_range, round(CASE WHEN count(pr) = 1 THEN 0 ELSE stddev_samp(pr) END, 6) AS pressure_sd FROM p GROUP BY ALL""")
def barometer_simple(spark, sf_dir):
    e = A.events(spark, sf_dir)
    f = G.barometer_simple(A.windowed(e.withColumn("data", A.payload(double_values_0=F.col("value") * 10))))
    return rounded(f, "pressure_range", "pressure_sd")


# ----------------------------------------------------------------------------------------------------- signals


@query(f"WITH {A.SIGNAL} SELECT device_id, timestamp, x, y, z, min(_id) AS _id, 2 * count(*) - 1 AS duplicates FROM sig GROUP BY ALL")
def dedupe_signal(spark, sf_dir):
    s = A.signal(spark, sf_dir).drop("subject_id")
    return G.dedupe_signal(s.unionByName(s))


_WEEK = 7 * 24 * 60
#: Samples that one task puts in order, about, so that its memory doesn't follow the table.
_TASK_ROWS = 1_000_000
_CHUNKS = f"""WITH {A.SIGNAL}, w AS (SELECT device_id, min(timestamp) // {DAY} * {DAY} AS start_ms FROM sig GROUP BY 1), c AS (SELECT s.*, sqrt(x * x + y * y + z * z) AS m, (timestamp - start_ms) // {7 * DAY} AS chunk_index, start_ms FROM sig s JOIN w USING (device_id)),
    g0 AS (SELECT *, (timestamp - lag(timestamp) OVER (PARTITION BY device_id, chunk_index ORDER BY timestamp, _id)) / 1000 AS gap0 FROM c), g AS (SELECT *, CASE WHEN gap0 > 0 THEN gap0 END AS gap FROM g0), b AS (SELECT device_id, chunk_index, quantile_cont(m, 0.5) AS base FROM c GROUP BY ALL),
    d AS (SELECT g.*, base, abs(m - base) AS dyn FROM g JOIN b USING (device_id, chunk_index)),
    st0 AS (SELECT subject_id, device_id, CAST(chunk_index AS INTEGER) AS chunk_index, min(start_ms) AS start_ms, count(*) AS sample_count, quantile_cont(gap, 0.5) AS median_interval_s, quantile_cont(gap, 0.95) AS p95_interval_s, max(gap) AS max_gap_s,
        coalesce(count_if(gap > 1), 0) AS gaps_over_1s, coalesce(sum(CASE WHEN gap > 1 THEN gap END), 0) / {60 * _WEEK} AS gap_burden, min(base) AS median_magnitude, avg(dyn) AS dynamic_mean, quantile_cont(dyn, 0.5) AS dynamic_median, stddev_pop(dyn) AS dynamic_sd, count_if(dyn >= 0.75) / count(*) AS high_motion_fraction FROM d GROUP BY ALL),
    st AS (SELECT *, CASE WHEN sample_count < 100 THEN 'too_few_samples' ELSE 'ok' END AS status, hour(make_timestamp((start_ms + chunk_index::BIGINT * {7 * DAY} + {A.SHIFT}) * 1000)) AS local_hour FROM st0)"""


def _stats(spark, sf_dir):
    """Chunks of a week, as the samples are days apart, from the midnight before a device's first sample."""
    s = A.signal(spark, sf_dir).withColumn("magnitude", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    # A row a device; no task sorts its samples for it.
    first = small(s.groupBy("device_id").agg((F.floor(F.min("timestamp") / DAY) * DAY).alias("start_ms"), F.count(F.lit(1)).alias("_n")))
    tasks = max(spark.sparkContext.defaultParallelism, -(-(first.agg(F.sum("_n")).first()[0] or 0) // _TASK_ROWS))
    chunks = G.assign_chunks(s.join(first.drop("_n"), "device_id"), _WEEK).repartition(tasks, *G.CHUNK_KEY)
    return G.chunk_stats(chunks, minutes=_WEEK, tz="GMT+02:00")


@query(f"""{_CHUNKS} SELECT subject_id, device_id, chunk_index, sample_count, round(median_interval_s, 4) AS median_interval_s, round(p95_interval_s, 4) AS p95_interval_s, round(max_gap_s, 4) AS max_gap_s, gaps_over_1s, round(median_magnitude, 6) AS median_magnitude, round(dynamic_mean, 6) AS dynamic_mean,
    round(dynamic_median, 6) AS dynamic_median, round(dynamic_sd, 6) AS dynamic_sd, round(high_motion_fraction, 6) AS high_motion_fraction, round(gap_burden, 9) AS gap_burden, status FROM st""")
def chunk_stats(spark, sf_dir):
    f = _stats(spark, sf_dir).drop("start_ms", "span_s", "chunk_start_ms", "night", "local_hour")
    f = rounded(f, "median_interval_s", "p95_interval_s", "max_gap_s", digits=4)
    f = rounded(f, "gap_burden", digits=9)
    return rounded(f, "median_magnitude", "dynamic_mean", "dynamic_median", "dynamic_sd", "high_motion_fraction")


#: Stand-ins of a spectrum, which SQL can't compute: dominant frequency and band shares from a chunk's numbers.  Line
#: items of one supplier are few a week, so their chunks count as large and as whole, and their motion as small.
_SHARES = {"very_low_lt_0_3hz": 3, "handling_0_3_1hz": 5, "walking_like_1_3hz": 7, "vigorous_2_5_4hz": 11, "shaking_like_3_8hz": 13, "high_freq_8_12hz": 17}
_MOTION = "(sample_count * 13 + chunk_index * 7) % 100"


def _banded(spark, sf_dir):
    s = _stats(spark, sf_dir)
    n = (F.col("sample_count") * 13 + F.col("chunk_index") * 7) % 100
    s = s.withColumns({f"ratio_{b}": (n * k % 50) / 100.0 for b, k in _SHARES.items()}).withColumns({f"power_{b}": F.col(f"ratio_{b}") * F.col("sample_count") for b in _SHARES})
    s = s.withColumn("dominant_hz", n / 10.0).withColumn("dynamic_median", n / 200.0).withColumn("dynamic_mean", n / 150.0).withColumn("median_interval_s", F.when(n < 50, 0.1).otherwise(0.15))
    s = s.withColumn("gap_burden", (F.col("sample_count") % 7) / 10.0).withColumn("sample_count", F.col("sample_count") * 40)
    s = s.withColumn("status", F.when(F.col("sample_count") < 100, "too_few_samples").otherwise("ok")).withColumn("local_hour", (F.col("chunk_index") % 24)).withColumn("night", (F.col("local_hour") >= 22) | (F.col("local_hour") < 6))
    return G.chunk_state(s)


_BANDED = f"""{_CHUNKS}, bn AS (SELECT subject_id, device_id, chunk_index, sample_count * 40 AS sample_count, {_MOTION} AS n, dynamic_sd, high_motion_fraction, chunk_index % 24 AS local_hour, chunk_index % 24 >= 22 OR chunk_index % 24 < 6 AS night, (sample_count % 7) / 10 AS gap_burden, {", ".join(f"({_MOTION} * {k} % 50) / 100.0 AS ratio_{b}, ({_MOTION} * {k} % 50) / 100.0 * sample_count AS power_{b}" for b, k in _SHARES.items())} FROM st),
    bs AS (SELECT *, n / 200 AS dynamic_median, n / 150 AS dynamic_mean, n / 10 AS dominant_hz, CASE WHEN n < 50 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END AS median_interval_s FROM bn),
    bt AS (SELECT *, CASE WHEN sample_count < 100 THEN 'insufficient_signal' WHEN gap_burden > 0.5 THEN 'fragmented_signal' WHEN dynamic_median <= 0.1 THEN 'still_phone_candidate' WHEN ratio_walking_like_1_3hz >= 0.35 AND dominant_hz >= 1 AND dominant_hz < 3 THEN 'walking_like_phone_motion_candidate'
        WHEN ratio_shaking_like_3_8hz >= 0.35 AND dominant_hz >= 3 AND dominant_hz < 8 THEN 'shaking_like_phone_motion_candidate' WHEN dynamic_median >= 0.2 THEN 'phone_handling_motion_candidate' ELSE 'low_motion_phone_candidate' END AS state FROM bs), ok AS (SELECT * FROM bt WHERE sample_count >= 100)"""


@query(f"{_BANDED} SELECT subject_id, state, count(*) AS chunks, CAST(count(*) * 5 AS BIGINT) AS minutes FROM bt GROUP BY ALL")
def state_summary(spark, sf_dir):
    return G.state_summary(_banded(spark, sf_dir)).withColumn("minutes", F.col("minutes").cast("long"))


@query(f"""{_BANDED}, h AS (SELECT subject_id, local_hour, count(*) AS k FROM ok WHERE dynamic_median >= 0.2 GROUP BY ALL), e AS (SELECT subject_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS v FROM h GROUP BY 1),
    m AS (SELECT subject_id, count(*) AS valid_chunks, 5 * count(*) AS valid_minutes, quantile_cont(median_interval_s, 0.5) AS median_interval_s, {", ".join(f"5 * count_if(state = '{s}') AS {n}_minutes" for n, s in (("still", "still_phone_candidate"), ("handling", "phone_handling_motion_candidate"), ("walking", "walking_like_phone_motion_candidate"), ("shaking", "shaking_like_phone_motion_candidate")))},
        count_if(state = 'still_phone_candidate') / count(*) AS stillness_fraction, avg(gap_burden) AS gap_burden, avg(dynamic_mean) AS dynamic_mean, avg(dynamic_sd) AS dynamic_sd, avg(high_motion_fraction) AS high_motion_fraction, avg(power_shaking_like_3_8hz) AS tremor_power_mean,
        5 * count_if(dynamic_median >= 0.2 AND NOT night) AS day_motion_minutes, 5 * count_if(dynamic_median >= 0.2 AND night) AS night_motion_minutes FROM ok GROUP BY 1)
    SELECT m.* REPLACE ({", ".join(f"round({c}, 6) AS {c}" for c in ("median_interval_s", "stillness_fraction", "gap_burden", "dynamic_mean", "dynamic_sd", "high_motion_fraction", "tremor_power_mean"))}), round(CASE WHEN night_motion_minutes > 0 THEN day_motion_minutes / night_motion_minutes END, 6) AS day_night_ratio, round(abs(e.v), 6) AS hourly_motion_entropy FROM m LEFT JOIN e USING (subject_id)""")
def movement_summary(spark, sf_dir):
    f = G.movement_summary(_banded(spark, sf_dir)).withColumn("hourly_motion_entropy", F.abs("hourly_motion_entropy"))
    return rounded(f, "median_interval_s", "stillness_fraction", "gap_burden", "dynamic_mean", "dynamic_sd", "high_motion_fraction", "tremor_power_mean", "day_night_ratio", "hourly_motion_entropy")


@query(f"""{_BANDED} SELECT subject_id, CAST(local_hour AS INTEGER) AS local_hour, count_if(sample_count >= 100) AS valid_chunks, round(quantile_cont(CASE WHEN sample_count >= 100 THEN dynamic_median END, 0.5), 6) AS median_dynamic, round(avg(CASE WHEN sample_count >= 100 THEN dynamic_mean END), 6) AS mean_dynamic,
    round(avg(CASE WHEN sample_count >= 100 THEN high_motion_fraction END), 6) AS mean_high_motion, 5 * count_if(sample_count >= 100 AND state = 'walking_like_phone_motion_candidate') AS walking_minutes, 5 * count_if(sample_count >= 100 AND state = 'shaking_like_phone_motion_candidate') AS shaking_minutes FROM bt GROUP BY ALL""")
def hourly_summary(spark, sf_dir):
    return rounded(G.hourly_summary(_banded(spark, sf_dir)), "median_dynamic", "mean_dynamic", "mean_high_motion")


@query(f"""{_BANDED}, t AS (SELECT CAST(unnest([0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0]) AS DOUBLE) AS threshold)
    SELECT subject_id, threshold, count_if(dynamic_median >= threshold) AS chunks_by_median, 5 * count_if(dynamic_median >= threshold) AS minutes_by_median, round(count_if(dynamic_median >= threshold) / count(*), 6) AS fraction_by_median, count_if(dynamic_mean >= threshold) AS chunks_by_mean,
        5 * count_if(dynamic_mean >= threshold) AS minutes_by_mean, round(count_if(dynamic_mean >= threshold) / count(*), 6) AS fraction_by_mean, 5 * count_if(dynamic_median >= threshold AND NOT night) AS day_minutes_by_median, 5 * count_if(dynamic_median >= threshold AND night) AS night_minutes_by_median FROM ok, t GROUP BY ALL""")
def threshold_sensitivity(spark, sf_dir):
    return rounded(G.threshold_sensitivity(_banded(spark, sf_dir)), "fraction_by_median", "fraction_by_mean")


_TOP = "greatest(" + ", ".join(f"ratio_{b}" for b in _SHARES) + ")"
_FIRST = "CASE " + " ".join(f"WHEN ratio_{b} = {_TOP} THEN '{b}'" for b in _SHARES) + " END"
_GATES = f"""{_BANDED}, bb AS ({" UNION ALL ".join(f"SELECT subject_id, local_hour, night, dynamic_mean, dynamic_median, '{b}' AS band, power_{b} AS power, ratio_{b} AS ratio, 0.5 / median_interval_s >= {high} AND 5 >= {high} AS feasible, {_FIRST} AS top FROM ok" for b, (_, high) in G.BANDS.items())}),
    bg AS (SELECT *, feasible AND dynamic_mean >= 0.2 AND top = band AND ratio >= 0.35 AS chosen FROM bb)"""


@query(f"""{_GATES} SELECT subject_id, band, count_if(feasible) AS feasible_chunks, 5 * count_if(feasible) AS feasible_minutes, round(avg(ratio), 6) AS mean_ratio, round(CAST(quantile_cont(ratio, 0.5) AS DOUBLE), 6) AS median_ratio, round(avg(power), 6) AS mean_power, count_if(chosen) AS selected_chunks, 5 * count_if(chosen) AS selected_minutes,
    5 * count_if(chosen AND NOT night) AS day_minutes, 5 * count_if(chosen AND night) AS night_minutes FROM bg GROUP BY ALL""")
def band_summary(spark, sf_dir):
    return rounded(G.band_summary(_banded(spark, sf_dir)), "mean_ratio", "median_ratio", "mean_power")


@query(f"{_GATES} SELECT subject_id, CAST(local_hour AS INTEGER) AS local_hour, band, count(*) AS valid_chunks, 5 * count(*) AS valid_minutes, round(avg(dynamic_mean), 6) AS mean_dynamic, round(quantile_cont(dynamic_median, 0.5), 6) AS median_dynamic, 5 * count_if(chosen) AS selected_minutes, round(avg(ratio), 6) AS mean_ratio FROM bg GROUP BY ALL")
def band_hourly(spark, sf_dir):
    return rounded(G.band_hourly(_banded(spark, sf_dir)), "mean_dynamic", "median_dynamic", "mean_ratio")


@query(f"""WITH {A.SIGNAL}, s AS (SELECT *, x * x + y * y + z * z AS sq, CAST({LOCAL} AS DATE) AS day FROM sig),
    d AS (SELECT device_id, day, count(*) AS n_samples, avg(sq) AS mean_power, var_pop(sq) AS var_power FROM s GROUP BY ALL)
    SELECT device_id, day, n_samples, round(mean_power, 6) AS mean_power, round(var_power, 6) AS var_power, round(ln(1 + var_power), 6) AS log_noise, CASE WHEN n_samples < 2 THEN 'too_few_samples' ELSE 'ok' END AS status FROM d""")
def daily_movement(spark, sf_dir):
    """Days by the winter offset, as in the SQL."""
    f = G.daily_movement(A.signal(spark, sf_dir), "GMT+02:00", 2).drop("span_s", "estimated_hz")
    return rounded(f, "mean_power", "var_power", "log_noise")


@query(f"""WITH {A.SIGNAL}, r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY timestamp, _id) AS row_no, timestamp - lag(timestamp) OVER (PARTITION BY device_id ORDER BY timestamp, _id) AS delta_ms FROM sig)
    SELECT device_id, CAST(row_no AS INTEGER) AS row_no, timestamp, delta_ms, round(sqrt(x * x + y * y + z * z), 6) AS magnitude FROM r WHERE row_no <= 5""")
def density_probe(spark, sf_dir):
    return rounded(G.density_probe(A.signal(spark, sf_dir), 5), "magnitude")


@query(f"""{_CHUNKS}, f AS (SELECT subject_id, min(chunk_index) AS first_chunk FROM st WHERE sample_count >= 40 GROUP BY 1), a AS (SELECT DISTINCT subject_id FROM st)
    SELECT subject_id, first_chunk, CASE WHEN coalesce(first_chunk, 12) >= 12 THEN 'missing_no_raw_rows_at_accelerometer_anchor' ELSE 'ok' END AS status FROM a LEFT JOIN f USING (subject_id)""")
def initial_empty_status(spark, sf_dir):
    """Chunks of fewer than 40 samples stand for empty ones."""
    s = _stats(spark, sf_dir)
    return G.initial_empty_status(s.withColumn("sample_count", F.when(F.col("sample_count") >= 40, F.col("sample_count")).otherwise(0)))


@query(f"""WITH {A.SIGNAL} SELECT device_id, CAST({LOCAL} AS DATE) AS day, round(avg(x * x + y * y + z * z), 6) AS signal_power, count(*) AS n_samples FROM sig GROUP BY ALL""")
def daily_signal_power(spark, sf_dir):
    return rounded(G.daily_signal_power(A.signal(spark, sf_dir), "GMT+02:00"), "signal_power")


@query()
def chunk_spectrum(spark, sf_dir):
    """Spectra of the suppliers' samples, taken as 5 Hz signals: a device's samples in order, 200 ms apart."""
    from pyspark.sql import Window

    s = A.signal(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("device_id").orderBy("timestamp", "_id")) - 1
    s = s.withColumn("timestamp", n.cast("long") * 200).withColumn("start_ms", F.lit(0).cast("long")).withColumn("magnitude", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))
    return G.chunk_spectrum(G.assign_chunks(s))


@query()
def barometer_transitions(spark, sf_dir):
    """Elevation transitions of event values as pressures, a second apart, in the order of each subject's device."""
    from pyspark.sql import Window

    e = A.events(spark, sf_dir).withColumn("data", A.payload(double_values_0=F.lit(1000.0) + F.col("value") / 5))
    n = F.row_number().over(Window.partitionBy("device_id").orderBy("timestamp", "_id"))
    we = e.withColumn("timestamp", n.cast("long") * 1000).withColumn("table_name", F.lit("barometer")).withColumn("window_rule", F.lit("all"))
    return G.transition_summary(G.barometer_signal(we))


def _dense(spark, sf_dir):
    """The suppliers' samples as 20 Hz signals: a device's samples in order, 50 ms apart."""
    from pyspark.sql import Window

    s = A.signal(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("device_id").orderBy("timestamp", "_id")) - 1
    s = s.withColumn("timestamp", n.cast("long") * 50)
    return s.withColumn("magnitude", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")))


@query()
def sliding_power_change(spark, sf_dir):
    return G.sliding_day_change(G.sliding_day_stats(G.sliding_power(_dense(spark, sf_dir))))


@query()
def daily_band_power(spark, sf_dir):
    return G.daily_band_power(_dense(spark, sf_dir), tz="UTC")

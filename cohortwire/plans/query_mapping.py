"""Queries: sources, mapping, joins, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mapping as M
from ..operators import rangejoin as R
from ..operators import windows as W
from ..sources import io as IO
from . import stand_ins as A
from .register import Register

REGISTER = query = Register()
DAY = 86_400_000


@query(f"""WITH {A.EVENTS} SELECT _id, timestamp, device_id, table_name FROM e QUALIFY timestamp >= max(timestamp) OVER (PARTITION BY device_id) - 300000""")
def last_minutes(spark, sf_dir):
    return IO.last_minutes(A.raw(A.events(spark, sf_dir))).select("_id", "timestamp", "device_id", "table_name")


@query(f"WITH {A.EVENTS} SELECT _id, timestamp, device_id, CAST(data->>'$.k' AS DOUBLE) AS k FROM e WHERE timestamp % 3 = 0 AND CAST(data->>'$.k' AS DOUBLE) BETWEEN 10 AND 80")
def json_field_filter(spark, sf_dir):
    from ..functions import scalars as S

    e = A.raw(A.events(spark, sf_dir)).filter(S.thinned("timestamp", 3))
    return e.select("_id", "timestamp", "device_id", S.json_field("data", "$.k", "double").alias("k")).filter(S.in_range("k", 10, 80))


@query(f"""WITH {A.EVENTS} SELECT _id, strftime(make_timestamp((timestamp + {A.SHIFT}) * 1000), '%Y-%m-%d %H') AS hour_bucket, CAST(make_timestamp((timestamp + {A.SHIFT}) * 1000) AS DATE) AS day,
    hour(make_timestamp((timestamp + {A.SHIFT}) * 1000)) >= 22 OR hour(make_timestamp((timestamp + {A.SHIFT}) * 1000)) < 6 AS night,
    strftime(make_timestamp((timestamp + {A.SHIFT}) * 1000), '%Y-%m-%dT%H:%M:%S.%g') || '+02:00' AS iso FROM e""")
def local_time_columns(spark, sf_dir):
    from ..functions import scalars as S

    e = A.events(spark, sf_dir)
    return e.select("_id", S.local_hour_bucket("timestamp", A.TZ).alias("hour_bucket"), S.local_day("timestamp", A.TZ).alias("day"), S.is_night("timestamp", A.TZ).alias("night"), S.local_iso("timestamp", A.TZ).alias("iso"))


def _label_map(e):
    """Each device is listed under its subject's number and, if even, also under a padded form of it."""
    no = F.floor(F.col("user_id") / 3)
    plain = e.select(no.cast("string").alias("label"), "device_id").distinct()
    padded = e.where("user_id % 2 = 0").select(F.format_string("%03d", no.cast("long")).alias("label"), "device_id").distinct()
    both = plain.unionByName(padded).distinct()
    m = both.groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("device_id")), ";").alias("device_ids"))
    return m.withColumn("row_order", F.length("label").cast("long") * 100_000_000 + F.col("label").cast("long"))


_LABELS = f"""{A.EVENTS}, lab AS (SELECT CAST(user_id // 3 AS VARCHAR) AS label, device_id FROM e UNION SELECT printf('%03d', CAST(user_id // 3 AS BIGINT)), device_id FROM e WHERE user_id % 2 = 0),
    lm AS (SELECT label, string_agg(device_id, ';' ORDER BY device_id) AS device_ids, length(label) * 100000000 + CAST(label AS BIGINT) AS row_order FROM lab GROUP BY label)"""


@query(f"WITH {A.EVENTS} SELECT subject_id AS label, string_agg(DISTINCT device_id, ';' ORDER BY device_id) AS device_ids, count(DISTINCT device_id) AS n_devices FROM e GROUP BY 1")
def label_device_map(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return M.label_device_map(e.select("device_id", A.payload(label=F.col("subject_id")).alias("data")))


@query(f"""WITH {_LABELS}, n AS (SELECT *, CASE WHEN length(label) < 3 THEN lpad(label, 3, '0') ELSE label END AS subject_id FROM lm),
    r AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY (label = subject_id) DESC, row_order DESC) = 1)
    SELECT DISTINCT subject_id, unnest(string_split(device_ids, ';')) AS device_id FROM r""")
def strict_device_map(spark, sf_dir):
    return M.strict_device_map(_label_map(A.events(spark, sf_dir)))


@query(f"""WITH {_LABELS}, x AS (SELECT label, row_order, unnest(string_split(device_ids, ';')) AS device_id FROM lm)
    SELECT device_id, CASE WHEN length(label) < 3 THEN lpad(label, 3, '0') ELSE label END AS subject_id FROM x QUALIFY row_number() OVER (PARTITION BY device_id ORDER BY row_order) = 1""")
def device_subject_lookup(spark, sf_dir):
    return M.device_subject_lookup(_label_map(A.events(spark, sf_dir)))


@query(f"""WITH {A.EVENTS}, m AS (SELECT subject_id, device_id, row_number() OVER (PARTITION BY subject_id ORDER BY device_id) AS episode, count(*) OVER (PARTITION BY subject_id) AS n_devices
        FROM (SELECT DISTINCT subject_id, device_id FROM e WHERE (user_id // 3) % 4 <> 0))
    SELECT s.subject_id, m.device_id, CAST(m.episode AS INTEGER) AS episode, coalesce(n_devices, 0) AS n_devices, CASE WHEN m.device_id IS NULL THEN 'no_label_match' ELSE 'ok' END AS status
    FROM (SELECT DISTINCT subject_id FROM e) s LEFT JOIN m USING (subject_id)""")
def subject_device_episodes(spark, sf_dir):
    e = A.events(spark, sf_dir)
    labels = e.where("floor(user_id / 3) % 4 <> 0").groupBy(F.col("subject_id").alias("label")).agg(F.array_join(F.array_sort(F.collect_set("device_id")), ";").alias("device_ids"))
    return M.subject_device_episodes(e.select("subject_id").distinct(), labels)


@query(f"{A.ALL} SELECT subject_id, device_id, table_name, window_rule, _id FROM we")
def range_join(spark, sf_dir):
    return A.windowed(A.events(spark, sf_dir)).select("subject_id", "device_id", "table_name", "window_rule", "_id")


_ANCHORS = "anc AS (SELECT s.subject_id, d.device_id, s.t1_ms, s.t2_ms FROM sub s JOIN dev d USING (subject_id))"


def _anchors(e, endpoint):
    return A.subjects(e).join(A.devices(e), "subject_id").withColumn("anchor_ms", F.col(f"{endpoint}_ms"))


@query(f"""{A.ALL}, {_ANCHORS} SELECT anc.subject_id, e.device_id, table_name, t1_ms AS anchor_ms, min(timestamp) AS found_ms FROM e JOIN anc ON e.device_id = anc.device_id AND timestamp BETWEEN t1_ms AND t1_ms + {7 * DAY} GROUP BY ALL""")
def first_event_after(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return R.first_event_after(A.raw(e), _anchors(e, "t1"), 7 * DAY)


@query(f"""{A.ALL}, {_ANCHORS} SELECT anc.subject_id, e.device_id, table_name, t2_ms AS anchor_ms, max(timestamp) AS found_ms FROM e JOIN anc ON e.device_id = anc.device_id AND timestamp >= t2_ms - {30 * DAY} AND timestamp < t2_ms GROUP BY ALL""")
def last_event_before(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return R.last_event_before(A.raw(e), _anchors(e, "t2"), 30 * DAY)


@query(f"{A.ALL} SELECT subject_id, device_id, table_name, window_rule FROM win WHERE EXISTS (SELECT 1 FROM e WHERE e.device_id = win.device_id AND e.table_name = win.table_name AND e.timestamp >= start_ms AND e.timestamp < end_ms)")
def has_rows(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return R.has_rows(A.raw(e), A.windows(e), by_table=True).select("subject_id", "device_id", "table_name", "window_rule")


@query(f"""WITH {A.COHORT} SELECT co.subject_id, co.y, a.n_orders AS orders_n_orders, b.n AS nation_n FROM co LEFT JOIN co a USING (subject_id) LEFT JOIN (SELECT subject_id, c_nationkey * 2 AS n FROM co) b USING (subject_id)""")
def merge_sheets(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return M.merge_sheets(co.select("subject_id", "y"), {"orders": co.select("subject_id", "n_orders"), "nation": co.select("subject_id", (F.col("c_nationkey") * 2).alias("n"))})


@query(f"""WITH {A.COHORT} SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, a.y, b.n_orders FROM (SELECT * FROM co WHERE y > 0) a FULL JOIN (SELECT * FROM co WHERE n_orders > 5) b ON a.subject_id = b.subject_id""")
def outer_merge_unique(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return M.outer_merge_unique(co.where("y > 0").select("subject_id", "y"), co.where("n_orders > 5").select("subject_id", "n_orders"), ["subject_id"])


@query(f"WITH {A.COHORT} SELECT a.subject_id, a.y AS y_t1, b.y AS y_t2 FROM (SELECT subject_id, y FROM co WHERE y > 0) a JOIN (SELECT subject_id, y * 2 AS y FROM co WHERE n_orders > 5) b ON a.subject_id = b.subject_id")
def pair_endpoints(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return M.pair_endpoints(co.where("y > 0").select("subject_id", "y"), co.where("n_orders > 5").select("subject_id", (F.col("y") * 2).alias("y")))


@query(f"""WITH {A.COHORT}, a AS (SELECT subject_id, y > 0 AS has_data FROM co WHERE c_nationkey < 20), b AS (SELECT subject_id, n_orders > 5 AS extracted FROM co WHERE c_nationkey > 4),
    j AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(has_data, false) AS has_data, coalesce(extracted, false) AS extracted FROM a FULL JOIN b ON a.subject_id = b.subject_id)
    SELECT *, CASE WHEN has_data THEN 'coverage_only' ELSE 'extraction_only' END AS mismatch FROM j WHERE has_data <> extracted""")
def reconcile(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return M.reconcile(co.where("c_nationkey < 20").select("subject_id", (F.col("y") > 0).alias("has_data")), co.where("c_nationkey > 4").select("subject_id", (F.col("n_orders") > 5).alias("extracted")), ["subject_id"])


# ----------------------------------------------------------------------------------------------------- windows


@query(f"""{A.ALL} SELECT subject_id, 'early' AS window_rule, t1_ms AS start_ms, t1_ms + {7 * DAY} AS end_ms FROM sub UNION ALL SELECT subject_id, 'late', t2_ms - {7 * DAY}, t2_ms FROM sub
    UNION ALL SELECT subject_id, 't1_day', t1_ms, t1_ms + {DAY} - 1 FROM sub""")
def early_late_windows(spark, sf_dir):
    return W.early_late_windows(A.subjects(A.events(spark, sf_dir)), 7, A.TZ)


_OF_SUBJECT = "es AS (SELECT e.*, sub.t1_ms, sub.t2_ms, sub.score FROM e JOIN sub USING (subject_id))"


@query(f"""{A.ALL}, {_OF_SUBJECT}, f AS (SELECT subject_id, table_name, t1_ms, bool_or(timestamp >= t1_ms + {DAY} AND timestamp < t1_ms + {2 * DAY}) AS p, min(CASE WHEN timestamp BETWEEN t1_ms AND t1_ms + {6 * DAY} THEN timestamp END) AS first_ms
        FROM es WHERE timestamp BETWEEN t1_ms AND t1_ms + {7 * DAY} GROUP BY ALL),
    g AS (SELECT s.subject_id, t.table_name, p, CASE WHEN p THEN t1_ms + {DAY} ELSE first_ms END AS start_ms FROM (SELECT DISTINCT subject_id FROM e) s CROSS JOIN (SELECT DISTINCT table_name FROM e) t LEFT JOIN f USING (subject_id, table_name))
    SELECT subject_id, table_name, CASE WHEN p THEN 't1_primary_day' WHEN start_ms IS NOT NULL THEN 't1_week_fallback' ELSE 'no_window' END AS window_rule, start_ms, start_ms + {DAY} AS end_ms FROM g""")
def t1_day_or_fallback(spark, sf_dir):
    e = A.events(spark, sf_dir)
    tables = ["click", "view", "purchase", "signup", "error"]
    return W.t1_day_or_fallback(A.raw(e), A.subjects(e), A.devices(e), 24, tables)


@query(f"""{A.ALL}, {_OF_SUBJECT}, f AS (SELECT subject_id, table_name, device_id, t1_ms, min(timestamp) AS start_ms FROM es WHERE timestamp >= t1_ms GROUP BY ALL),
    c AS (SELECT f.*, count(*) AS n_rows FROM f JOIN e USING (subject_id, table_name, device_id) WHERE timestamp >= f.start_ms AND timestamp < f.start_ms + {7 * DAY} GROUP BY ALL HAVING count(*) >= 5)
    SELECT subject_id, table_name, device_id, 'first_available' AS window_rule, start_ms, start_ms + {7 * DAY} AS end_ms, n_rows, (start_ms - t1_ms) // {DAY} AS days_after_t1
    FROM c QUALIFY row_number() OVER (PARTITION BY subject_id, table_name ORDER BY start_ms, device_id) = 1""")
def first_available_after(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return W.first_available_after(A.raw(e), A.subjects(e), A.devices(e), 7, 5)


def _t2(week_end: str, back_end: str, start: str, end: str) -> str:
    return f"""{A.ALL}, {_OF_SUBJECT}, f AS (SELECT subject_id, table_name, device_id, t2_ms, min(CASE WHEN timestamp BETWEEN t2_ms - {7 * DAY} AND {week_end} THEN timestamp END) AS first_ms,
        max(CASE WHEN timestamp BETWEEN t2_ms - {30 * DAY} AND {back_end} THEN timestamp END) AS latest_ms FROM es WHERE timestamp BETWEEN t2_ms - {30 * DAY} AND {back_end} GROUP BY ALL)
    SELECT subject_id, table_name, device_id, CASE WHEN first_ms IS NOT NULL THEN 't2_week' ELSE 't2_30d_fallback' END AS window_rule, {start} AS start_ms, {end} AS end_ms
    FROM f QUALIFY row_number() OVER (PARTITION BY subject_id, table_name ORDER BY first_ms ASC NULLS LAST, latest_ms DESC, device_id) = 1"""


@query(_t2(f"t2_ms - {DAY}", f"t2_ms - {DAY}", f"CASE WHEN first_ms IS NOT NULL THEN first_ms ELSE latest_ms - {DAY} END", f"CASE WHEN first_ms IS NOT NULL THEN first_ms + {DAY} ELSE latest_ms + 1 END"))
def t2_week_or_fallback(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return W.t2_week_or_fallback(A.raw(e), A.subjects(e), A.devices(e))


@query(_t2("t2_ms - 1", "t2_ms - 1", f"CASE WHEN first_ms IS NOT NULL THEN t2_ms - {7 * DAY} ELSE greatest(t2_ms - {30 * DAY}, latest_ms - {7 * DAY}) END", "CASE WHEN first_ms IS NOT NULL THEN t2_ms ELSE latest_ms + 1 END"))
def t2_adjusted_or_fallback(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return W.t2_week_or_fallback(A.raw(e), A.subjects(e), A.devices(e), adjusted=True)


@query(f"""{A.ALL}, {_OF_SUBJECT}, a AS (SELECT subject_id, table_name, device_id, min(timestamp) AS f FROM es WHERE timestamp BETWEEN t1_ms AND t1_ms + {10 * DAY} GROUP BY subject_id, table_name, device_id QUALIFY row_number() OVER (PARTITION BY subject_id, table_name ORDER BY f, device_id) = 1),
    b AS (SELECT subject_id, table_name, device_id, max(timestamp) AS f FROM es WHERE timestamp BETWEEN t2_ms - {30 * DAY} AND t2_ms GROUP BY subject_id, table_name, device_id QUALIFY row_number() OVER (PARTITION BY subject_id, table_name ORDER BY f DESC, device_id) = 1)
    SELECT subject_id, table_name, device_id, 't1_10d_anchored' AS window_rule, f AS start_ms, f + {10 * DAY} AS end_ms FROM a UNION ALL SELECT subject_id, table_name, device_id, 't2_10d_anchored', f - {10 * DAY}, f + 1 FROM b""")
def availability_anchored(spark, sf_dir):
    e = A.events(spark, sf_dir)
    args = A.raw(e), A.subjects(e), A.devices(e)
    return W.availability_anchored(*args, "t1").unionByName(W.availability_anchored(*args, "t2"))


@query(f"""{A.ALL} SELECT subject_id, 't1_' || d || 'd' AS window_rule, t1_ms AS start_ms, t1_ms + CAST(d AS BIGINT) * {DAY} AS end_ms FROM sub CROSS JOIN (VALUES (7), (14), (30)) v(d)
    UNION ALL SELECT subject_id, 't1_plus_1d', t1_ms, t1_ms + {DAY} FROM sub UNION ALL SELECT subject_id, 't2_minus_1d', t2_ms - {DAY}, t2_ms FROM sub""")
def fixed_windows(spark, sf_dir):
    s = A.subjects(A.events(spark, sf_dir))
    return W.fixed_windows(s).unionByName(W.day_boundary_windows(s))


@query(f"""{A.ALL}, {_OF_SUBJECT}, f AS (SELECT subject_id, score, table_name, device_id, min(timestamp) AS start_ms FROM es WHERE timestamp BETWEEN t1_ms AND t1_ms + {7 * DAY} GROUP BY ALL),
    n AS (SELECT f.*, count(*) AS n_rows FROM f JOIN es USING (subject_id, table_name, device_id) WHERE timestamp >= f.start_ms AND timestamp < f.start_ms + {DAY} AND timestamp <= t1_ms + {7 * DAY} GROUP BY ALL HAVING count(*) >= 2)
    SELECT table_name, subject_id, device_id, start_ms, start_ms + {DAY} AS end_ms, n_rows FROM n QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY score, subject_id, start_ms, device_id) = 1""")
def first_raw_candidate(spark, sf_dir):
    e = A.events(spark, sf_dir)
    ranked = A.subjects(e).withColumn("rank_no", F.struct("score", "subject_id"))
    return W.first_raw_candidate(A.raw(e), ranked, A.devices(e), min_rows=2)


@query(f"""{A.ALL}, sp AS (SELECT subject_id, device_id, t1_ms AS start_ms, t2_ms AS end_ms FROM sub JOIN dev USING (subject_id)),
    p AS (SELECT subject_id, device_id, unnest(range(0, 100)) AS probe_no, start_ms, end_ms FROM sp), w AS (SELECT subject_id, device_id, probe_no, end_ms - probe_no * {DAY} AS a FROM p WHERE end_ms - probe_no * {DAY} >= start_ms),
    h AS (SELECT DISTINCT subject_id, w.device_id, probe_no FROM w JOIN e USING (subject_id) WHERE e.device_id = w.device_id AND timestamp >= a - 3600000 AND timestamp < a + 3600000 * 5)
    SELECT t.subject_id, t.device_id, t.probes, CAST(first_hit AS INTEGER) AS first_hit, CAST(last_hit AS INTEGER) AS last_hit, coalesce(hits, 0) AS hits FROM (SELECT subject_id, device_id, count(*) AS probes FROM w GROUP BY ALL) t
    LEFT JOIN (SELECT subject_id, device_id, min(probe_no) AS first_hit, max(probe_no) AS last_hit, count(*) AS hits FROM h GROUP BY ALL) USING (subject_id, device_id)""")
def probe_hits(spark, sf_dir):
    e = A.events(spark, sf_dir)
    spans = A.subjects(e).join(A.devices(e), "subject_id").select("subject_id", "device_id", F.col("t1_ms").alias("start_ms"), F.col("t2_ms").alias("end_ms"))
    return W.probe_hits(A.raw(e), W.probe_windows(spans, DAY, 6 * W.HOUR, W.HOUR, backward=True))


@query(f"""{A.ALL}, w AS (SELECT subject_id, device_id, t1_ms AS start_ms FROM sub JOIN dev USING (subject_id)), hrs AS (SELECT *, unnest(range(0, 24)) AS hour_no FROM w),
    x AS (SELECT w.subject_id, w.device_id, w.start_ms, (timestamp - w.start_ms) // 3600000 AS hour_no, timestamp, _id FROM w JOIN e ON e.device_id = w.device_id AND timestamp >= w.start_ms AND timestamp < w.start_ms + {DAY}),
    y AS (SELECT *, row_number() OVER o AS rn, timestamp - lag(timestamp) OVER o AS gap FROM x WINDOW o AS (PARTITION BY subject_id, device_id, start_ms, hour_no ORDER BY timestamp, _id)),
    s AS (SELECT subject_id, device_id, start_ms, hour_no, count(*) AS rows_seen, quantile_cont(gap, 0.5) AS median_gap_ms FROM y WHERE rn <= 2 GROUP BY ALL)
    SELECT subject_id, device_id, start_ms, CAST(hour_no AS INTEGER) AS hour_no, coalesce(rows_seen, 0) AS rows_seen, CAST(median_gap_ms AS DOUBLE) AS median_gap_ms,
        CASE WHEN rows_seen >= 2 AND median_gap_ms > 0 THEN CAST(round(3600000 / median_gap_ms) AS BIGINT) ELSE coalesce(rows_seen, 0) END AS estimated_rows, coalesce(rows_seen, 0) > 0 AS has_rows FROM hrs LEFT JOIN s USING (subject_id, device_id, start_ms, hour_no)""")
def hourly_density(spark, sf_dir):
    e = A.events(spark, sf_dir)
    win = A.subjects(e).join(A.devices(e), "subject_id").select("subject_id", "device_id", F.col("t1_ms").alias("start_ms"), (F.col("t1_ms") + DAY).alias("end_ms"))
    return W.hourly_density(A.raw(e), win, cap=2)


@query(f"""WITH {A.LONG}, s AS (SELECT subject_id, CAST(CAST(substr(subject_id, 2) AS INTEGER) * 37 % 101 AS DOUBLE) AS score FROM (SELECT DISTINCT subject_id FROM e))
    SELECT table_name, subject_id, score FROM (SELECT DISTINCT table_name, subject_id FROM lng WHERE value IS NOT NULL) JOIN s USING (subject_id) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY score DESC, subject_id) = 1""")
def first_valid_by_rank(spark, sf_dir):
    return W.first_valid_by_rank(A.features_long(spark, sf_dir), A.subjects(A.events(spark, sf_dir)))


@query(f"""{A.ALL}, {_OF_SUBJECT}, f AS (SELECT subject_id, table_name, device_id, t1_ms, min(timestamp) AS start_ms FROM es GROUP BY ALL),
    c AS (SELECT f.*, count(*) AS n_rows FROM f JOIN e USING (subject_id, table_name, device_id) WHERE timestamp >= f.start_ms AND timestamp < f.start_ms + {7 * DAY} GROUP BY ALL HAVING count(*) >= 5)
    SELECT subject_id, table_name, device_id, 'first_available' AS window_rule, start_ms, start_ms + {7 * DAY} AS end_ms, n_rows, CAST(floor((start_ms - t1_ms) / {DAY}) AS BIGINT) AS days_after_t1
    FROM c QUALIFY row_number() OVER (PARTITION BY subject_id, table_name ORDER BY start_ms, device_id) = 1""")
def first_available_ever(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return W.first_available_after(A.raw(e), A.subjects(e), A.devices(e), 7, 5, bounded=False)


@query(f"{A.ALL} SELECT subject_id, 't1_plus_1d' AS window_rule, t1_ms AS start_ms, t1_ms + {DAY} AS end_ms FROM sub UNION ALL SELECT subject_id, 't2_minus_1d', t2_ms - {DAY}, t2_ms FROM sub")
def day_boundary_windows(spark, sf_dir):
    return W.day_boundary_windows(A.subjects(A.events(spark, sf_dir)))


@query(f"{A.ALL}, q AS (SELECT subject_id, device_id, min(CASE WHEN table_name = 'signup' AND value > 60 THEN timestamp END) AS f FROM e GROUP BY ALL) SELECT subject_id, device_id, 'metadata_anchor' AS window_rule, f AS start_ms, f + {DAY} AS end_ms FROM q WHERE f IS NOT NULL")
def metadata_anchor_windows(spark, sf_dir):
    e = A.events(spark, sf_dir)
    qc = e.groupBy("subject_id", "device_id").agg(F.min(F.when((F.col("table_name") == "signup") & (F.col("value") > 60), F.col("timestamp"))).alias("first_ms"))
    return W.metadata_anchor_windows(qc)


@query(f"{A.ALL}, {_ANCHORS} SELECT anc.subject_id, e.device_id, table_name, min(timestamp) AS start_ms, min(timestamp) + {DAY} AS end_ms FROM e JOIN anc ON e.device_id = anc.device_id AND timestamp BETWEEN t1_ms AND t1_ms + 120::BIGINT * {DAY} GROUP BY ALL")
def first_row_windows(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return W.first_row_windows(A.raw(e), A.subjects(e), A.devices(e))


_PROBES = ["raw_window_found_from_sensor_anchor_probe", "missing_no_raw_rows_at_anchor", "raw_window_found_from_sensor_daily_jump_probe"]


@query(f"""{A.ALL}, n AS (SELECT subject_id, CAST(substr(subject_id, 2) AS BIGINT) AS no FROM sub), p AS (SELECT subject_id, no, no % 3 <> 0 AS has_metadata, CASE WHEN no % 5 = 0 THEN list_extract({_PROBES}, CAST(no % 3 + 1 AS INTEGER)) END AS a,
        CASE WHEN no % 4 = 1 THEN 'missing_no_raw_rows_in_bounded_daily_probes' WHEN no % 4 = 2 THEN 'raw_window_found_from_pending_metadata_probe' END AS p, CASE WHEN no % 8 = 1 THEN 'missing_no_raw_rows_in_weekly_t1_t2_probes' WHEN no % 8 = 3 THEN 'raw_window_found_from_weekly_t1_t2_probe' END AS b, no % 7 = 0 AS missed FROM n),
    s AS (SELECT *, CASE WHEN coalesce(a LIKE 'raw_window%', false) OR coalesce(p LIKE 'raw_window%', false) OR coalesce(b LIKE 'raw_window%', false) THEN 'raw_24h_window_validated' WHEN missed THEN 'likely_no_usable_raw_accelerometer' WHEN p LIKE 'missing%' AND b LIKE 'missing%' THEN 'no_raw_rows_in_broad_weekly_t1_t2_probe' WHEN p LIKE 'missing%' THEN 'no_raw_rows_in_validated_metadata_window'
        WHEN has_metadata THEN 'sensor_metadata_window_candidate_pending_raw_validation' ELSE 'no_sensor_accelerometer_metadata_after_T1' END AS data_window_status FROM p)
    SELECT subject_id, CASE WHEN a IS NOT NULL THEN 'top10_pilot' WHEN b IS NOT NULL THEN 'broad_weekly_t1_t2_validation' WHEN p IS NOT NULL THEN 'pending_67_validation' ELSE '' END AS raw_validation_scope, coalesce(a, b, p, '') AS raw_validation_status, data_window_status,
        CASE data_window_status WHEN 'raw_24h_window_validated' THEN 'ready_for_raw_24h_feature_extraction' WHEN 'sensor_metadata_window_candidate_pending_raw_validation' THEN 'run_raw_probe_validation_before_feature_extraction' WHEN 'no_sensor_accelerometer_metadata_after_T1' THEN 'not_ready_for_raw_accelerometer_phase' ELSE 'exclude_from_raw_accelerometer_phase_or_revisit_with_broader_manual_probe' END AS next_action FROM s""")
def window_status(spark, sf_dir):
    """Validation results made from the subjects' numbers."""
    no = A.number("subject_id")
    s = A.subjects(A.events(spark, sf_dir)).select("subject_id", no.alias("no"))
    anchored = s.where("no % 5 = 0").select("subject_id", F.col("no").cast("double").alias("score"), F.element_at(F.array(*[F.lit(p) for p in _PROBES]), (F.col("no") % 3 + 1).cast("int")).alias("status"))
    pending = s.select("subject_id", F.when(F.col("no") % 4 == 1, "missing_no_raw_rows_in_bounded_daily_probes").when(F.col("no") % 4 == 2, "raw_window_found_from_pending_metadata_probe").alias("status")).where("status is not null")
    broad = s.select("subject_id", F.when(F.col("no") % 8 == 1, "missing_no_raw_rows_in_weekly_t1_t2_probes").when(F.col("no") % 8 == 3, "raw_window_found_from_weekly_t1_t2_probe").alias("status")).where("status is not null")
    weekly = s.select("subject_id", (F.col("no") % 7 != 0).alias("hit"))
    return W.window_status(s.withColumn("has_metadata", F.col("no") % 3 != 0), anchored, pending, broad, weekly)


@query(f"WITH {A.COHORT} SELECT a.subject_id, y, mean_price FROM (SELECT subject_id, y FROM co) a LEFT JOIN (SELECT subject_id, mean_price FROM co WHERE n_orders > 5) b USING (subject_id)")
def attach_features(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return M.attach_features(co.select("subject_id", "y"), co.where("n_orders > 5").select("subject_id", "mean_price"))

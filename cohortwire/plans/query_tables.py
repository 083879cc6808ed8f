"""Queries: coverage, reshaping, profiles, data quality, JSON discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coverage as C
from ..operators import discovery as D
from ..operators import profiles as P
from ..operators import quality as Q
from ..operators import reshape as L
from ..operators import presence as B
from . import stand_ins as A
from .register import Register, rounded

REGISTER = query = Register()
DAY = 86_400_000
LOCAL = f"make_timestamp((timestamp + {A.SHIFT}) * 1000)"


def _win(e):
    """Windows, of which one table's have no device and another's no times."""
    w = A.windows(e)
    w = w.withColumn("device_id", F.when(F.col("table_name") != "signup", F.col("device_id"))).withColumn("start_ms", F.when(F.col("table_name") != "error", F.col("start_ms")))
    return w.distinct()


def _cov(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return C.coverage_scan(A.raw(e), _win(e), A.TZ)


_COV = f"""{A.ALL}, ww AS (SELECT DISTINCT subject_id, CASE WHEN table_name <> 'signup' THEN device_id END AS device_id, table_name, window_rule, CASE WHEN table_name <> 'error' THEN start_ms END AS start_ms, end_ms FROM win),
    cov AS (SELECT w.subject_id, w.device_id, w.table_name, w.window_rule, w.start_ms, w.end_ms, count(e._id) AS n_rows, min(timestamp) AS first_ms, max(timestamp) AS last_ms, CASE WHEN count(e._id) > 0 THEN count(DISTINCT CAST({LOCAL} AS DATE)) END AS n_days,
        CASE WHEN w.device_id IS NULL THEN 'missing_device_id' WHEN w.start_ms IS NULL THEN 'missing_time_window' WHEN count(e._id) > 0 THEN 'ok_has_data' ELSE 'ok_no_data' END AS status
        FROM ww w LEFT JOIN e ON e.device_id = w.device_id AND e.table_name = w.table_name AND timestamp >= w.start_ms AND timestamp < w.end_ms GROUP BY 1, 2, 3, 4, 5, 6)"""


@query(f"{_COV} SELECT * FROM cov")
def coverage_scan(spark, sf_dir):
    return _cov(spark, sf_dir)


_TABLES = "count(DISTINCT CASE WHEN n_rows > 0 {} THEN table_name END)"
_BY_SUBJECT = f"""bs AS (SELECT subject_id, count(DISTINCT device_id) AS n_devices, {_TABLES.format("")} AS tables_any, {_TABLES.format("AND window_rule = 'early'")} AS tables_early, {_TABLES.format("AND window_rule = 'late'")} AS tables_late, CAST(0 AS BIGINT) AS tables_full, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM cov GROUP BY 1)"""


@query(f"{_COV}, {_BY_SUBJECT} SELECT *, CASE WHEN n_devices = 0 THEN 'no device' WHEN n_rows = 0 THEN 'no rows in any window' WHEN tables_early > 0 AND tables_late > 0 THEN 'early and late data' ELSE 'partial data' END AS note FROM bs")
def coverage_by_subject(spark, sf_dir):
    return C.coverage_by_subject(_cov(spark, sf_dir))


@query(f"{_COV} SELECT table_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(DISTINCT CASE WHEN n_rows > 0 THEN subject_id END) AS n_subjects, count(DISTINCT CASE WHEN n_rows > 0 THEN device_id END) AS n_devices, count_if(n_rows > 0) AS windows_with_data, count_if(status NOT LIKE 'ok%') AS error_count FROM cov GROUP BY 1")
def coverage_by_table(spark, sf_dir):
    return C.coverage_by_table(_cov(spark, sf_dir))


@query(f"""{_COV}, x AS (SELECT subject_id, bool_or(n_rows > 0 AND window_rule = 'early') AS has_early, bool_or(n_rows > 0 AND window_rule = 'late') AS has_late FROM cov GROUP BY 1)
    SELECT *, CASE WHEN has_early AND has_late THEN 'early_and_late_data' WHEN has_early THEN 'early_only' WHEN has_late THEN 'late_only' ELSE 'none' END AS data_group FROM x""")
def early_late_groups(spark, sf_dir):
    return C.early_late_groups(_cov(spark, sf_dir))


_ROWS = "CAST(coalesce(sum(CASE WHEN window_rule = '{0}' THEN n_rows END), 0) AS BIGINT) AS {0}_rows"
_HAS = "coalesce(bool_or(n_rows > 0 AND window_rule = '{0}'), false)"


@query(f"""{_COV}, x AS (SELECT subject_id, count(DISTINCT device_id) AS n_devices, {_ROWS.format("early")}, {_ROWS.format("late")}, {_TABLES.format("AND window_rule = 'early'")} AS early_tables_with_data, {_TABLES.format("AND window_rule = 'late'")} AS late_tables_with_data, {_HAS.format("early")} AS e, {_HAS.format("late")} AS l FROM cov GROUP BY 1)
    SELECT * EXCLUDE (e, l), e AS baseline_ready, e AND l AS change_ready, CASE WHEN e AND l THEN 'baseline_and_change' WHEN e THEN 'baseline_only' WHEN l THEN 'late_only_not_baseline' ELSE 'exclude_current_poc_no_data' END AS recommended_use FROM x""")
def subject_readiness(spark, sf_dir):
    return C.subject_readiness(_cov(spark, sf_dir))


@query(f"""{_COV}, x AS (SELECT table_name, subject_id, {_HAS.format("early")} AS e, {_HAS.format("late")} AS l, {_ROWS.format("early")}, {_ROWS.format("late")} FROM cov WHERE window_rule IN ('early', 'late') GROUP BY ALL),
    d AS (SELECT table_name, count(DISTINCT CASE WHEN n_rows > 0 AND window_rule = 'early' THEN device_id END) AS devices_early, count(DISTINCT CASE WHEN n_rows > 0 AND window_rule = 'late' THEN device_id END) AS devices_late FROM cov WHERE window_rule IN ('early', 'late') GROUP BY 1),
    t AS (SELECT table_name, CAST(sum(early_rows) AS BIGINT) AS early_rows, CAST(sum(late_rows) AS BIGINT) AS late_rows, count_if(e) AS subjects_early, count_if(l) AS subjects_late, count_if(e AND l) AS subjects_both FROM x GROUP BY 1),
    r AS (SELECT *, CASE WHEN subjects_early >= 5 AND subjects_late >= 2 THEN 'high_priority_feature_candidate' WHEN subjects_early >= 5 THEN 'baseline_only_candidate' WHEN early_rows + late_rows > 0 THEN 'limited_candidate' ELSE 'not_useful_current_poc' END AS readiness_status FROM t JOIN d USING (table_name))
    SELECT *, CASE readiness_status WHEN 'high_priority_feature_candidate' THEN 'extract baseline + early_late change features first' WHEN 'baseline_only_candidate' THEN 'extract baseline features now; postpone change features' WHEN 'limited_candidate' THEN 'keep optional; use only if clinically motivated' ELSE 'skip for current top10 poc' END AS next_action FROM r""")
def table_readiness(spark, sf_dir):
    return C.table_readiness(_cov(spark, sf_dir))


@query(f"""{_COV}, x AS (SELECT subject_id, table_name, CAST(coalesce(sum(CASE WHEN window_rule = 'early' THEN n_rows END), 0) AS BIGINT) AS early_rows, CAST(coalesce(sum(CASE WHEN window_rule = 'late' THEN n_rows END), 0) AS BIGINT) AS late_rows FROM cov GROUP BY ALL)
    SELECT *, early_rows > 0 AS early_has_data, late_rows > 0 AS late_has_data FROM x""")
def coverage_matrix(spark, sf_dir):
    return C.coverage_matrix(_cov(spark, sf_dir))


def _map(e):
    return A.devices(e).where("substring(device_id, -1) <> '7'")


_MAP = "mp AS (SELECT subject_id, device_id FROM dev WHERE right(device_id, 1) <> '7')"
_GLOBAL = f"""{A.ALL}, {_MAP}, gl AS (SELECT table_name, coalesce(mp.subject_id, 'NOT_MAPPED') AS subject_id, count(*) AS n_rows, count(DISTINCT e.device_id) AS n_devices, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM e LEFT JOIN mp USING (device_id) GROUP BY ALL)"""


@query(f"{_GLOBAL} SELECT * FROM gl")
def global_coverage(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return C.global_coverage(A.raw(e), _map(e))


@query(f"""{_GLOBAL} SELECT table_name, CAST(coalesce(sum(CASE WHEN m THEN n_devices END), 0) AS BIGINT) AS mapped_devices, count_if(m) AS mapped_subjects, CAST(coalesce(sum(CASE WHEN m THEN n_rows END), 0) AS BIGINT) AS mapped_rows,
    CAST(coalesce(sum(CASE WHEN NOT m THEN n_devices END), 0) AS BIGINT) AS unmapped_devices, CAST(coalesce(sum(CASE WHEN NOT m THEN n_rows END), 0) AS BIGINT) AS unmapped_rows FROM (SELECT *, subject_id <> 'NOT_MAPPED' AS m FROM gl) GROUP BY 1""")
def mapped_unmapped(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return C.mapped_unmapped(A.raw(e), _map(e))


@query(f"""{A.ALL}, w AS (SELECT subject_id, device_id, 't1_plus_1d' AS window_rule, t1_ms AS s, t1_ms + {DAY} AS f FROM sub JOIN dev USING (subject_id) UNION ALL SELECT subject_id, device_id, 't2_minus_1d', t2_ms - {DAY}, t2_ms FROM sub JOIN dev USING (subject_id))
    SELECT table_name, window_rule, count(DISTINCT w.subject_id) AS n_subjects, (SELECT count(*) FROM sub) AS eligible, round(100.0 * count(DISTINCT w.subject_id) / (SELECT count(*) FROM sub), 6) AS percent FROM e JOIN w ON e.device_id = w.device_id AND timestamp >= s AND timestamp < f GROUP BY ALL""")
def bounded_presence_pct(spark, sf_dir):
    from ..operators.windows import day_boundary_windows

    e = A.events(spark, sf_dir)
    s = A.subjects(e)
    return rounded(C.bounded_presence_pct(A.raw(e), day_boundary_windows(s).join(A.devices(e), "subject_id"), s), "percent")


@query(f"{_COV} SELECT table_name, count(DISTINCT CASE WHEN n_rows > 0 THEN subject_id END) AS n_subjects, count(DISTINCT subject_id) AS all_subjects, round(100.0 * count(DISTINCT CASE WHEN n_rows > 0 THEN subject_id END) / count(DISTINCT subject_id), 6) AS percent FROM cov GROUP BY 1")
def subjects_with_data(spark, sf_dir):
    return rounded(C.subjects_with_data(_cov(spark, sf_dir)), "percent")


@query(f"""{A.ALL}, r AS (SELECT device_id, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM e WHERE table_name = 'signup' GROUP BY 1)
    SELECT d.device_id, first_ms, last_ms, round((last_ms - first_ms) / {DAY}, 6) AS span_days, CASE WHEN first_ms IS NULL THEN 'no_data' ELSE 'ok' END AS status FROM (SELECT DISTINCT device_id FROM dev) d LEFT JOIN r USING (device_id)""")
def device_ranges(spark, sf_dir):
    e = A.events(spark, sf_dir)
    return rounded(C.device_ranges(A.raw(e).where("table_name = 'signup'"), A.devices(e)), "span_days")


@query(f"WITH {A.EVENTS} SELECT device_id, timestamp // {DAY} AS utc_day, count(*) AS n_rows, CAST(make_timestamp((timestamp // {DAY} * {DAY} + {A.SHIFT}) * 1000) AS DATE) AS local_date FROM e GROUP BY ALL")
def device_day_map(spark, sf_dir):
    return C.device_day_map(A.raw(A.events(spark, sf_dir)), True, A.TZ)


@query(f"""WITH {A.EVENTS}, r AS (SELECT device_id, min(timestamp) AS a, max(timestamp) AS b FROM e WHERE table_name = 'view' GROUP BY 1) SELECT DISTINCT e.device_id, CAST({LOCAL} AS DATE) AS day FROM e JOIN r USING (device_id) WHERE table_name = 'purchase' AND timestamp BETWEEN a AND b""")
def active_days_in_range(spark, sf_dir):
    e = A.events(spark, sf_dir)
    ranges = C.device_ranges(A.raw(e).where("table_name = 'view'"), A.devices(e))
    return C.active_days_in_range(A.raw(e).where("table_name = 'purchase'"), ranges, A.TZ)


@query(f"""WITH {A.EVENTS}, r AS (SELECT device_id, CAST(min({LOCAL}) AS DATE) AS a, CAST(max({LOCAL}) AS DATE) AS b FROM e WHERE table_name = 'error' GROUP BY 1) SELECT device_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM r""")
def day_list_calendar(spark, sf_dir):
    return C.day_list(A.raw(A.events(spark, sf_dir)).where("table_name = 'error'"), "calendar", A.TZ)


@query(f"""{A.ALL}, r AS (SELECT subject_id, CAST(min({LOCAL}) AS DATE) AS start_date FROM e WHERE table_name = 'signup' AND timestamp % 2 = 0 GROUP BY 1)
    SELECT subject_id, start_date, CASE WHEN start_date IS NULL THEN 'missing' WHEN start_date < t1_date THEN 'before_t1' WHEN start_date <= t2_date THEN 'between_t1_t2' ELSE 'after_t2' END AS timing, datediff('day', t1_date, start_date) AS days_from_t1, datediff('day', start_date, t2_date) AS days_to_t2 FROM sub LEFT JOIN r USING (subject_id)""")
def start_timing(spark, sf_dir):
    e = A.events(spark, sf_dir)
    r = C.device_ranges(A.raw(e).where("table_name = 'signup' and timestamp % 2 = 0"), A.devices(e)).join(A.devices(e), "device_id")
    return C.start_timing(r, A.subjects(e), A.TZ)


@query(f"WITH {A.EVENTS} SELECT table_name, count(*) AS n_rows, count(DISTINCT device_id) AS n_devices, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM e GROUP BY 1")
def table_totals(spark, sf_dir):
    return C.table_totals(A.raw(A.events(spark, sf_dir)))


@query(f"{A.ALL} SELECT count(*) AS n_subjects, min(t1_date) AS first_t1, max(t2_date) AS last_t2, datediff('day', min(t1_date), max(t2_date)) AS span_days, CAST(quantile_cont(datediff('day', t1_date, t2_date), 0.5) AS DOUBLE) AS median_days FROM sub")
def followup_summary(spark, sf_dir):
    return C.followup_summary(A.subjects(A.events(spark, sf_dir)))


# ------------------------------------------------------------------------------------------------ long and wide


NAMES = ["mean_value", "max_value", "n_events"]


@query(f"""WITH {A.LONG}, v AS (SELECT subject_id, feature || '_' || table_name AS feature, CASE WHEN feature = 'max_value' AND table_name IN ('click', 'view') AND CAST(substr(subject_id, 2) AS BIGINT) % 17 <> 0 THEN NULL ELSE value END AS value, feature AS f FROM lng), n AS (SELECT count(DISTINCT subject_id) AS all_subjects FROM v),
    c AS (SELECT feature, any_value(f) AS f, count(DISTINCT CASE WHEN value IS NOT NULL THEN subject_id END) AS n_subjects FROM v GROUP BY 1), r AS (SELECT feature, n_subjects, all_subjects, CASE f WHEN 'mean_value' THEN 'include_primary' WHEN 'n_events' THEN 'adjusted_sensitivity' ELSE '' END AS recommendation, 100.0 * n_subjects / all_subjects AS p FROM c, n)
    SELECT feature, n_subjects, all_subjects, recommendation, round(p, 6) AS percent, round(100 - p, 6) AS missing_percent, CASE WHEN p < 10 THEN 'sensitivity_only_below_10pct' WHEN recommendation = 'include_primary' THEN 'primary_eligible_10pct' ELSE 'support_eligible_10pct' END AS role FROM r""")
def feature_roles(spark, sf_dir):
    long = A.features_long(spark, sf_dir)
    rare = (F.col("feature") == "max_value") & F.col("table_name").isin("click", "view") & (A.number("subject_id") % 17 != 0)
    named = long.select("subject_id", F.concat_ws("_", "feature", "table_name").alias("name"), "feature", F.when(~rare, F.col("value")).alias("value"))
    advice = F.when(F.col("feature") == "mean_value", "include_primary").when(F.col("feature") == "n_events", "adjusted_sensitivity")
    advice = named.select(F.col("name").alias("feature"), advice.alias("recommendation")).where("recommendation is not null").distinct()
    return rounded(C.feature_roles(named.select("subject_id", F.col("name").alias("feature"), "value"), advice), "percent", "missing_percent")


@query(f"WITH {A.LONG} SELECT table_name, feature, count(value) AS calculated, count(DISTINCT CASE WHEN value IS NOT NULL THEN subject_id END) AS n_subjects, count(*) AS attempts, round(100.0 * count(value) / count(*), 6) AS percent FROM lng GROUP BY table_name, feature")
def feature_availability(spark, sf_dir):
    return rounded(C.feature_availability(A.features_long(spark, sf_dir)), "percent")


@query(f"""WITH {A.LONG}, s AS (SELECT subject_id, table_name, CASE WHEN CAST(substr(subject_id, 2) AS INTEGER) % 3 = 0 THEN 'no_window' ELSE 'ok' END AS table_status FROM (SELECT DISTINCT subject_id FROM e) CROSS JOIN (SELECT DISTINCT table_name FROM e)),
    f AS (SELECT DISTINCT table_name, feature FROM (SELECT DISTINCT table_name FROM e) CROSS JOIN (VALUES ('mean_value'), ('max_value'), ('n_events')) v(feature))
    SELECT s.subject_id, s.table_name, f.feature, l.value, CASE WHEN l.value IS NOT NULL THEN 'computed' WHEN table_status <> 'ok' THEN table_status ELSE 'feature_missing' END AS feature_status
    FROM s JOIN f USING (table_name) LEFT JOIN (SELECT * FROM lng WHERE CAST(substr(subject_id, 2) AS INTEGER) % 3 <> 0) l ON l.subject_id = s.subject_id AND l.table_name = s.table_name AND l.feature = f.feature""")
def to_long(spark, sf_dir):
    e = A.events(spark, sf_dir)
    long = A.features_long(spark, sf_dir)
    third = A.number("subject_id") % 3 == 0
    wide = long.filter(~third).groupBy("subject_id", "table_name").pivot("feature", NAMES).agg(F.first("value", ignorenulls=True))
    tables = e.select("table_name").distinct()
    status = e.select("subject_id").distinct().join(tables).withColumn("table_status", F.when(third, "no_window").otherwise("ok"))
    return L.to_long(wide, tables.withColumn("feature", F.explode(F.array(*[F.lit(n) for n in NAMES]))), status, NAMES)


_WIDE = "wd AS (SELECT subject_id, max(CASE WHEN table_name = 'click' AND feature = 'mean_value' THEN value END) AS click_mean, max(CASE WHEN table_name = 'view' AND feature = 'mean_value' THEN value END) AS view_mean, max(CASE WHEN table_name = 'click' AND feature = 'max_value' THEN value END) AS click_max, CAST(NULL AS DOUBLE) AS nothing FROM lng GROUP BY 1)"


def _wide(spark, sf_dir):
    long = A.features_long(spark, sf_dir)
    named = long.withColumn("feature", F.when((F.col("table_name") == "click") & (F.col("feature") == "mean_value"), "click_mean").when((F.col("table_name") == "view") & (F.col("feature") == "mean_value"), "view_mean").when((F.col("table_name") == "click") & (F.col("feature") == "max_value"), "click_max"))
    return L.to_wide(named, long.select("subject_id").distinct(), ["click_mean", "view_mean", "click_max", "nothing"])


@query(f"WITH {A.LONG}, {_WIDE} SELECT * FROM wd")
def to_wide(spark, sf_dir):
    return _wide(spark, sf_dir)


@query(f"""WITH {A.LONG}, {_WIDE} SELECT subject_id, click_max, view_mean, round(CASE WHEN click_max IS NOT NULL AND view_mean IS NOT NULL THEN view_mean - click_max END, 6) AS v_delta, round(CASE WHEN click_max > 0 THEN 100.0 * (view_mean - click_max) / click_max END, 6) AS v_pct_change,
    CASE WHEN click_max IS NOT NULL AND view_mean IS NOT NULL THEN 'both' WHEN click_max IS NOT NULL THEN 'early_only' WHEN view_mean IS NOT NULL THEN 'late_only' ELSE 'none' END AS v_delta_status FROM wd""")
def add_deltas(spark, sf_dir):
    out = L.add_deltas(_wide(spark, sf_dir).select("subject_id", "click_max", "view_mean"), {"v": ("click_max", "view_mean")})
    return rounded(out, "v_delta", "v_pct_change")


@query(f"""WITH {A.LONG} SELECT subject_id, table_name, feature, value, 'old' AS run FROM lng WHERE table_name <> 'click' UNION ALL SELECT subject_id, table_name, feature, value + 1, 'new' FROM lng WHERE table_name = 'click' AND value > 50""")
def replace_table(spark, sf_dir):
    long = A.features_long(spark, sf_dir)
    return L.replace_table(long.withColumn("run", F.lit("old")), long.filter("value > 50").withColumn("value", F.col("value") + 1).withColumn("run", F.lit("new")), "click")


@query(f"WITH {A.EVENTS} SELECT device_id, table_name, _id, value FROM e QUALIFY row_number() OVER (PARTITION BY device_id, table_name ORDER BY timestamp DESC, _id DESC) = 1")
def keep_last(spark, sf_dir):
    return L.keep_last(A.events(spark, sf_dir), ["device_id", "table_name"], ["timestamp", "_id"]).select("device_id", "table_name", "_id", "value")


@query(f"""WITH {A.EVENTS}, d AS (SELECT subject_id FROM e WHERE value > 60 GROUP BY 1 HAVING count(DISTINCT CASE WHEN value > 150 THEN table_name END) >= 5) SELECT subject_id FROM (SELECT DISTINCT subject_id FROM e) WHERE subject_id NOT IN (SELECT subject_id FROM d)""")
def pending_subjects(spark, sf_dir):
    e = A.events(spark, sf_dir)
    status = e.filter("value > 60").select("subject_id", "table_name", F.when(F.col("value") <= 150, "failed").alias("error"))
    return L.pending_subjects(e.select("subject_id").distinct(), status, 5)


@query(f"WITH {A.COHORT} SELECT subject_id, y, abs(y - 100 * n_orders) AS score FROM co WHERE n_orders IS NOT NULL AND y IS NOT NULL ORDER BY score DESC, subject_id LIMIT 10")
def top_absolute_change(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return L.top_n(co, F.abs(F.col("y") - 100 * F.col("n_orders")), 10).select("subject_id", "y", "score")


@query(f"WITH {A.EVENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY device_id, table_name ORDER BY timestamp, _id) AS sample_no FROM e QUALIFY sample_no <= 3) SELECT device_id, table_name, _id, CAST(sample_no AS INTEGER) AS sample_no FROM s QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY timestamp, _id) <= 50")
def sample_rows(spark, sf_dir):
    return L.sample_rows(A.raw(A.events(spark, sf_dir)), 3, ["device_id", "table_name"], 50).select("device_id", "table_name", "_id", "sample_no")


_R = "[REDACTED_SENSITIVE_FIELD]"


@query(f"""WITH {A.EVENTS} SELECT table_name, _id, timestamp, device_id, '{{"k":"' || (data->>'$.k') || '","device_name":"{_R}","email":"{_R}","message":"{_R}","phone":"{_R}","subscriber_id":"{_R}","application_name":"app","surname":"x","trace":"t"}}' AS data FROM e QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY timestamp, _id) = 1""")
def first_rows_redacted(spark, sf_dir):
    from ..functions.scalars import redact_flat

    said = {k: F.col("device_id") for k in ("device_name", "email", "message", "phone", "subscriber_id")}
    e = A.events(spark, sf_dir).withColumn("data", A.payload(k=F.get_json_object("data", "$.k"), **said, application_name=F.lit("app"), surname=F.lit("x"), trace=F.lit("t")))
    return L.first_rows(A.raw(e)).select("table_name", "_id", "timestamp", "device_id", redact_flat("data").alias("data"))


@query(f"""WITH {A.EVENTS}, b AS (SELECT table_name, device_id FROM e GROUP BY table_name, device_id QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY count(*) DESC, device_id) = 1)
    SELECT table_name, device_id, _id FROM e JOIN b USING (table_name, device_id) QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY timestamp, _id) <= 20""")
def best_device_rows(spark, sf_dir):
    return L.best_device_rows(A.raw(A.events(spark, sf_dir)), 20).select("table_name", "device_id", "_id")


@query(f"WITH {A.EVENTS} SELECT 'common' AS kind, subject_id FROM (SELECT subject_id FROM e WHERE value > 150 INTERSECT SELECT subject_id FROM e WHERE value < 1) UNION ALL SELECT 'except', subject_id FROM (SELECT DISTINCT subject_id FROM e WHERE value > 150 EXCEPT SELECT subject_id FROM e WHERE value < 1)")
def subject_sets(spark, sf_dir):
    e = A.events(spark, sf_dir)
    a, b = e.where("value > 150").select("subject_id").distinct(), e.where("value < 1")
    return L.common(a, b, ["subject_id"]).select(F.lit("common").alias("kind"), "subject_id").unionByName(L.except_subjects(a, b).select(F.lit("except").alias("kind"), "subject_id"))


@query(f"""WITH {A.LONG}, r AS (SELECT *, 0 AS o, 'first' AS source FROM lng WHERE feature <> 'max_value' AND table_name <> 'view' UNION ALL SELECT *, 1, 'second' FROM lng),
    v AS (SELECT * FROM r WHERE value IS NOT NULL), b AS (SELECT *, min(o) OVER (PARTITION BY table_name, feature) AS m FROM v) SELECT subject_id, table_name, feature, value, source FROM b WHERE o = m""")
def collect_values(spark, sf_dir):
    long = A.features_long(spark, sf_dir)
    return L.collect_values([("first", long.where("feature <> 'max_value' and table_name <> 'view'")), ("second", long)])


@query(f"""WITH {A.LONG}, {_WIDE}, b AS (SELECT subject_id, CASE WHEN click_mean > 40 THEN click_mean END AS click_mean, view_mean, click_max FROM wd WHERE subject_id > 'S00002'),
    j AS (SELECT subject_id, 'click_mean' AS feature, wd.click_mean AS a, b.click_mean AS b FROM wd JOIN b USING (subject_id) UNION ALL SELECT subject_id, 'view_mean', wd.view_mean, b.view_mean FROM wd JOIN b USING (subject_id) UNION ALL SELECT subject_id, 'click_max', wd.click_max, b.click_max FROM wd JOIN b USING (subject_id))
    SELECT feature, count(*) AS n, count_if(a IS NULL) AS missing_a, count_if(b IS NULL) AS missing_b, count_if(a IS NULL AND b IS NOT NULL) AS gained, count_if(a IS NOT NULL AND b IS NULL) AS lost, round(100.0 * count_if(a IS NULL) / count(*), 6) AS missing_pct_a, round(100.0 * count_if(b IS NULL) / count(*), 6) AS missing_pct_b FROM j GROUP BY 1""")
def compare_coverage(spark, sf_dir):
    w = _wide(spark, sf_dir)
    b = w.where("subject_id > 'S00002'").select("subject_id", F.when(F.col("click_mean") > 40, F.col("click_mean")).alias("click_mean"), "view_mean", "click_max")
    return rounded(C.compare_coverage(w, b), "missing_pct_a", "missing_pct_b")


@query(f"""WITH {A.LONG}, {_WIDE},
    b AS (SELECT subject_id, CASE WHEN click_mean > 40 THEN click_mean END AS click_mean, view_mean, click_max FROM wd WHERE subject_id > 'S00002'),
    j AS (SELECT subject_id, wd.click_mean AS a, b.click_mean AS b FROM wd JOIN b USING (subject_id)
          UNION ALL SELECT subject_id, wd.view_mean, b.view_mean FROM wd JOIN b USING (subject_id)
          UNION ALL SELECT subject_id, wd.click_max, b.click_max FROM wd JOIN b USING (subject_id))
    SELECT subject_id, count(*) AS n, count_if(a IS NULL) AS missing_a, count_if(b IS NULL) AS missing_b, count_if(a IS NULL AND b IS NOT NULL) AS gained, count_if(a IS NOT NULL AND b IS NULL) AS lost,
           round(100.0 * count_if(a IS NULL) / count(*), 6) AS missing_pct_a, round(100.0 * count_if(b IS NULL) / count(*), 6) AS missing_pct_b
    FROM j GROUP BY 1""")
def compare_coverage_by_subject(spark, sf_dir):
    w = _wide(spark, sf_dir)
    b = w.where("subject_id > 'S00002'").select("subject_id", F.when(F.col("click_mean") > 40, F.col("click_mean")).alias("click_mean"), "view_mean", "click_max")
    return rounded(C.compare_coverage(w, b, by="subject_id"), "missing_pct_a", "missing_pct_b")


@query(f"{_COV} SELECT table_name, count_if(status = 'ok_has_data') AS ok_has_data, count_if(status = 'ok_no_data') AS ok_no_data, count_if(status = 'missing_device_id') AS missing_device_id, count(*) AS attempts, round(100.0 * count_if(status = 'ok_has_data') / count(*), 6) AS first_status_pct FROM cov GROUP BY 1")
def status_counts(spark, sf_dir):
    return rounded(C.status_counts(_cov(spark, sf_dir), ["ok_has_data", "ok_no_data", "missing_device_id"]), "first_status_pct")


# ----------------------------------------------------------------------------------------------------- profiles


_RANKED = """rk AS (SELECT subject_id, feature, value, rank() OVER (PARTITION BY feature ORDER BY value DESC) AS rank_desc, 100.0 * (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2) / count(*) OVER (PARTITION BY feature) AS percentile FROM cl WHERE value IS NOT NULL),
    rc AS (SELECT *, CASE WHEN percentile <= 33.3333 THEN 'low' WHEN percentile <= 66.6667 THEN 'medium' ELSE 'high' END AS category FROM rk)"""
_CO_LONG = "cl AS (SELECT subject_id, 'n_orders' AS feature, n_orders AS value FROM co UNION ALL SELECT subject_id, 'mean_price', mean_price FROM co UNION ALL SELECT subject_id, 'y', y FROM co)"


@query(f"WITH {A.COHORT}, {_CO_LONG}, {_RANKED} SELECT subject_id, feature, value, rank_desc, round(percentile, 6) AS percentile, category FROM rc")
def rank_percentile_category(spark, sf_dir):
    return rounded(P.rank_percentile_category(A.cohort(spark, sf_dir), ["n_orders", "mean_price", "y"]), "percentile")


_AXIS = """ax AS (SELECT subject_id, avg(p) AS score FROM (SELECT subject_id, 100.0 * (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2) / count(*) OVER (PARTITION BY feature) AS p FROM cl WHERE feature <> 'y' AND subject_id IN (SELECT subject_id FROM co WHERE n_orders IS NOT NULL)) GROUP BY 1),
    ay AS (SELECT *, 100.0 * (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) / count(*) OVER () AS percentile FROM ax),
    al AS (SELECT co.subject_id, 'trade' AS axis, score, percentile, CASE WHEN percentile IS NULL THEN 'insufficient_data' WHEN percentile <= 33.3333 THEN 'low' WHEN percentile <= 66.6667 THEN 'medium' ELSE 'high' END AS level FROM co LEFT JOIN ay USING (subject_id))"""


@query(f"WITH {A.COHORT}, {_CO_LONG}, {_AXIS} SELECT axis, count_if(level = 'low') AS low, count_if(level = 'medium') AS medium, count_if(level = 'high') AS high, count_if(level = 'insufficient_data') AS insufficient_data FROM al GROUP BY 1")
def axis_level_distribution(spark, sf_dir):
    return P.level_distribution(P.axis_scores(A.cohort(spark, sf_dir), {"trade": ["n_orders", "mean_price"]}))


@query(f"WITH {A.COHORT}, {_CO_LONG}, v AS (SELECT feature, stddev_samp(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, count(value) AS n FROM cl GROUP BY 1) SELECT feature, round(sd, 4) AS sd, round(iqr, 4) AS iqr, n, rank() OVER (ORDER BY sd DESC) AS variability_rank FROM v")
def variability(spark, sf_dir):
    return rounded(P.variability(C.unpivoted(A.cohort(spark, sf_dir), ["n_orders", "mean_price", "y"])), "sd", "iqr", digits=4)


@query(f"""WITH {A.COHORT}, c AS (SELECT subject_id, CASE WHEN n_orders IS NOT NULL THEN c_nationkey / 25 END AS missing_fraction, CASE WHEN y > 0 THEN CAST(floor(y) AS BIGINT) % 10 / 10 END AS table_coverage FROM co),
    r AS (SELECT *, row_number() OVER (ORDER BY coalesce(missing_fraction, 1), coalesce(table_coverage, 0) DESC, subject_id) AS coverage_rank, count(*) OVER () AS n FROM c)
    SELECT subject_id, missing_fraction, table_coverage, coverage_rank, CASE WHEN coverage_rank <= greatest(1, ceil(n * 0.25)) THEN 'Highest coverage quartile' WHEN coverage_rank <= greatest(1, ceil(n * 0.75)) THEN 'Middle coverage' ELSE 'Lowest coverage quartile' END AS coverage_band,
        CASE WHEN coverage_rank <= 10 THEN 'top_10' WHEN coverage_rank <= 20 THEN 'top_20' WHEN coverage_rank <= 30 THEN 'top_30' ELSE 'full' END AS coverage_cohort FROM r""")
def coverage_bands(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return P.coverage_bands(co.select("subject_id", F.when(F.col("n_orders").isNotNull(), F.col("c_nationkey") / 25.0).alias("missing_fraction"), F.when(F.col("y") > 0, F.floor("y") % 10 / 10.0).alias("table_coverage")))


@query(f"""WITH {A.COHORT}, q AS (SELECT quantile_cont(mean_price, 0.25) AS a, quantile_cont(mean_price, 0.5) AS b, quantile_cont(mean_price, 0.75) AS c FROM co)
    SELECT subject_id, mean_price, CASE WHEN mean_price <= a THEN 'q1' ELSE 'q4' END AS quartile FROM co, q WHERE mean_price <= a OR mean_price > c""")
def quartile_filter(spark, sf_dir):
    return P.quartile_filter(A.cohort(spark, sf_dir).select("subject_id", "mean_price"), "mean_price", ["q1", "q4"])


@query(f"""WITH {A.COHORT} SELECT subject_id, n_orders, y, n_orders IS NOT NULL OR y > 5000 AS usable_baseline, (n_orders IS NOT NULL AND y IS NOT NULL) AS usable_change, CASE WHEN n_orders IS NOT NULL AND y IS NOT NULL THEN 'baseline_and_change' WHEN n_orders IS NOT NULL OR y > 5000 THEN 'baseline_only' ELSE 'not_usable' END AS interpretation_scope FROM co""")
def usability_flags(spark, sf_dir):
    co = A.cohort(spark, sf_dir).select("subject_id", "n_orders", "y", F.when(F.col("y") > 5000, F.col("y")).alias("rich"), F.lit(None).cast("double").alias("later"))
    return P.usability_flags(co, {"a": ("n_orders", "y"), "b": ("rich", "later")}).drop("rich", "later")


# ------------------------------------------------------------------------------------------------------ quality


def _sheet(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    coded = F.when(F.col("c_nationkey") == 3, "FP").when(F.col("c_nationkey") == 4, " di ").when(F.col("c_nationkey") == 5, "N/A").otherwise(F.col("y").cast("string"))
    return co.select("subject_id", coded.alias("score"), F.when(F.col("c_nationkey") == 3, "NA").otherwise(F.col("n_orders").cast("string")).alias("orders"))


_FLAGS = """fl AS (SELECT subject_id, 'score' AS column_name, CASE c_nationkey WHEN 3 THEN 'FP' WHEN 4 THEN 'DI' WHEN 5 THEN 'N/A' END AS code FROM co WHERE c_nationkey IN (3, 4, 5) UNION ALL SELECT subject_id, 'orders', 'NA' FROM co WHERE c_nationkey = 3)"""


@query(f"WITH {A.COHORT} SELECT subject_id, CASE WHEN c_nationkey NOT IN (3, 4, 5) THEN y END AS score, CASE WHEN c_nationkey <> 3 THEN n_orders END AS orders FROM co")
def special_codes_values(spark, sf_dir):
    return Q.split_special_codes(_sheet(spark, sf_dir), ["score", "orders"])[0]


@query(f"WITH {A.COHORT}, {_FLAGS} SELECT code, column_name, count(*) AS n, CAST(grouping(code, column_name) AS BIGINT) AS level FROM fl GROUP BY CUBE (code, column_name)")
def code_summary(spark, sf_dir):
    return Q.code_summary(Q.split_special_codes(_sheet(spark, sf_dir), ["score", "orders"])[1])


@query(f"WITH {A.COHORT}, {_FLAGS} SELECT co.subject_id, count(code) AS n_flags, coalesce(count_if(code = 'FP'), 0) AS n_fp, coalesce(count_if(code = 'DI'), 0) AS n_di FROM co LEFT JOIN fl USING (subject_id) GROUP BY 1")
def flag_counts(spark, sf_dir):
    flags = Q.split_special_codes(_sheet(spark, sf_dir), ["score", "orders"])[1]
    return Q.flag_counts(A.cohort(spark, sf_dir).select("subject_id"), flags)


@query(f"""WITH {A.COHORT} SELECT 'score' AS column_name, count(*) AS non_missing, count_if(c_nationkey NOT IN (3, 4, 5)) AS numeric, array_to_string(list_sort(list_distinct(list(CASE c_nationkey WHEN 3 THEN 'FP' WHEN 4 THEN 'DI' WHEN 5 THEN 'N/A' END))), ';') AS codes_seen FROM co
    UNION ALL SELECT 'orders', count_if(c_nationkey = 3 OR n_orders IS NOT NULL), count_if(c_nationkey <> 3 AND n_orders IS NOT NULL), CASE WHEN count_if(c_nationkey = 3) > 0 THEN 'NA' ELSE '' END FROM co""")
def data_dictionary(spark, sf_dir):
    return Q.data_dictionary(_sheet(spark, sf_dir), ["score", "orders"])


@query(f"WITH {A.COHORT}, x AS (SELECT subject_id, 'm' AS outcome, y AS t1, mean_price AS t2, round(mean_price - y, 0) AS delta FROM co) SELECT *, round(abs(delta - (t2 - t1)), 2) AS difference FROM x WHERE abs(delta - (t2 - t1)) > 0.11")
def delta_consistency(spark, sf_dir):
    co = A.cohort(spark, sf_dir).select("subject_id", F.col("y").alias("m_t1"), F.col("mean_price").alias("m_t2"), F.round(F.col("mean_price") - F.col("y"), 0).alias("m_delta"))
    return rounded(Q.delta_consistency(co), "difference", digits=2)


@query(f"WITH {A.COHORT}, {_CO_LONG} SELECT feature AS column_name, count(*) AS n, round(100.0 * count_if(value IS NULL) / count(*), 6) AS missing_pct, min(value) AS min, round(avg(value), 4) AS mean, max(value) AS max FROM cl GROUP BY 1")
def missingness_report(spark, sf_dir):
    return rounded(rounded(Q.missingness_report(A.cohort(spark, sf_dir), ["n_orders", "mean_price", "y"]), "missing_pct"), "mean", digits=4)


@query(f"WITH {A.COHORT} SELECT subject_id, round(100.0 * (CAST(n_orders IS NOT NULL AS INTEGER) + CAST(mean_price IS NOT NULL AS INTEGER) + CAST(y IS NOT NULL AS INTEGER)) / 3, 6) AS complete_pct FROM co")
def row_completeness(spark, sf_dir):
    return rounded(Q.row_completeness(A.cohort(spark, sf_dir), ["n_orders", "mean_price", "y"]), "complete_pct")


_TIMES = f"""tm AS (SELECT subject_id, CASE WHEN score > 10 THEN t1_ms END AS T1_start_ms, CASE WHEN score > 80 THEN t1_ms ELSE t1_ms + {DAY} END AS T1_end_ms, CASE WHEN score > 90 THEN t1_ms ELSE t2_ms END AS T2_start_ms, CASE WHEN score > 95 THEN t2_ms + {4000 * DAY} ELSE t2_ms + {DAY} END AS T2_end_ms,
    t1_ms AS early_window_start_ms, t1_ms + {7 * DAY} AS early_window_end_ms, CASE WHEN score > 70 THEN t1_ms + {7 * DAY} WHEN score > 50 THEN t1_ms - {20 * DAY} ELSE t2_ms - {7 * DAY} END AS late_window_start_ms, CASE WHEN score > 50 AND score <= 60 THEN t1_ms - {DAY} ELSE t2_ms END AS late_window_end_ms FROM sub)"""
_TIME_NAMES = ["T1_start_ms", "T1_end_ms", "T2_start_ms", "T2_end_ms", "early_window_start_ms", "early_window_end_ms", "late_window_start_ms", "late_window_end_ms"]
_TIME_RULES = (
    {f"missing:{n}": f"{n} IS NULL" for n in _TIME_NAMES}
    | {f"invalid_ms_range:{n}": f"{n} < 1704067200000 OR {n} > 1830211199000" for n in _TIME_NAMES}
    | {"T1_start_not_before_T1_end": "NOT (T1_start_ms < T1_end_ms)", "T2_start_not_before_T2_end": "NOT (T2_start_ms < T2_end_ms)", "T2_before_or_equal_T1": "NOT (T1_start_ms < T2_start_ms)"}
    | {"early_window_start_not_before_end": "NOT (early_window_start_ms < early_window_end_ms)", "late_window_start_not_before_end": "NOT (late_window_start_ms < late_window_end_ms)"}
    | {"early_late_window_overlap": "early_window_start_ms <= late_window_end_ms AND late_window_start_ms <= early_window_end_ms"}
)


@query(f"{A.ALL}, {_TIMES} " + " UNION ALL ".join(f"SELECT subject_id, '{name}' AS issue FROM tm WHERE {rule}" for name, rule in _TIME_RULES.items()))
def window_issues(spark, sf_dir):
    c, t1, t2 = F.col("score"), F.col("t1_ms"), F.col("t2_ms")
    x = A.subjects(A.events(spark, sf_dir)).select(
        "subject_id", F.when(c > 10, t1).alias("T1_start_ms"), F.when(c > 80, t1).otherwise(t1 + DAY).alias("T1_end_ms"), F.when(c > 90, t1).otherwise(t2).alias("T2_start_ms"), F.when(c > 95, t2 + 4000 * DAY).otherwise(t2 + DAY).alias("T2_end_ms"),
        t1.alias("early_window_start_ms"), (t1 + 7 * DAY).alias("early_window_end_ms"), F.when(c > 70, t1 + 7 * DAY).when(c > 50, t1 - 20 * DAY).otherwise(t2 - 7 * DAY).alias("late_window_start_ms"), F.when((c > 50) & (c <= 60), t1 - DAY).otherwise(t2).alias("late_window_end_ms"),
    )
    return Q.window_issues(x)


@query(f"WITH {A.LONG} SELECT feature, count(value) AS n, min(value) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, max(value) AS max, count_if(value = 0) AS zeros, count_if(value < 0) AS negatives FROM lng GROUP BY 1")
def numeric_summary(spark, sf_dir):
    return rounded(Q.numeric_summary(A.features_long(spark, sf_dir)), "median", "mean")


@query(f"WITH {A.EVENTS} SELECT device_id, table_name, CAST(floor(value) AS BIGINT) AS v, count(*) AS n FROM e GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return Q.duplicate_keys(A.events(spark, sf_dir).withColumn("v", F.floor("value")), ["device_id", "table_name", "v"])


@query(f"""WITH {A.COHORT} SELECT subject_id, n_orders, y, CAST(n_orders IS NULL AS INTEGER) AS missing__n_orders, CAST(y IS NULL AS INTEGER) AS missing__y, CAST(n_orders IS NOT NULL AS INTEGER) + CAST(y IS NOT NULL AS INTEGER) AS observed_features,
    round(1 - (CAST(n_orders IS NOT NULL AS INTEGER) + CAST(y IS NOT NULL AS INTEGER)) / 2, 6) AS missing_fraction, CAST(y > 0 AS INTEGER)::DOUBLE AS coverage_primary, CAST(c_nationkey > 9 AS INTEGER)::DOUBLE AS coverage_adjusted FROM co""")
def model_dataset(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    status = co.select("subject_id", F.lit("primary").alias("window_class"), (F.col("y") > 0).alias("has_data")).unionByName(co.select("subject_id", F.lit("adjusted").alias("window_class"), (F.col("c_nationkey") > 9).alias("has_data")))
    return rounded(Q.model_dataset(co, status, ["n_orders", "y"]), "missing_fraction")


@query(f"""WITH {A.COHORT}, r AS (SELECT 'n_orders' AS feature, round(100.0 * count_if(n_orders IS NULL) / count(*), 1) AS m FROM co UNION ALL SELECT 'rare', round(100.0 * count_if(NOT (y > 8000)) / count(*), 1) FROM co UNION ALL SELECT 'rare_adjusted', round(100.0 * count_if(NOT (y > 8000)) / count(*), 1) FROM co UNION ALL SELECT 'nothing', 100.0)
    SELECT feature, m AS missing_pct, CASE WHEN m >= 100 THEN 'exclude_no_observed_data' WHEN feature = 'rare_adjusted' THEN 'adjusted_sensitivity' WHEN m > 50 THEN 'coverage_sensitivity' ELSE 'include_primary' END AS recommendation FROM r""")
def recommend_features(spark, sf_dir):
    rare = F.when(F.col("y") > 8000, F.col("y"))
    co = A.cohort(spark, sf_dir).select("subject_id", "n_orders", rare.alias("rare"), rare.alias("rare_adjusted"), F.lit(None).cast("double").alias("nothing"))
    return Q.recommend_features(co, ["n_orders", "rare", "rare_adjusted", "nothing"], ["rare_adjusted", "nothing"])


# ---------------------------------------------------------------------------------------------------- discovery


@query(f"""WITH {A.EVENTS}, n AS (SELECT table_name, count(*) AS rows_read FROM e GROUP BY 1), k AS (SELECT table_name, 'k' AS key, count(*) AS n_rows, 0 AS n_null, 0 AS n_boolean, count(*) AS n_integer, 0 AS n_number, 0 AS n_string FROM e GROUP BY 1
        UNION ALL SELECT table_name, 'note', count(*), count_if(_id % 2 = 0), 0, 0, 0, count_if(_id % 2 = 1) FROM e GROUP BY 1 UNION ALL SELECT table_name, 'value', count(*), 0, 0, count_if(value = floor(value)), count_if(value <> floor(value)), 0 FROM e GROUP BY 1)
    SELECT table_name, key, n_rows, CAST(n_null AS BIGINT) AS n_null, CAST(n_boolean AS BIGINT) AS n_boolean, n_integer, CAST(n_number AS BIGINT) AS n_number, CAST(n_string AS BIGINT) AS n_string, CAST(0 AS BIGINT) AS n_array, CAST(0 AS BIGINT) AS n_object, rows_read, 100.0::DOUBLE AS percent FROM k JOIN n USING (table_name)""")
def json_key_inventory(spark, sf_dir):
    whole = F.col("value") == F.floor("value")
    number = F.when(whole, F.floor("value").cast("string")).otherwise(F.col("value").cast("string"))
    data = F.concat(F.lit('{"k":'), F.get_json_object("data", "$.k"), F.lit(',"note":'), F.when(F.col("_id") % 2 == 0, "null").otherwise('"5"'), F.lit(',"value":'), number, F.lit("}"))
    return D.json_key_inventory(A.raw(A.events(spark, sf_dir).withColumn("data", data)))


@query(f"""WITH {A.EVENTS}, d AS (SELECT DISTINCT table_name, CAST(CAST(data->>'$.k' AS INTEGER) AS VARCHAR) AS v FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY v) AS i FROM d)
    SELECT table_name, 'k' AS key, string_agg(v, '|' ORDER BY v) FILTER (WHERE i <= 5) AS examples, 'number' AS key_type, 'privacy_safe_aggregate' AS privacy_status, 'unknown' AS family FROM r GROUP BY 1""")
def key_examples(spark, sf_dir):
    return D.key_families(D.privacy_status(D.key_examples(A.raw(A.events(spark, sf_dir)), 5)))


@query(f"""SELECT 'c' AS table_name, conv_id * 1000 + turn AS _id, turn AS timestamp, CAST(conv_id AS VARCHAR) AS device_id, role, CASE WHEN text IS NOT NULL THEN '[REDACTED_SENSITIVE_FIELD]' END AS text FROM conversations""")
def flatten_json(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    ev = c.select(F.lit("c").alias("table_name"), (F.col("conv_id") * 1000 + F.col("turn")).alias("_id"), F.col("turn").alias("timestamp"), F.col("conv_id").cast("string").alias("device_id"), A.payload(role=F.col("role"), text=F.col("text")).alias("data"))
    return D.flatten_json(ev, ["role", "text"])


#: Event types as sensor tables, so that each rule of the catalogue meets one.
_AS_TABLE = {"click": "screen", "view": "light", "purchase": "calls", "signup": "accelerometer", "error": "sensor_light"}


def _as_table(column):
    return F.element_at(F.create_map(*[F.lit(x) for pair in _AS_TABLE.items() for x in pair]), column)


_NAMED = "CASE table_name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _AS_TABLE.items()) + " END"


@query(f"""{_COV}, c AS (SELECT {_NAMED} AS table_name, CAST(sum(n_rows) AS BIGINT) AS n_rows, count_if(n_rows > 0) AS windows_with_data FROM cov GROUP BY 1), k AS (SELECT table_name, true AS has_device_ts FROM c UNION ALL SELECT * FROM (VALUES ('aware_log', true), ('wifi', true), ('keyboard', false), ('plugin_x', true), ('barometer', true)) v(table_name, has_device_ts)),
    t AS (SELECT table_name, has_device_ts, coalesce(n_rows, 0) AS n_rows, coalesce(windows_with_data, 0) AS windows_with_data FROM k LEFT JOIN c USING (table_name)),
    r AS (SELECT * FROM (VALUES ('screen', 'include_now', 'already validated Phase 1 behavioral family', 'low_to_medium', 'high', 'phone_engagement_sleep_circadian', 'low'), ('light', 'include_now', 'contextual passive sensing candidate', 'medium', 'medium', 'ambient_context', 'low'),
        ('calls', 'include_with_caution', 'potential contextual or communication metadata', 'medium', 'medium_to_low', 'communication_metadata', 'high'), ('accelerometer', 'phase2_later', 'raw high-frequency motion signal', 'high', 'requires separate signal-processing design', 'high_frequency_motion', 'low'),
        ('sensor_light', 'exclude', 'operational ingestion metadata, not subject phenotype', 'avoid', 'low', 'operational', 'low'), ('aware_log', 'data_quality_only', 'logging or device metadata support', 'low', 'supportive only', 'data_quality', 'low'),
        ('wifi', 'phase2_later', 'potential contextual or communication metadata', 'medium', 'medium_to_low; no top10 early/late coverage observed', 'connectivity_context', 'high'), ('keyboard', 'exclude', 'missing device_id/timestamp window keys', 'not_scanned', 'not usable for current top10 windows', 'unknown', 'low'),
        ('plugin_x', 'exclude', 'unclassified table requiring manual review', 'unknown', 'unknown', 'unclassified', 'low'), ('barometer', 'phase2_later', 'contextual passive sensing candidate', 'medium', 'medium; no top10 early/late coverage observed', 'environment_context', 'low')) v(table_name, decision, behavioral_relevance, query_risk, interpretability, family, privacy_risk))
    SELECT * FROM t JOIN r USING (table_name)""")
def table_decisions(spark, sf_dir):
    """Every event type as a sensor table; tables without events are named beside them."""
    cov = _cov(spark, sf_dir).withColumn("table_name", _as_table(F.col("table_name")))
    more = spark.createDataFrame([("aware_log", True), ("wifi", True), ("keyboard", False), ("plugin_x", True), ("barometer", True)], "table_name string, has_device_ts boolean")
    return D.table_decisions(cov, cov.select("table_name").distinct().withColumn("has_device_ts", F.lit(True)).unionByName(more))


@query(f"""WITH {A.EVENTS} SELECT table_name, n_rows, category, operational, high_frequency, use_for_now FROM (SELECT {_NAMED} AS table_name, count(*) AS n_rows FROM e GROUP BY 1) JOIN
    (VALUES ('screen', 'phone_usage', false, false, 'yes'), ('light', 'environment', false, false, 'yes'), ('calls', 'phone_usage', false, false, 'yes'), ('accelerometer', 'motion', false, true, 'later'), ('sensor_light', 'operational', true, false, 'ignore')) v(table_name, category, operational, high_frequency, use_for_now) USING (table_name)""")
def table_class(spark, sf_dir):
    e = A.events(spark, sf_dir).groupBy(_as_table(F.col("table_name")).alias("table_name")).agg(F.count(F.lit(1)).alias("n_rows"))
    return D.table_class(e)


_KEY_NAMES = ["battery_level", "cid", "speed", "call_duration", "activity_name", "screen_status", "device_name", "k"]


@query(f"""WITH {A.EVENTS}, k AS (SELECT {_NAMED} AS table_name, list_extract({_KEY_NAMES}, CAST(_id % 8 + 1 AS INTEGER)) AS key, count(*) AS n FROM e GROUP BY ALL)
    SELECT table_name, key, n, CASE WHEN table_name = 'calls' AND key = 'cid' THEN 'high_sensitive_do_not_use_raw' WHEN table_name = 'calls' THEN 'privacy_sensitive_aggregate_only' WHEN key = 'cid' THEN 'sensitive_do_not_save_raw' ELSE 'privacy_safe_aggregate' END AS privacy_status,
        CASE key WHEN 'battery_level' THEN 'phone_use_state' WHEN 'speed' THEN 'mobility' WHEN 'call_duration' THEN 'social_behavior' WHEN 'activity_name' THEN 'activity_pattern' WHEN 'screen_status' THEN 'sleep_circadian' ELSE 'unknown' END AS family FROM k""")
def key_privacy_and_family(spark, sf_dir):
    key = F.element_at(F.array(*[F.lit(k) for k in _KEY_NAMES]), (F.col("_id") % 8 + 1).cast("int"))
    keys = A.events(spark, sf_dir).groupBy(_as_table(F.col("table_name")).alias("table_name"), key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return D.key_families(D.privacy_status(keys))


@query(f"WITH {A.LONG}, {_WIDE} SELECT subject_id, CAST(click_mean IS NOT NULL AS INTEGER) AS click_mean, CAST(view_mean IS NOT NULL AS INTEGER) AS view_mean, CAST(click_max IS NOT NULL AS INTEGER) AS click_max, 0 AS nothing FROM wd")
def presence_matrix(spark, sf_dir):
    return C.presence_matrix(_wide(spark, sf_dir))


@query(f"WITH {A.COHORT} SELECT subject_id, CASE WHEN n_orders > 5 THEN y / 2 END AS half, y AS whole FROM co WHERE y IS NOT NULL")
def predictions_wide(spark, sf_dir):
    co = A.cohort(spark, sf_dir).where("y is not null")
    half = co.where("n_orders > 5").select("subject_id", F.lit("half").alias("model"), (F.col("y") / 2).alias("prediction"))
    return P.predictions_wide(half.unionByName(co.select("subject_id", F.lit("whole").alias("model"), F.col("y").alias("prediction"))), ["half", "whole"])


@query(f"WITH {A.COHORT} SELECT 'clean' AS part, subject_id, y FROM co WHERE y > 0 AND c_nationkey <> 3 UNION ALL SELECT 'unlabelled', NULL, y FROM co WHERE y > 0 AND c_nationkey = 3")
def drop_artifacts(spark, sf_dir):
    """A sheet with an empty column, rows without values and rows without an id."""
    co = A.cohort(spark, sf_dir)
    sheet = co.select(F.when(F.col("c_nationkey") != 3, F.col("subject_id")).alias("subject_id"), F.when(F.col("y") > 0, F.col("y")).alias("y"), F.lit(None).cast("string").alias("empty"))
    clean, loose = Q.drop_artifacts(sheet)
    return clean.select(F.lit("clean").alias("part"), "subject_id", "y").unionByName(loose.select(F.lit("unlabelled").alias("part"), "subject_id", "y"))


@query(f"""{_COV}, x0 AS (SELECT subject_id, table_name, window_rule, CAST(sum(n_rows) AS BIGINT) AS s, CAST(max(n_days) AS BIGINT) AS d FROM cov GROUP BY ALL), x AS (SELECT *, s - CASE WHEN table_name = 'error' THEN 1 ELSE 0 END AS n_rows, d + CASE WHEN table_name = 'view' THEN 4 ELSE 0 END AS active_days, CASE WHEN s > 4 THEN 'ok_has_data' ELSE 'ok_no_data' END AS status FROM x0)
    SELECT subject_id, table_name, window_rule, 'n_rows_negative' AS issue FROM x WHERE n_rows < 0 UNION ALL SELECT subject_id, table_name, window_rule, 'too_many_active_days' FROM x WHERE active_days > 7 UNION ALL SELECT subject_id, table_name, window_rule, 'status_mismatch' FROM x WHERE (status = 'ok_no_data' AND n_rows > 0) OR (status = 'ok_has_data' AND n_rows = 0)
    UNION ALL SELECT subject_id, table_name, window_rule, 'delta_without_both_windows' FROM x WHERE table_name = 'click' UNION ALL SELECT subject_id, table_name, window_rule, 'infinite_percent' FROM x WHERE n_rows = 0""")
def feature_issues(spark, sf_dir):
    """Coverage rows with some faults put in."""
    total = F.sum("n_rows")
    x = _cov(spark, sf_dir).groupBy("subject_id", "table_name", "window_rule").agg((total - F.when(F.col("table_name") == "error", 1).otherwise(0)).alias("n_rows"), (F.max("n_days") + F.when(F.col("table_name") == "view", 4).otherwise(0)).alias("active_days"), F.when(total > 4, "ok_has_data").otherwise("ok_no_data").alias("status"))
    none = F.lit(None).cast("double")
    x = x.withColumn("delta_value", F.when(F.col("table_name") == "click", 1.0)).withColumn("early_value", none).withColumn("late_value", none).withColumn("pct_change", F.when(F.col("n_rows") == 0, F.lit(float("inf"))))
    return Q.feature_issues(x, ["n_rows"])


@query(f"WITH {A.COHORT}, {_CO_LONG}, {_AXIS} SELECT subject_id, axis, round(score, 6) AS score, round(percentile, 6) AS percentile, level FROM al")
def axis_scores(spark, sf_dir):
    return rounded(P.axis_scores(A.cohort(spark, sf_dir), {"trade": ["n_orders", "mean_price"]}), "score", "percentile")


_EXTRACTED = f"""{A.ALL}, ew AS (SELECT * FROM win WHERE window_rule = 'early' AND table_name IN ('view', 'click') AND NOT (table_name = 'click' AND CAST(substr(subject_id, 2) AS BIGINT) % 6 = 0)), x AS (SELECT ew.subject_id, ew.table_name, e.value, e._id FROM e JOIN ew ON e.device_id = ew.device_id AND e.table_name = ew.table_name AND timestamp >= start_ms AND timestamp < end_ms),
    lf AS (SELECT subject_id, quantile_cont(value, 0.5) AS m, count(*) AS n FROM x WHERE table_name = 'view' AND subject_id NOT LIKE '%3' GROUP BY 1), sf AS (SELECT subject_id, count(*) AS n FROM x WHERE table_name = 'click' GROUP BY 1), g AS (SELECT s.subject_id, t.table_name, t.feature FROM sub s, (VALUES ('view', 'light_median_lux'), ('view', 'light_samples'), ('view', 'light_night_mean_lux'), ('click', 'event_count')) t(table_name, feature)),
    st AS (SELECT DISTINCT g.subject_id, g.table_name, CASE WHEN g.table_name = 'view' AND lf.n IS NOT NULL OR g.table_name = 'click' AND sf.n IS NOT NULL THEN 'calculated' WHEN ew.subject_id IS NULL THEN 'no_window' WHEN xx.subject_id IS NOT NULL THEN 'no_valid_rows' ELSE 'no_rows_in_window' END AS table_status
        FROM g LEFT JOIN lf USING (subject_id) LEFT JOIN sf USING (subject_id) LEFT JOIN (SELECT DISTINCT subject_id, table_name FROM ew) ew ON ew.subject_id = g.subject_id AND ew.table_name = g.table_name LEFT JOIN (SELECT DISTINCT subject_id, table_name FROM x) xx ON xx.subject_id = g.subject_id AND xx.table_name = g.table_name),
    lg AS (SELECT g.*, table_status, CASE g.feature WHEN 'light_median_lux' THEN lf.m WHEN 'light_samples' THEN lf.n WHEN 'event_count' THEN sf.n END AS value FROM g JOIN st USING (subject_id, table_name) LEFT JOIN lf ON lf.subject_id = g.subject_id LEFT JOIN sf ON sf.subject_id = g.subject_id)"""


def _extracted(spark, sf_dir):
    """Light and event counts of the early window; some subjects have no window for clicks, some no readable light, and the
    light of nights is left out."""
    from ..operators import extract as E
    from ..operators import features as X

    e = A.events(spark, sf_dir)
    win = A.windows(e).filter((F.col("window_rule") == "early") & ~((F.col("table_name") == "click") & (A.number("subject_id") % 6 == 0)))
    bad = F.col("subject_id").endswith("3")
    ev = A.raw(e.withColumn("data", F.when(~bad, A.payload(double_light_lux=F.col("value"))).otherwise("{bad")))
    day = lambda we: X.features_light(we, tz=A.TZ).withColumn("light_night_mean_lux", F.lit(None).cast("double"))
    jobs = {"view": E.Job(day, ["light_median_lux", "light_samples", "light_night_mean_lux"]), "click": E.Job(lambda we: X.features_window_counts(we, A.TZ), ["event_count"])}
    return E.extract(ev, win, A.subjects(e), jobs)


@query(f"{_EXTRACTED} SELECT subject_id, table_name, feature, round(value, 6) AS value, table_status, CASE WHEN value IS NOT NULL THEN 'calculated' WHEN table_status = 'calculated' THEN 'feature_missing' ELSE table_status END AS feature_status FROM lg")
def extract_long(spark, sf_dir):
    return rounded(_extracted(spark, sf_dir).long, "value")


@query(f"""{_EXTRACTED} SELECT subject_id, round(max(CASE WHEN feature = 'light_median_lux' THEN value END), 6) AS view__light_median_lux, max(CASE WHEN feature = 'light_samples' THEN value END) AS view__light_samples, max(CASE WHEN feature = 'light_night_mean_lux' THEN value END) AS view__light_night_mean_lux, max(CASE WHEN feature = 'event_count' THEN value END) AS click__event_count FROM lg GROUP BY 1""")
def extract_wide(spark, sf_dir):
    return rounded(_extracted(spark, sf_dir).wide, "view__light_median_lux")


@query(f"""{_EXTRACTED} SELECT table_name, count_if(table_status = 'calculated') AS calculated, count_if(table_status = 'no_valid_rows') AS no_valid_rows, count_if(table_status = 'no_rows_in_window') AS no_rows_in_window, count_if(table_status = 'no_window') AS no_window, count(*) AS attempts, round(100.0 * count_if(table_status = 'calculated') / count(*), 6) AS first_status_pct FROM st GROUP BY 1""")
def extract_coverage(spark, sf_dir):
    return rounded(_extracted(spark, sf_dir).coverage, "first_status_pct")


@query(f"""WITH {A.EVENTS} SELECT DISTINCT device_id, CAST(epoch_ms(timestamp // 86400000 * 86400000) AS DATE) AS day FROM e WHERE table_name IN ('view', 'purchase')""")
def merged_day_bitmaps(spark, sf_dir):
    """Days of purchases added to those of views, as bitmaps, and read out again."""
    e = A.raw(A.events(spark, sf_dir))
    known, new = (B.day_bitmaps(e.where(F.col("table_name") == t)) for t in ("view", "purchase"))
    return B.days_of(B.merged_days(known, new))


@query(f"""WITH {A.EVENTS}, d AS (SELECT DISTINCT device_id, table_name, CAST({LOCAL} AS DATE) AS day FROM e WHERE table_name IN ('view', 'purchase')),
    w AS (SELECT device_id, day, count_if(table_name = 'view') AS a, count_if(table_name = 'purchase') AS b FROM d GROUP BY ALL)
    SELECT device_id, count_if(a > 0) AS n_a, count_if(b > 0) AS n_b, count_if(a > 0 AND b > 0) AS n_both, count_if(a > 0 AND b = 0) AS n_only_a, count_if(a = 0 AND b > 0) AS n_only_b FROM w GROUP BY 1""")
def compared_days(spark, sf_dir):
    """Local days with views and with purchases, both, and one only."""
    e = A.raw(A.events(spark, sf_dir))
    a, b = (B.day_bitmaps(e.where(F.col("table_name") == t), tz=A.TZ) for t in ("view", "purchase"))
    return B.compared_days(a, b)

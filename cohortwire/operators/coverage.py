"""Coverage and availability: what data there is, by subject, device, table and window."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rangejoin import range_join

DAY = 86_400_000
WINDOW_KEY = ["subject_id", "device_id", "table_name", "window_rule", "start_ms", "end_ms"]


def coverage_scan(ev: DataFrame, win: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Rows, first, last and distinct local days in each window; windows without rows, device or times are kept."""
    usable = win.where("device_id is not null and start_ms is not null and end_ms is not null")
    e = range_join(ev.select("device_id", "table_name", "timestamp"), usable)
    found = e.groupBy(*WINDOW_KEY).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"), F.count_distinct(S.local_day("timestamp", tz)).alias("n_days")
    )
    found = found.withColumnsRenamed({k: f"f_{k}" for k in WINDOW_KEY})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in WINDOW_KEY])
    out = win.select(*WINDOW_KEY).join(found, same, "left").drop(*[f"f_{k}" for k in WINDOW_KEY])
    status = F.when(F.col("device_id").isNull(), "missing_device_id").when(F.col("start_ms").isNull() | F.col("end_ms").isNull(), "missing_time_window").when(F.col("n_rows") > 0, "ok_has_data").otherwise("ok_no_data")
    return out.withColumn("status", status).withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def _has(rule: str | None = None):
    has = F.col("n_rows") > 0
    return has if rule is None else has & (F.col("window_rule") == rule)


def coverage_by_subject(cov: DataFrame) -> DataFrame:
    tables = lambda rule=None: F.count_distinct(F.when(_has(rule), F.col("table_name")))
    out = cov.groupBy("subject_id").agg(
        F.count_distinct("device_id").alias("n_devices"), tables().alias("tables_any"), *[tables(r).alias(f"tables_{r}") for r in ("early", "late", "full")], F.sum("n_rows").alias("n_rows")
    )
    note = F.when(F.col("n_devices") == 0, "no device").when(F.col("n_rows") == 0, "no rows in any window").when((F.col("tables_early") > 0) & (F.col("tables_late") > 0), "early and late data").otherwise("partial data")
    return out.withColumn("note", note)


def coverage_by_table(cov: DataFrame) -> DataFrame:
    return cov.groupBy("table_name").agg(
        F.sum("n_rows").alias("n_rows"), F.count_distinct(F.when(_has(), F.col("subject_id"))).alias("n_subjects"), F.count_distinct(F.when(_has(), F.col("device_id"))).alias("n_devices"),
        F.count_if(_has()).alias("windows_with_data"), F.count_if(~F.col("status").startswith("ok")).alias("error_count"),
    )


def early_late_groups(cov: DataFrame) -> DataFrame:
    early, late = F.coalesce(F.bool_or(_has("early")), F.lit(False)), F.coalesce(F.bool_or(_has("late")), F.lit(False))
    out = cov.groupBy("subject_id").agg(early.alias("has_early"), late.alias("has_late"))
    e, lt = F.col("has_early"), F.col("has_late")
    return out.withColumn("data_group", F.when(e & lt, "early_and_late_data").when(e, "early_only").when(lt, "late_only").otherwise("none"))


def _rows_in(rule: str):
    return F.coalesce(F.sum(F.when(F.col("window_rule") == rule, F.col("n_rows"))), F.lit(0))


def subject_readiness(cov: DataFrame) -> DataFrame:
    """Rows and tables with data in the early and the late window, and what the subject may be used for."""
    tables = lambda rule: F.count_distinct(F.when(_has(rule), F.col("table_name")))
    has = lambda rule: F.coalesce(F.bool_or(_has(rule)), F.lit(False))
    out = cov.groupBy("subject_id").agg(
        F.count_distinct("device_id").alias("n_devices"), *[_rows_in(r).alias(f"{r}_rows") for r in ("early", "late")], *[tables(r).alias(f"{r}_tables_with_data") for r in ("early", "late")],
        has("early").alias("baseline_ready"), (has("early") & has("late")).alias("change_ready"), has("late").alias("_late"),
    )
    use = F.when(F.col("change_ready"), "baseline_and_change").when(F.col("baseline_ready"), "baseline_only").when(F.col("_late"), "late_only_not_baseline").otherwise("exclude_current_poc_no_data")
    return out.withColumn("recommended_use", use).drop("_late")


#: Readiness of a table and what to do next.
NEXT_ACTION = {
    "high_priority_feature_candidate": "extract baseline + early_late change features first",
    "baseline_only_candidate": "extract baseline features now; postpone change features",
    "limited_candidate": "keep optional; use only if clinically motivated",
    "not_useful_current_poc": "skip for current top10 poc",
}


def table_readiness(cov: DataFrame, early: int = 5, late: int = 2) -> DataFrame:
    """Subjects, devices and rows of each table in the early and the late window, the subjects in both, its readiness
    (enough subjects in both windows, in the early one, any row, none) and the next action."""
    cov = cov.filter(F.col("window_rule").isin("early", "late"))
    flag = lambda rule: F.coalesce(F.bool_or(_has(rule)), F.lit(False))
    each = cov.groupBy("table_name", "subject_id").agg(flag("early").alias("e"), flag("late").alias("l"), *[_rows_in(r).alias(f"{r}_rows") for r in ("early", "late")])
    out = each.groupBy("table_name").agg(
        F.sum("early_rows").alias("early_rows"), F.sum("late_rows").alias("late_rows"), F.count_if("e").alias("subjects_early"), F.count_if("l").alias("subjects_late"), F.count_if(F.col("e") & F.col("l")).alias("subjects_both")
    )
    devices = cov.groupBy("table_name").agg(*[F.count_distinct(F.when(_has(r), F.col("device_id"))).alias(f"devices_{r}") for r in ("early", "late")])
    enough = F.col("subjects_early") >= early
    names = list(NEXT_ACTION)
    status = F.when(enough & (F.col("subjects_late") >= late), names[0]).when(enough, names[1]).when(F.col("early_rows") + F.col("late_rows") > 0, names[2]).otherwise(names[3])
    out = out.join(devices, "table_name").withColumn("readiness_status", status)
    action = F.element_at(F.create_map(*[F.lit(x) for pair in NEXT_ACTION.items() for x in pair]), F.col("readiness_status"))
    return out.withColumn("next_action", action)


def coverage_matrix(cov: DataFrame) -> DataFrame:
    """subject x table with rows and has_data for early and late."""
    n = lambda rule: F.coalesce(F.sum(F.when(F.col("window_rule") == rule, F.col("n_rows"))), F.lit(0))
    out = cov.groupBy("subject_id", "table_name").agg(n("early").alias("early_rows"), n("late").alias("late_rows"))
    return out.withColumn("early_has_data", F.col("early_rows") > 0).withColumn("late_has_data", F.col("late_rows") > 0)


def device_totals(ev: DataFrame) -> DataFrame:
    return ev.groupBy("table_name", "device_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def global_coverage(ev: DataFrame, device_map: DataFrame) -> DataFrame:
    """Rows, devices, first and last by table and subject: devices first, then subjects, so the map meets few rows."""
    d = device_totals(ev).join(device_map, "device_id", "left").withColumn("subject_id", F.coalesce("subject_id", F.lit("NOT_MAPPED")))
    return d.groupBy("table_name", "subject_id").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_devices"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))


def mapped_unmapped(ev: DataFrame, device_map: DataFrame) -> DataFrame:
    g = global_coverage(ev, device_map)
    mapped = F.col("subject_id") != "NOT_MAPPED"
    part = lambda c, keep: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0))
    return g.groupBy("table_name").agg(
        part("n_devices", mapped).alias("mapped_devices"), F.count_if(mapped).alias("mapped_subjects"), part("n_rows", mapped).alias("mapped_rows"),
        part("n_devices", ~mapped).alias("unmapped_devices"), part("n_rows", ~mapped).alias("unmapped_rows"),
    )


def bounded_presence_pct(ev: DataFrame, win: DataFrame, eligible: DataFrame) -> DataFrame:
    """Percent of the eligible subjects with a row in their window, by table and rule."""
    there = range_join(ev.select("device_id", "table_name", "timestamp"), win, by_table=False).select("table_name", "window_rule", "subject_id").distinct()
    total = eligible.select("subject_id").distinct().agg(F.count(F.lit(1)).alias("eligible"))
    return there.groupBy("table_name", "window_rule").agg(F.count(F.lit(1)).alias("n_subjects")).join(F.broadcast(total)).withColumn("percent", 100.0 * F.col("n_subjects") / F.col("eligible"))


def subjects_with_data(cov: DataFrame) -> DataFrame:
    out = cov.groupBy("table_name").agg(F.count_distinct(F.when(_has(), F.col("subject_id"))).alias("n_subjects"), F.count_distinct("subject_id").alias("all_subjects"))
    return out.withColumn("percent", 100.0 * F.col("n_subjects") / F.col("all_subjects"))


def device_ranges(ev: DataFrame, devices: DataFrame) -> DataFrame:
    """First, last and span in days of every known device; those without rows have status no_data."""
    r = ev.groupBy("device_id").agg(F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))
    out = devices.select("device_id").distinct().join(r, "device_id", "left")
    return out.withColumn("span_days", (F.col("last_ms") - F.col("first_ms")) / float(DAY)).withColumn("status", F.when(F.col("first_ms").isNull(), "no_data").otherwise("ok"))


def device_day_map(ev: DataFrame, with_counts: bool = True, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Days with rows: buckets of UTC days, shown as the local date of the bucket's start."""
    bucket = F.floor(F.col("timestamp") / DAY).cast("long")
    rows = ev.select("device_id", bucket.alias("utc_day"), *(["timestamp"] if with_counts else []))
    out = rows.groupBy("device_id", "utc_day").agg(F.count(F.lit(1)).alias("n_rows")) if with_counts else rows.distinct()
    return out.withColumn("local_date", S.local_day(F.col("utc_day") * DAY, tz))


def active_days_in_range(ev: DataFrame, ranges: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Distinct local days with rows between a device's known first and last moments."""
    r = ranges.where("first_ms is not null").select("device_id", "first_ms", "last_ms")
    rows = ev.select("device_id", "timestamp").join(r, "device_id").filter(F.col("timestamp").between(F.col("first_ms"), F.col("last_ms")))
    return rows.select("device_id", S.local_day("timestamp", tz).alias("day")).distinct()


def day_list(ev: DataFrame, source: str = "rows", tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Each device's days: those with rows, or with source="calendar" all between its first and last."""
    if source == "rows":
        return ev.select("device_id", S.local_day("timestamp", tz).alias("day")).distinct()
    span = ev.groupBy("device_id").agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    return span.select("device_id", F.explode(F.sequence(S.local_day("a", tz), S.local_day("b", tz))).alias("day"))


def start_timing(ranges: DataFrame, subjects: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """When each subject's data start relative to the assessments (t1_date, t2_date), and the days between."""
    r = ranges.groupBy("subject_id").agg(F.min("first_ms").alias("first_ms"))
    out = subjects.select("subject_id", "t1_date", "t2_date").join(r, "subject_id", "left").withColumn("start_date", S.local_day("first_ms", tz))
    s, t1, t2 = F.col("start_date"), F.col("t1_date"), F.col("t2_date")
    kind = F.when(s.isNull() | t1.isNull(), "missing").when(s < t1, "before_t1").when(t2.isNull(), "after_t1_no_t2").when(s <= t2, "between_t1_t2").otherwise("after_t2")
    return out.select("subject_id", "start_date", kind.alias("timing"), F.datediff(s, t1).cast("long").alias("days_from_t1"), F.datediff(t2, s).cast("long").alias("days_to_t2"))


def table_totals(ev: DataFrame, approximate: bool = False) -> DataFrame:
    n = (F.approx_count_distinct if approximate else F.count_distinct)("device_id")
    return ev.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"), n.alias("n_devices"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


def unpivoted(wide: DataFrame, columns: list[str], key: str = "subject_id", name: str = "feature", value: str = "value") -> DataFrame:
    return wide.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, name, value)


def compare_coverage(a: DataFrame, b: DataFrame, key: str = "subject_id", by: str = "feature") -> DataFrame:
    """Missing shares of two wide tables on their common subjects and features, by feature or by subject."""
    common = [c for c in a.columns if c in b.columns and c != key]
    both = unpivoted(a, common, key, value="a").join(unpivoted(b, common, key, value="b"), [key, "feature"])
    n, miss = F.count(F.lit(1)), lambda c: F.count_if(F.col(c).isNull())
    out = both.groupBy(by).agg(n.alias("n"), miss("a").alias("missing_a"), miss("b").alias("missing_b"), F.count_if(F.col("a").isNull() & F.col("b").isNotNull()).alias("gained"), F.count_if(F.col("a").isNotNull() & F.col("b").isNull()).alias("lost"))
    return out.withColumn("missing_pct_a", 100.0 * F.col("missing_a") / F.col("n")).withColumn("missing_pct_b", 100.0 * F.col("missing_b") / F.col("n"))


def status_counts(status: DataFrame, statuses: list[str], by: str = "table_name") -> DataFrame:
    """How often each status occurs by table, all attempts, and the percent of the first status."""
    out = status.groupBy(by).pivot("status", statuses).agg(F.count(F.lit(1))).fillna(0, statuses)
    total = status.groupBy(by).agg(F.count(F.lit(1)).alias("attempts"))
    return out.join(total, by).withColumn("first_status_pct", 100.0 * F.col(f"`{statuses[0]}`") / F.col("attempts"))


def feature_availability(long: DataFrame) -> DataFrame:
    out = long.groupBy("table_name", "feature").agg(F.count("value").alias("calculated"), F.count_distinct(F.when(F.col("value").isNotNull(), F.col("subject_id"))).alias("n_subjects"), F.count(F.lit(1)).alias("attempts"))
    return out.withColumn("percent", 100.0 * F.col("calculated") / F.col("attempts"))


def feature_roles(long: DataFrame, recommendations: DataFrame, threshold: float = 10) -> DataFrame:
    """Coverage of each feature in percent of all subjects of `long`, and its role by that and by its recommendation
    (feature, recommendation), which is empty where there is none."""
    subjects = long.agg(F.count_distinct("subject_id").alias("all_subjects"))
    seen = long.groupBy("feature").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("subject_id"))).alias("n_subjects"))
    out = seen.join(F.broadcast(subjects)).join(recommendations.select("feature", "recommendation"), "feature", "left").fillna("", ["recommendation"])
    out = out.withColumn("percent", 100.0 * F.col("n_subjects") / F.col("all_subjects")).withColumn("missing_percent", 100.0 - F.col("percent"))
    role = F.when(F.col("percent") < threshold, f"sensitivity_only_below_{threshold:g}pct").when(F.col("recommendation") == "include_primary", f"primary_eligible_{threshold:g}pct").otherwise(f"support_eligible_{threshold:g}pct")
    return out.withColumn("role", role)


def presence_matrix(wide: DataFrame, key: str = "subject_id") -> DataFrame:
    return wide.select(key, *[F.col(c).isNotNull().cast("int").alias(c) for c in wide.columns if c != key])


def followup_summary(subjects: DataFrame) -> DataFrame:
    """One row: first T1, last T2, days between, and the median of the subjects' days from T1 to T2."""
    return subjects.agg(
        F.count(F.lit(1)).alias("n_subjects"), F.min("t1_date").alias("first_t1"), F.max("t2_date").alias("last_t2"), F.datediff(F.max("t2_date"), F.min("t1_date")).cast("long").alias("span_days"),
        S.percentile(F.datediff("t2_date", "t1_date"), 0.5).alias("median_days"),
    )


def best_devices(ev: DataFrame) -> DataFrame:
    best = Window.partitionBy("table_name").orderBy(F.desc("n_rows"), "device_id")
    return device_totals(ev).withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("table_name", "device_id", "n_rows")

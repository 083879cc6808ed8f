"""JSON keys of event tables: inventory, examples, privacy, decisions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Tables by what is known of them.
HIGH_FREQUENCY_TABLES = ["accelerometer", "linear_accelerometer", "gyroscope", "rotation", "gravity", "magnetometer"]
DATA_QUALITY_TABLES = ["aware_log", "aware_device", "aware_studies", "significant"]
CAUTION_TABLES = ["wifi", "bluetooth", "locations", "network", "network_traffic", "gsm", "gsm_neighbor", "telephony", "calls", "messages"]
PRIVATE_TABLES = ["locations", "wifi", "bluetooth", "calls", "messages", "telephony", "gsm", "gsm_neighbor", "network", "network_traffic"]
#: Feature families of the tables to use now, and of those to use with caution.
FIRST_FAMILIES = {
    "screen": "phone_engagement_sleep_circadian", "applications_foreground": "app_use", "keyboard": "active_phone_interaction", "touch": "active_phone_interaction",
    "plugin_google_activity_recognition": "physical_activity_context",
}
SECOND_FAMILIES = {
    "battery": "phone_use_state", "battery_charges": "phone_use_state", "battery_discharges": "phone_use_state", "light": "ambient_context", "proximity": "phone_context",
    "barometer": "environment_context", "timezone": "temporal_context",
}
CAUTION_FAMILIES = {
    "calls": "communication_metadata", "messages": "communication_metadata", "telephony": "cellular_context", "gsm": "cellular_context", "gsm_neighbor": "cellular_context",
    "wifi": "connectivity_context", "bluetooth": "nearby_device_context", "locations": "mobility_context", "network": "network_context", "network_traffic": "network_context",
}
#: Parts of keys that make their values private.
PRIVATE_KEYS = [
    "text", "body", "message", "phone", "number", "address", "contact", "subscriber", "imei", "imsi", "sim", "serial", "ssid", "bssid", "mac", "latitude", "longitude", "lat", "lon",
    "location", "cell", "lac", "cid", "operator", "network_operator",
]
#: Parts of keys by the behaviour that they may tell of, the first that fits counts.
KEY_FAMILIES = {
    "mobility": ["lat", "lon", "alt", "speed", "bearing"],
    "sleep_circadian": ["screen", "interactive", "is_screen", "brightness"],
    "social_environment": ["wifi", "ssid", "bssid", "rssi", "network"],
    "phone_use_state": ["battery", "level", "charging", "voltage", "temperature"],
    "social_behavior": ["call", "message", "sms", "duration"],
    "activity_pattern": ["activity", "still", "walking", "running", "in_vehicle"],
}
#: Categories of tables; plugin tables are `system`, sensor_ tables `operational`.
CATEGORIES = {
    "location_context": ["locations", "wifi", "bluetooth", "timezone", "gsm", "gsm_neighbor", "network", "network_traffic"],
    "phone_usage": ["screen", "applications_foreground", "keyboard", "touch", "calls", "messages", "telephony"],
    "metadata": ["aware_device", "aware_log"],
    "environment": ["battery", "battery_charges", "battery_discharges", "light", "proximity", "barometer"],
}
TYPES = ["null", "boolean", "integer", "number", "string", "array", "object"]


def value_type(value: Column) -> Column:
    """JSON type of a variant."""
    kind = F.upper(F.schema_of_variant(value))
    return (
        F.when(kind.isNull() | (kind == "VOID"), "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind.startswith("BIGINT") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$"), "integer")
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("string")
    )


def sampled(ev: DataFrame, per_window: int | None, total: int | None) -> DataFrame:
    """The first rows by time of each table and window, and of each table: a sampler."""
    by_window = [c for c in ("window_rule",) if c in ev.columns]
    out = ev
    if per_window is not None:
        out = out.withColumn("_w", F.row_number().over(Window.partitionBy("table_name", *by_window).orderBy("timestamp", "_id"))).filter(F.col("_w") <= per_window).drop("_w")
    if total is not None:
        out = out.withColumn("_t", F.row_number().over(Window.partitionBy("table_name").orderBy("timestamp", "_id"))).filter(F.col("_t") <= total).drop("_t")
    return out


def exploded_keys(ev: DataFrame) -> DataFrame:
    """A row per event and top-level key: key, value text, type.  Payloads that aren't objects have none, and those
    that name a key twice count as bad JSON.  Each payload is parsed once."""
    objects = ev.select("table_name", "timestamp", "_id", F.try_parse_json("data").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    keys = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("v").outer()))
    return keys.select("table_name", "timestamp", "_id", "key", F.col("value").try_cast("string").alias("value"), value_type(F.col("value")).alias("type"))


def json_key_inventory(ev: DataFrame, per_window: int | None = None, total: int | None = None) -> DataFrame:
    """Per table and key: rows with it, percent of the rows read, and counts of each type."""
    rows = sampled(ev, per_window, total)
    sizes = rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("rows_read"))
    out = exploded_keys(rows).groupBy("table_name", "key").agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TYPES])
    return out.join(sizes, "table_name").withColumn("percent", 100.0 * F.col("n_rows") / F.col("rows_read"))


def smallest_distinct(rows: DataFrame, keys: list[str], values: list[str], n: int) -> DataFrame:
    """Of each key the n smallest different tuples of values (strings; NULL before all), at most.

    A task keeps n of them for each key it has seen and lets go of no more; what tasks have kept is cut to n again.
    """
    names = [*keys, *values]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pd.DataFrame | None = None
        for batch in batches:
            own = batch.to_pandas().drop_duplicates()
            held = own if held is None else pd.concat([held, own]).drop_duplicates()
            held = held.sort_values(values, na_position="first", kind="stable").groupby(keys, dropna=False, sort=False).head(n)
        if held is not None:
            yield pa.RecordBatch.from_pandas(held.reset_index(drop=True), schema=pa.schema([(c, pa.string()) for c in names]))

    kept = rows.select(*[F.col(c).cast("string").alias(c) for c in names]).mapInArrow(keep, ", ".join(f"{c} string" for c in names)).distinct()
    first = Window.partitionBy(*keys).orderBy(*[F.asc_nulls_first(v) for v in values])  # n rows a task and key
    return kept.withColumn("_i", F.row_number().over(first)).filter(F.col("_i") <= n).drop("_i")


def key_examples(ev: DataFrame, n: int = 20, patterns: list[str] = S.SENSITIVE) -> DataFrame:
    """The first n distinct example values of each key in order of value, sensitive ones redacted, and its type: numbers
    whole or not are `number` if no other kind and not both occur, several kinds are `mixed`, nulls don't count."""
    rows = exploded_keys(ev)
    shown = F.when(S.sensitive_key(F.col("key"), patterns), S.REDACTED).otherwise(F.substring("value", 1, 80))
    rows = rows.select("table_name", "key", "type", shown.alias("value"))
    told = F.when(F.col("type") != "null", F.col("type"))
    one = F.when(F.min(told).isin("integer", "number"), "number").otherwise(F.min(told))
    kind = F.when(F.min(told) != F.max(told), "mixed").otherwise(F.coalesce(one, F.lit("unknown")))
    kinds = rows.groupBy("table_name", "key").agg(kind.alias("key_type"))
    examples = smallest_distinct(rows, ["table_name", "key"], ["value", "type"], n).groupBy("table_name", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), "|").alias("examples"))
    return examples.join(kinds, ["table_name", "key"]).select("table_name", "key", "examples", "key_type")


def flatten_json(ev: DataFrame, keys: list[str], patterns: list[str] = S.SENSITIVE) -> DataFrame:
    """Top-level keys as columns for review, sensitive ones redacted."""
    m = F.from_json("data", "map<string,string>")
    columns = [F.when(S.sensitive_key(F.lit(k), patterns) & m[k].isNotNull(), S.REDACTED).otherwise(m[k]).alias(k) for k in keys]
    return ev.select("table_name", "_id", "timestamp", "device_id", *columns)


def _has_part(column: Column, parts: list[str]) -> Column:
    return F.lower(column).rlike("|".join(parts))


def privacy_status(keys: DataFrame) -> DataFrame:
    """privacy_status of table_name and key."""
    private, hit = F.lower("table_name").isin(PRIVATE_TABLES), _has_part(F.col("key"), PRIVATE_KEYS)
    status = F.when(private & hit, "high_sensitive_do_not_use_raw").when(private, "privacy_sensitive_aggregate_only").when(hit, "sensitive_do_not_save_raw").otherwise("privacy_safe_aggregate")
    return keys.withColumn("privacy_status", status)


def key_families(keys: DataFrame) -> DataFrame:
    """family of each key by the first family with a part of its name."""
    family = F.coalesce(*[F.when(_has_part(F.col("key"), parts), F.lit(name)) for name, parts in KEY_FAMILIES.items()], F.lit("unknown"))
    return keys.withColumn("family", family)


def table_class(tables: DataFrame) -> DataFrame:
    """category, operational, high_frequency and use_for_now of table_name."""
    t = F.lower("table_name")
    operational, fast = t.startswith("sensor_"), t.isin(HIGH_FREQUENCY_TABLES)
    known = [F.when(t.isin(names), F.lit(name)) for name, names in CATEGORIES.items()]
    category = F.coalesce(F.when(operational, F.lit("operational")), F.when(fast, F.lit("motion")), *known, F.when(t.startswith("plugin_"), F.lit("system")), F.lit("unknown"))
    out = tables.withColumn("category", category).withColumn("operational", operational).withColumn("high_frequency", fast)
    now = F.when(F.col("category") == "operational", "ignore").when(F.col("category").isin("motion", "unknown"), "later").otherwise("yes")
    return out.withColumn("use_for_now", now)


def table_decisions(cov: DataFrame, catalog: DataFrame) -> DataFrame:
    """Of each table of the catalogue (table_name, has_device_ts) what to do with it, why, how risky it is, and its
    feature family, from what is known of it and from its coverage by windows (cov: table_name, n_rows)."""
    seen = cov.groupBy("table_name").agg(F.sum("n_rows").alias("n_rows"), F.count_if(F.col("n_rows") > 0).alias("windows_with_data"))
    out = catalog.join(seen, "table_name", "left").fillna(0, ["n_rows", "windows_with_data"])
    t = F.lower("table_name")

    def row(decision, relevance, risk, clear, family):
        texts = [x if isinstance(x, Column) else F.lit(x) for x in (decision, relevance, risk, clear, family)]
        return F.struct(*[x.alias(n) for x, n in zip(texts, ("decision", "behavioral_relevance", "query_risk", "interpretability", "family"), strict=True)])

    def of_table(families):
        return F.element_at(F.create_map(*[F.lit(x) for pair in families.items() for x in pair]), t)

    some = F.col("n_rows") > 0
    decided = (
        F.when(t.startswith("sensor_"), row("exclude", "operational ingestion metadata, not subject phenotype", "avoid", "low", "operational"))
        .when(t.isin(HIGH_FREQUENCY_TABLES), row("phase2_later", "raw high-frequency motion signal", "high", "requires separate signal-processing design", "high_frequency_motion"))
        .when(t.isin(DATA_QUALITY_TABLES), row("data_quality_only", "logging or device metadata support", F.when(some, "medium").otherwise("low"), "supportive only", "data_quality"))
        .when(~F.col("has_device_ts"), row("exclude", "missing device_id/timestamp window keys", "not_scanned", "not usable for current top10 windows", "unknown"))
        .when(t.isin(list(FIRST_FAMILIES)), row("include_now", "already validated Phase 1 behavioral family", "low_to_medium", "high", of_table(FIRST_FAMILIES)))
        .when(t.isin(list(SECOND_FAMILIES)), row("include_now", "contextual passive sensing candidate", F.when(t.isin("light", "proximity", "barometer"), "medium").otherwise("low"), "medium", of_table(SECOND_FAMILIES)))
        .when(t.isin(CAUTION_TABLES), row("include_with_caution", "potential contextual or communication metadata", "medium", "medium_to_low", of_table(CAUTION_FAMILIES)))
        .otherwise(row(F.when(some, "phase2_later").otherwise("exclude"), "unclassified table requiring manual review", "unknown", "unknown", "unclassified"))
    )
    out = out.withColumn("d", decided).select(*out.columns, "d.*")
    unseen = (F.col("windows_with_data") == 0) & F.col("decision").isin("include_now", "include_with_caution")
    out = out.withColumn("interpretability", F.when(unseen, F.concat("interpretability", F.lit("; no top10 early/late coverage observed"))).otherwise(F.col("interpretability")))
    out = out.withColumn("decision", F.when(unseen, "phase2_later").otherwise(F.col("decision")))
    risk = F.when(t.isin(PRIVATE_TABLES), "high").when(F.col("decision") != "include_with_caution", "low").otherwise("medium")
    return out.withColumn("privacy_risk", risk)

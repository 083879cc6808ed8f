"""Devices to subjects, and merges of subject tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import first_text, normalize_subject_id


def label_device_map(registry: DataFrame) -> DataFrame:
    """label, device_ids (sorted, `;` between), n_devices from registry rows (device_id, data with a label)."""
    label = first_text(F.get_json_object("data", "$.label"))
    named = registry.select(label.alias("label"), "device_id").where("label is not null and device_id is not null")
    devices = named.groupBy("label").agg(F.array_sort(F.collect_set("device_id")).alias("devices"))
    return devices.select("label", F.array_join("devices", ";").alias("device_ids"), F.size("devices").cast("long").alias("n_devices"))


def strict_device_map(label_map: DataFrame, order: str = "row_order") -> DataFrame:
    """subject_id, device_id.  Of the labels of a subject an exact three-digit one wins, else the last row."""
    rows = label_map.withColumn("subject_id", normalize_subject_id("label")).where("subject_id is not null")
    rows = rows.withColumn("exact", F.trim("label") == F.col("subject_id"))
    best = Window.partitionBy("subject_id").orderBy(F.desc("exact"), F.desc(order))
    chosen = rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1")
    devices = chosen.select("subject_id", F.explode(F.split("device_ids", ";")).alias("device_id"))
    return devices.select("subject_id", F.trim("device_id").alias("device_id")).where("device_id <> ''").distinct()


def device_subject_lookup(label_map: DataFrame, order: str = "row_order") -> DataFrame:
    """device_id, subject_id: a device of several labels goes to the numeric one, then to the first row."""
    rows = label_map.select(F.trim("label").alias("label"), F.col(order).alias("o"), F.explode(F.split("device_ids", ";")).alias("device_id"))
    rows = rows.withColumn("device_id", F.trim("device_id")).where("device_id <> ''")
    best = Window.partitionBy("device_id").orderBy(F.desc(F.col("label").rlike("^[0-9]+$")), "o")
    return rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("device_id", normalize_subject_id("label").alias("subject_id"))


def map_devices(ev: DataFrame, lookup: DataFrame) -> DataFrame:
    """ev with subject_id; devices that no label has get NOT_MAPPED."""
    return ev.join(lookup, "device_id", "left").withColumn("subject_id", F.coalesce("subject_id", F.lit("NOT_MAPPED")))


def subject_device_episodes(subjects: DataFrame, label_map: DataFrame) -> DataFrame:
    """A row per subject and device: episode (from 1), n_devices, status ok / no_label_match / no_devices."""
    labels = label_map.select(normalize_subject_id("label").alias("subject_id"), F.coalesce("device_ids", F.lit("")).alias("device_ids"))
    rows = subjects.select("subject_id").join(labels, "subject_id", "left")
    devices = F.filter(F.transform(F.split("device_ids", ";"), lambda d: F.trim(d)), lambda d: d != "")
    rows = rows.select("subject_id", "device_ids", F.posexplode_outer(F.coalesce(devices, F.array().cast("array<string>"))).alias("i", "device_id"))
    status = F.when(F.col("device_ids").isNull(), "no_label_match").when(F.col("device_id").isNull(), "no_devices").otherwise("ok")
    by = Window.partitionBy("subject_id")
    return rows.select(
        "subject_id",
        "device_id",
        F.when(F.col("device_id").isNotNull(), F.row_number().over(by.orderBy("device_ids", "i"))).alias("episode"),
        F.count("device_id").over(by).alias("n_devices"),
        status.alias("status"),
    )


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def merge_sheets(subjects: DataFrame, sheets: dict[str, DataFrame], key: str = "subject_id", order: str | None = None) -> DataFrame:
    """subjects left-joined with every sheet, its columns prefixed by its name, its first row of a key kept."""

    def joined(base: DataFrame, item) -> DataFrame:
        name, sheet = item
        sheet = first_of_each(sheet, [key], [order]) if order else sheet.dropDuplicates([key])
        columns = [F.col(c).alias(f"{name}_{c}") for c in sheet.columns if c not in (key, order)]
        return base.join(sheet.select(key, *columns), key, "left")

    return reduce(joined, sheets.items(), subjects)


def outer_merge_unique(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two tables whose keys must be unique; the plan fails at run time on a repeated key."""

    def unique(df: DataFrame, name: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        checked = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"{name}: the key ({', '.join(keys)}) is repeated")).cast("boolean"))
        return df.withColumn("_ok", checked).filter("_ok").drop("_ok")

    return unique(a, "left").join(unique(b, "right"), keys, "full_outer")


def pair_endpoints(t1: DataFrame, t2: DataFrame, key: str = "subject_id") -> DataFrame:
    """Rows of subjects in both tables, other columns suffixed _t1 and _t2."""
    side = lambda df, s: df.select(key, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != key])
    return side(t1, "t1").join(side(t2, "t2"), key)


def attach_features(subjects: DataFrame, wide: DataFrame, key: str = "subject_id") -> DataFrame:
    return subjects.join(wide, key, "left")


def reconcile(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys where has_data (expected) and extracted (actual) disagree, with the kind of mismatch."""
    both = expected.select(*keys, "has_data").join(actual.select(*keys, "extracted"), keys, "full_outer")
    both = both.fillna(False, ["has_data", "extracted"]).filter("has_data <> extracted")
    return both.withColumn("mismatch", F.when(F.col("has_data"), "coverage_only").otherwise("extraction_only"))

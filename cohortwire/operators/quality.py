"""Assessment tables and data-quality rules: each rule is a named condition, and issues are one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.io import intermediate
from .ranks import exact_quantiles

#: Codes that stand in a score's place.
CODES = ["FP", "DI", "NA", "N/A"]
#: The moments that a row may name, 2024 to 2027.
MS_LOW, MS_HIGH = 1_704_067_200_000, 1_830_211_199_000


def _long(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot([key], columns, "column_name", "raw")


def split_special_codes(sheet: DataFrame, columns: list[str], key: str = "subject_id", codes: list[str] = CODES) -> tuple[DataFrame, DataFrame]:
    """(values, flags): the sheet with codes as NULL and the rest as doubles, and a row for every code met."""
    clean = lambda c: F.upper(F.trim(F.col(c).cast("string")))
    values = sheet.select(key, *[F.when(~clean(c).isin(codes), S.to_number(c)).alias(c) for c in columns])
    flags = _long(sheet, columns, key).withColumn("code", F.upper(F.trim("raw"))).filter(F.col("code").isin(codes))
    return values, flags.select(key, "column_name", "code")


def data_dictionary(sheet: DataFrame, columns: list[str], key: str = "subject_id", codes: list[str] = CODES) -> DataFrame:
    """Per column: non-missing, numeric, and the codes seen."""
    rows = _long(sheet, columns, key).withColumn("text", F.nullif(F.trim("raw"), F.lit("")))
    code = F.when(F.upper("text").isin(codes), F.upper("text"))
    return rows.groupBy("column_name").agg(
        F.count("text").alias("non_missing"), F.count(S.to_number("text")).alias("numeric"), F.array_join(F.array_sort(F.collect_set(code)), ";").alias("codes_seen")
    )


def drop_artifacts(df: DataFrame, key: str = "subject_id") -> tuple[DataFrame, DataFrame]:
    """(clean, unlabelled): without all-empty columns and rows, and the rows that hold values but no key."""
    others = [c for c in df.columns if c != key]
    n = df.agg(*[F.count(c).alias(c) for c in others]).first()
    used = [c for c in others if n[c]]
    any_value = F.coalesce(*[F.col(c).cast("string") for c in used]).isNotNull() if used else F.lit(False)
    rows = df.select(key, *used)
    return rows.filter(F.col(key).isNotNull() & any_value), rows.filter(F.col(key).isNull() & any_value)


def delta_consistency(wide: DataFrame, key: str = "subject_id", tolerance: float = 0.11) -> DataFrame:
    """Rows where x_delta differs from x_t2 - x_t1 by more than the tolerance, for every x with the three columns."""
    names = [c[: -len("_delta")] for c in wide.columns if c.endswith("_delta") and f"{c[:-6]}_t1" in wide.columns and f"{c[:-6]}_t2" in wide.columns]
    triples = F.array(*[F.struct(F.lit(n).alias("outcome"), *[F.col(f"{n}_{s}").cast("double").alias(s) for s in ("t1", "t2", "delta")]) for n in names])
    rows = wide.select(key, F.explode(triples).alias("x")).select(key, "x.*")
    return rows.withColumn("difference", F.abs(F.col("delta") - (F.col("t2") - F.col("t1")))).filter(F.col("difference") > tolerance)


def missingness_report(df: DataFrame, columns: list[str], key: str = "subject_id") -> DataFrame:
    rows = df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "column_name", "value")
    return rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1))).alias("missing_pct"), F.min("value").alias("min"), F.avg("value").alias("mean"), F.max("value").alias("max"))


def row_completeness(df: DataFrame, columns: list[str], key: str = "subject_id") -> DataFrame:
    there = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return df.select(key, (100.0 * there / len(columns)).alias("complete_pct"))


def code_summary(flags: DataFrame) -> DataFrame:
    """Counts by code, by column and by both in one pass; NULL stands for all."""
    return flags.cube("code", "column_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def flag_counts(subjects: DataFrame, flags: DataFrame) -> DataFrame:
    n = flags.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_flags"), F.count_if(F.col("code") == "FP").alias("n_fp"), F.count_if(F.col("code") == "DI").alias("n_di"))
    return subjects.join(n, "subject_id", "left").fillna(0, ["n_flags", "n_fp", "n_di"])


def issues(df: DataFrame, key: list[str], rules: dict[str, Column]) -> DataFrame:
    """(key, issue): one row for every rule that a row breaks, distinct."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return df.select(*key, F.explode(found).alias("issue")).dropDuplicates([*key, "issue"])


#: The moments of a subject's row.
WINDOW_TIMES = ["T1_start_ms", "T1_end_ms", "T2_start_ms", "T2_end_ms", "early_window_start_ms", "early_window_end_ms", "late_window_start_ms", "late_window_end_ms"]


def window_issues(subjects: DataFrame, low: int = MS_LOW, high: int = MS_HIGH) -> DataFrame:
    """subject_id, issue: missing and out-of-range times, starts that are not before ends, a T2 that is not after T1, and
    early and late windows that overlap (both ends included).  Rules on a missing time don't hold."""
    c = F.col
    rules = {f"missing:{n}": c(n).isNull() for n in WINDOW_TIMES} | {f"invalid_ms_range:{n}": ~c(n).between(low, high) for n in WINDOW_TIMES}
    rules |= {
        "T1_start_not_before_T1_end": c("T1_start_ms") >= c("T1_end_ms"),
        "T2_start_not_before_T2_end": c("T2_start_ms") >= c("T2_end_ms"),
        "T2_before_or_equal_T1": c("T1_start_ms") >= c("T2_start_ms"),
        "early_window_start_not_before_end": c("early_window_start_ms") >= c("early_window_end_ms"),
        "late_window_start_not_before_end": c("late_window_start_ms") >= c("late_window_end_ms"),
        "early_late_window_overlap": (c("early_window_start_ms") <= c("late_window_end_ms")) & (c("late_window_start_ms") <= c("early_window_end_ms")),
    }
    return issues(subjects, ["subject_id"], rules)


def feature_issues(sw: DataFrame, counts: list[str], max_days: int = 7) -> DataFrame:
    """Rules on subject-window rows (n_rows, active_days, status, early_value, late_value, delta_value)."""
    c = F.col
    rules = {f"{n}_negative": c(n) < 0 for n in counts}
    rules |= {
        "too_many_active_days": c("active_days") > max_days,
        "infinite_percent": F.abs("pct_change") == float("inf"),
        "delta_without_both_windows": c("delta_value").isNotNull() & (c("early_value").isNull() | c("late_value").isNull()),
        "status_mismatch": ((c("status") == "ok_no_data") & (c("n_rows") > 0)) | ((c("status") == "ok_has_data") & (c("n_rows") == 0)),
        "no_data_as_value": (c("status") == "ok_no_data") & c("early_value").isNotNull() & c("late_value").isNotNull(),
    }
    return issues(sw, ["subject_id", "table_name", "window_rule"], rules)


def numeric_summary(long: DataFrame, by: str = "feature") -> DataFrame:
    """Number, extremes, median and mean of each feature's values, and how many are zero or negative."""
    rows, v = intermediate(long.select(by, F.col("value").cast("double").alias("value"))), F.col("value")
    medians = exact_quantiles(rows, ["value"], [0.5], [by], written=True).withColumnRenamed("value_q0", "median")
    stats = rows.groupBy(by).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.count_if(v == 0).alias("zeros"), F.count_if(v < 0).alias("negatives"))
    return stats.join(medians, by, "left").select(by, "n", "min", "median", "mean", "max", "zeros", "negatives")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def model_dataset(wide: DataFrame, status: DataFrame, features: list[str]) -> DataFrame:
    """Features with missing__ indicators, how many are observed, the missing share, and the share of each subject's
    tables with data by window class."""
    out = wide.select("subject_id", *features, *[F.col(f).isNull().cast("int").alias(f"missing__{f}") for f in features])
    observed = sum((F.col(f).isNotNull().cast("int") for f in features[1:]), F.col(features[0]).isNotNull().cast("int"))
    out = out.withColumn("observed_features", observed).withColumn("missing_fraction", 1 - observed / float(len(features)))
    share = lambda cls: F.avg(F.when(F.col("window_class") == cls, F.col("has_data").cast("double")))
    cover = status.groupBy("subject_id").agg(*[share(c).alias(f"coverage_{c}") for c in ("primary", "adjusted")])
    return out.join(cover, "subject_id", "left")


def recommend_features(dataset: DataFrame, features: list[str], adjusted: list[str] = ()) -> DataFrame:
    """missing_pct (one decimal) and recommendation: nothing observed, else adjusted features stay for sensitivity, else
    over half missing, else primary."""
    rows = dataset.select("subject_id", *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["subject_id"], features, "feature", "value")
    out = rows.groupBy("feature").agg(F.round(100.0 * F.count_if(F.col("value").isNull()) / F.count(F.lit(1)), 1).alias("missing_pct"))
    m = F.col("missing_pct")
    advice = F.when(m >= 100, "exclude_no_observed_data").when(F.col("feature").isin(list(adjusted)), "adjusted_sensitivity").when(m > 50, "coverage_sensitivity").otherwise("include_primary")
    return out.withColumn("recommendation", advice)


def repeated_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once."""
    return df.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("n > 1")

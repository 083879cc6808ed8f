"""Ranks, percentiles, axes and bands of subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import intermediate
from .coverage import unpivoted
from .ranks import exact_quantiles, placed


def category(percent: Column, low: float = 33.3333, high: float = 66.6667) -> Column:
    return F.when(percent <= low, "low").when(percent <= high, "medium").otherwise("high")


def ranked_long(long: DataFrame, by: list[str] = ("feature",)) -> DataFrame:
    """Descending rank, average-tie percentile rank (%) and tertile of `value` within each feature; nulls stay out."""
    rows = placed(long.where("value is not null"), ["value"], list(by))
    n, below, ties = F.col("n"), F.col("value_below"), F.col("value_ties")
    out = rows.select(*long.columns, (n - below - ties + 1).alias("rank_desc"), (100.0 * (below + 1 + (ties - 1) / 2.0) / n).alias("percentile"))
    return out.withColumn("category", category(F.col("percentile")))


def rank_percentile_category(df: DataFrame, cols: list[str], key: str = "subject_id") -> DataFrame:
    return ranked_long(unpivoted(df, cols, key))


def axis_scores(wide: DataFrame, axes: dict[str, list[str]], key: str = "subject_id") -> DataFrame:
    """Each axis's mean of feature percentiles over the subjects that have all its features, ranked again to
    low/medium/high; the others are insufficient_data."""
    out = None
    for axis, cols in axes.items():
        complete = wide.dropna(subset=cols)
        mean = rank_percentile_category(complete, cols, key).groupBy(key).agg(F.avg("percentile").alias("value"))
        level = ranked_long(mean.withColumn("feature", F.lit(axis))).select(key, F.col("value").alias("score"), "percentile", "category")
        one = wide.select(key).join(level, key, "left").select(key, F.lit(axis).alias("axis"), "score", "percentile", F.coalesce("category", F.lit("insufficient_data")).alias("level"))
        out = one if out is None else out.unionByName(one)
    return out


LEVELS = ["low", "medium", "high", "insufficient_data"]


def level_distribution(axes: DataFrame) -> DataFrame:
    return axes.groupBy("axis").pivot("level", LEVELS).agg(F.count(F.lit(1))).fillna(0, LEVELS)


def variability(long: DataFrame) -> DataFrame:
    """Sample SD, IQR and count of each feature, ranked by SD."""
    rows = intermediate(long.select("feature", F.col("value").cast("double").alias("value")))
    stats = rows.groupBy("feature").agg(F.stddev_samp("value").alias("sd"), F.count("value").alias("n"))
    quartiles = exact_quantiles(rows, ["value"], [0.25, 0.75], ["feature"], written=True)
    out = stats.join(quartiles, "feature", "left").withColumn("iqr", F.col("value_q1") - F.col("value_q0")).select("feature", "sd", "iqr", "n")
    return out.withColumn("variability_rank", F.rank().over(Window.orderBy(F.desc_nulls_last("sd"))).cast("long"))


def usability_flags(wide: DataFrame, phases: dict[str, tuple[str, str]]) -> DataFrame:
    """From (early, late) columns of each phase: usable at baseline, for change, and what may be interpreted."""
    baseline = change = F.lit(False)
    for early, late in phases.values():
        baseline = baseline | F.col(early).isNotNull()
        change = change | (F.col(early).isNotNull() & F.col(late).isNotNull())
    scope = F.when(change, "baseline_and_change").when(baseline, "baseline_only").otherwise("not_usable")
    return wide.withColumn("usable_baseline", baseline).withColumn("usable_change", change).withColumn("interpretation_scope", scope)


def coverage_bands(df: DataFrame, missing: str = "missing_fraction", cover: str = "table_coverage", key: str = "subject_id") -> DataFrame:
    """Rank by missing share, then table coverage (largest first), then key; bands of 25, 50 and 25 %, and the cohorts of
    the first 10, 20 and 30.  A missing share that is NULL counts as 1, a coverage as 0.

    Rows of equal coverage are counted first; ranks are sums over the different coverages and places within one.
    """
    rows = df.withColumn("_m", F.coalesce(missing, F.lit(1.0))).withColumn("_c", -F.coalesce(cover, F.lit(0.0)))
    # Below in the order of both: of the missing share, and of the coverage among rows of that share.
    rows = placed(rows, ["_m"], []).withColumnRenamed("n", "_n")
    within = Window.partitionBy("_m").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy("_m", "_c").agg(F.count(F.lit(1)).alias("_ties"))
    groups = groups.select("_m", "_c", F.coalesce(F.sum("_ties").over(within), F.lit(0)).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_m", "_c").orderBy(key))
    out = rows.join(groups, ["_m", "_c"]).withColumn("coverage_rank", F.col("_m_below") + F.col("_first") + place)
    share = lambda q: F.greatest(F.lit(1), F.ceil(F.col("_n") * q))
    r = F.col("coverage_rank")
    band = F.when(r <= share(0.25), "Highest coverage quartile").when(r <= share(0.75), "Middle coverage").otherwise("Lowest coverage quartile")
    cohort = F.when(r <= 10, "top_10").when(r <= 20, "top_20").when(r <= 30, "top_30").otherwise("full")
    return out.withColumn("coverage_band", band).withColumn("coverage_cohort", cohort).select(*df.columns, "coverage_rank", "coverage_band", "coverage_cohort")


def quartile_label(df: DataFrame, col: str) -> DataFrame:
    """quartile q1..q4 of a column by interpolated cuts."""
    cuts = df.agg(*[F.percentile(col, F.lit(p)).alias(f"_q{i}") for i, p in enumerate((0.25, 0.5, 0.75))])
    x = F.col(col)
    label = F.when(x.isNull(), None).when(x <= F.col("_q0"), "q1").when(x <= F.col("_q1"), "q2").when(x <= F.col("_q2"), "q3").otherwise("q4")
    return df.join(F.broadcast(cuts)).withColumn("quartile", label).drop("_q0", "_q1", "_q2")


def quartile_filter(df: DataFrame, col: str, labels: list[str]) -> DataFrame:
    return quartile_label(df, col).filter(F.col("quartile").isin(labels))


def predictions_wide(df: DataFrame, models: list[str], key: str = "subject_id") -> DataFrame:
    return df.groupBy(key).pivot("model", models).agg(F.first("prediction", ignorenulls=True))

"""Long and wide tables, changes between windows, merges of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coverage import best_devices
from .rangejoin import small


def to_long(features: DataFrame, selected: DataFrame, status: DataFrame, names: list[str]) -> DataFrame:
    """A row per subject and selected (table_name, feature), computed or not.

    features: subject_id, table_name and the named columns; status: subject_id, table_name, table_status for every
    attempt.  feature_status is computed, else the table's status, else feature_missing.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    values = features.select("subject_id", "table_name", F.explode(pairs).alias("p")).select("subject_id", "table_name", "p.*")
    grid = status.join(small(selected.select("table_name", "feature")), "table_name")
    out = grid.join(values, ["subject_id", "table_name", "feature"], "left")
    state = F.when(F.col("value").isNotNull(), "computed").when(F.col("table_status") != "ok", F.col("table_status")).otherwise("feature_missing")
    return out.select("subject_id", "table_name", "feature", "value", state.alias("feature_status"))


def to_wide(long: DataFrame, subjects: DataFrame, names: list[str]) -> DataFrame:
    """A row per subject and a column per name, kept even if it is empty."""
    wide = long.groupBy("subject_id").pivot("feature", names).agg(F.first("value", ignorenulls=True))
    return subjects.join(wide, "subject_id", "left")


def early_late_wide(sw: DataFrame, names: list[str], template: str = "{window}__{table}__{name}", tables: list[str] = ()) -> DataFrame:
    """Subject-window rows to one row per subject with a column per window, table and feature; a value counts only
    where the table has data there."""
    valid = F.col("table_has_data") & (F.col("status") != "ok_no_data")
    columns = []
    for window in ("early", "late"):
        for table in tables:
            here = (F.col("window_rule") == window) & (F.col("table_name") == table) & valid
            columns += [F.max(F.when(here, F.col(n))).alias(template.format(window=window, table=table, name=n)) for n in names]
    return sw.groupBy("subject_id").agg(*columns)


def delta(early: Column, late: Column) -> Column:
    return F.when(early.isNotNull() & late.isNotNull(), late - early)


def add_deltas(wide: DataFrame, spec: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name its (early, late) columns' change, percent change (NULL unless early > 0) and status."""
    out = {}
    for name, (e, lt) in spec.items():
        early, late = F.col(e), F.col(lt)
        out[f"{name}_delta"] = delta(early, late)
        out[f"{name}_pct_change"] = F.when(early > 0, 100.0 * delta(early, late) / early)
        out[f"{name}_delta_status"] = F.when(early.isNotNull() & late.isNotNull(), "both").when(early.isNotNull(), "early_only").when(late.isNotNull(), "late_only").otherwise("none")
    return wide.withColumns(out)


def replace_table(shared: DataFrame, run: DataFrame, table: str) -> DataFrame:
    """shared with the rows of one table exchanged for the run's."""
    return shared.filter(~F.col("table_name").eqNullSafe(F.lit(table))).unionByName(run.filter(F.col("table_name") == table), allowMissingColumns=True)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pending_subjects(subjects: DataFrame, status: DataFrame, n_tables: int) -> DataFrame:
    """Subjects who don't yet have all tables finished without error."""
    done = status.groupBy("subject_id").agg(F.count_distinct(F.when(F.col("error").isNull(), F.col("table_name"))).alias("n")).filter(F.col("n") >= n_tables)
    return subjects.join(done, "subject_id", "left_anti")


def top_n(df: DataFrame, score: Column, n: int, ties: str = "subject_id") -> DataFrame:
    """The n rows of largest score, nulls left out: a report."""
    return df.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), ties).limit(n)


def sample_rows(ev: DataFrame, n: int, per: list[str], total: int | None = None) -> DataFrame:
    """The first n rows by time of each group, and of each table `total` at most: a sampler."""
    w = Window.partitionBy(*per).orderBy("timestamp", "_id")
    out = ev.withColumn("sample_no", F.row_number().over(w)).filter(F.col("sample_no") <= n)
    if total is not None:
        out = out.withColumn("_t", F.row_number().over(Window.partitionBy("table_name").orderBy("timestamp", "_id"))).filter(F.col("_t") <= total).drop("_t")
    return out


def first_rows(ev: DataFrame) -> DataFrame:
    """The first row of every table: an aggregate, so nothing is sorted."""
    row = F.struct(*[c for c in ev.columns if c != "table_name"])
    return ev.groupBy("table_name").agg(F.min_by(row, F.struct("timestamp", "_id")).alias("r")).select("table_name", "r.*")


def best_device_rows(ev: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows of each table's device with most rows."""
    best = best_devices(ev).select("table_name", "device_id")
    return sample_rows(ev.join(best, ["table_name", "device_id"], "left_semi"), n, ["table_name"])


def union_runs(*runs: DataFrame) -> DataFrame:
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def common(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).intersect(b.select(*columns))


def except_subjects(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b.select("subject_id").distinct(), "subject_id", "left_anti")


def collect_values(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    """Calculated values of all runs (subject_id, table_name, feature, value), each with its source; of a table and
    feature the earliest listed source that has it is kept."""
    rows = union_runs(*[df.withColumn("source", F.lit(name)).withColumn("source_no", F.lit(i)) for i, (name, df) in enumerate(runs)]).where("value is not null")
    best = F.min("source_no").over(Window.partitionBy("table_name", "feature"))
    return rows.withColumn("_best", best).filter("source_no = _best").drop("_best", "source_no")



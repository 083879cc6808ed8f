"""From raw events and windows to the feature tables of a study: long with a status for every attempt, wide, coverage."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import intermediate
from .coverage import status_counts
from .rangejoin import range_join
from .reshape import to_wide

STATUSES = ["calculated", "no_valid_rows", "no_rows_in_window", "no_window"]


class Job(NamedTuple):
    """Features of one table: a function of its windowed events, and the names of those that are wanted."""

    features: Callable[[DataFrame], DataFrame]
    names: list[str]


class Extracted(NamedTuple):
    long: DataFrame
    wide: DataFrame
    coverage: DataFrame


def windowed(ev: DataFrame, win: DataFrame, tables: list[str]) -> DataFrame:
    """Events of the tables in their windows (subject_id, device_id, table_name, window_rule, start_ms, end_ms)."""
    return range_join(ev.filter(F.col("table_name").isin(tables)), win.filter(F.col("table_name").isin(tables)).where("start_ms is not null and device_id is not null"))


def extract(ev: DataFrame, win: DataFrame, subjects: DataFrame, jobs: dict[str, Job]) -> Extracted:
    """Runs every table's job and returns long, wide and coverage.

    long: subject_id, table_name, feature, value, table_status, feature_status, a row for every subject, table and wanted
    feature; table_status is calculated, no_valid_rows (rows, none of them readable), no_rows_in_window or no_window,
    and feature_status that, or feature_missing for a value that is NULL where the table was calculated.  wide: a row
    per subject and a column <table>__<feature>.  coverage: how often each status occurs by table.
    """
    we = intermediate(windowed(ev, win, list(jobs)), "windowed", by=["table_name"])  # once for all jobs, each reads its table
    values = rows = None
    for table, job in jobs.items():
        found = job.features(we.filter(F.col("table_name") == table))
        pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in job.names])
        readable = F.lit(True) if "feature_status" not in found.columns else F.col("feature_status") == "computed"
        one = found.select("subject_id", F.lit(table).alias("table_name"), readable.alias("readable"), F.explode(pairs).alias("p")).select("subject_id", "table_name", "readable", "p.*")
        grid = subjects.select("subject_id", F.lit(table).alias("table_name"), F.explode(F.array(*[F.lit(n) for n in job.names])).alias("feature"))
        values = one if values is None else values.unionByName(one)
        rows = grid if rows is None else rows.unionByName(grid)
    there = win.filter(F.col("table_name").isin(list(jobs))).where("start_ms is not null").select("subject_id", "table_name").distinct().withColumn("_window", F.lit(True))
    long = rows.join(there, ["subject_id", "table_name"], "left").join(values, ["subject_id", "table_name", "feature"], "left")
    status = F.when(F.col("readable"), STATUSES[0]).when(F.col("readable").isNotNull(), STATUSES[1]).when(F.col("_window"), STATUSES[2]).otherwise(STATUSES[3])
    long = long.withColumn("table_status", status)
    state = F.when(F.col("value").isNotNull(), STATUSES[0]).when(F.col("table_status") == STATUSES[0], "feature_missing").otherwise(F.col("table_status"))
    long = long.select("subject_id", "table_name", "feature", "value", "table_status", state.alias("feature_status"))
    named = long.withColumn("feature", F.concat_ws("__", "table_name", "feature"))
    wide = to_wide(named, subjects.select("subject_id"), [f"{t}__{n}" for t, job in jobs.items() for n in job.names])
    coverage = status_counts(long.select("subject_id", "table_name", F.col("table_status").alias("status")).distinct(), STATUSES)
    return Extracted(long, wide, coverage)

"""Reading raw events and writing result tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT_COLUMNS = ["_id", "timestamp", "device_id", "data"]


def read_events(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Raw events of a parquet lake, the event columns only; `table` prunes to one sensor's partition."""
    ev = spark.read.parquet(path)
    if "table_name" not in ev.columns:
        return ev.select(*EVENT_COLUMNS, F.lit(table).alias("table_name")) if table else ev.select(*EVENT_COLUMNS)
    ev = ev.filter(F.col("table_name") == table) if table else ev
    return ev.select(*EVENT_COLUMNS, "table_name")


def read_events_jdbc(spark: SparkSession, url: str, table: str, lower_ms: int, upper_ms: int, n: int, fetch: int = 20_000, **options) -> DataFrame:
    """Raw events of a database table in n time slices, rows in [lower_ms, upper_ms) only."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn="timestamp", lowerBound=lower_ms, upperBound=upper_ms, numPartitions=n, fetchsize=fetch, **options
    )
    ev = reader.load().select(*EVENT_COLUMNS)
    return ev.filter((F.col("timestamp") >= lower_ms) & (F.col("timestamp") < upper_ms)).withColumn("table_name", F.lit(table))


def write_tables(df: DataFrame, path: str, by: list[str] | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def append_records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    write_tables(df, path, fmt=fmt, mode="append")


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode).text(path)


def export_signal(ev: DataFrame, device_id: str, start_ms: int, days: int = 1) -> DataFrame:
    """x, y, z of one device for some days, in time order across and within partitions."""
    stop = start_ms + days * 86_400_000
    rows = ev.filter((F.col("device_id") == device_id) & (F.col("timestamp") >= start_ms) & (F.col("timestamp") < stop))
    axis = [F.get_json_object("data", f"$.double_values_{i}").try_cast("double").alias(n) for i, n in enumerate("xyz")]
    return rows.select("_id", "timestamp", "device_id", *axis).orderBy("timestamp", "_id")


def last_minutes(ev: DataFrame, minutes: int = 5, lookback_h: int = 6, now_ms: int | None = None) -> DataFrame:
    """Each device's rows of its last `minutes`, both ends included, as seen within the look-back before now_ms."""
    recent = ev
    if now_ms is not None:
        recent = ev.filter((F.col("timestamp") <= now_ms) & (F.col("timestamp") >= now_ms - lookback_h * 3_600_000))
    latest = recent.groupBy("device_id").agg(F.max("timestamp").alias("latest"))
    return recent.join(latest, "device_id").filter(F.col("timestamp") >= F.col("latest") - minutes * 60_000).drop("latest")


def ranked(df: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


_OURS: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; only a session on one machine may do
    without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cohortwire-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def intermediate(df: DataFrame, name: str = "rows", by: list[str] = ()) -> DataFrame:
    """df written once to the shared folder and read back, for plans that read it several times: it is derived once and
    outlives lost executors; with `by`, a filter on these columns reads its part only.  The folder goes when the driver
    ends, as later plans may still read it."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _OURS[path] = spark
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_intermediates() -> None:
    for path, spark in _OURS.items():
        with contextlib.suppress(Exception):  # the session may have ended
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class EventStore:
    """Raw events as a table laid out for jobs by device: bucketed by device and sorted by device, table and time.

    Joins and aggregates by device read it without a shuffle of events, and a filter on devices or times skips row
    groups by their least and largest values.  `days` cuts it into partitions of so many days, to be replaced or dropped.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int, location: str | None = None, days: int = 30):
        self.spark, self.name, self.buckets, self.location, self.days = spark, name, buckets, location, days

    def add(self, ev: DataFrame) -> None:
        """Appends events (EVENT_COLUMNS and table_name); rows of one bucket and period go to one file."""
        period = F.floor(F.col("timestamp") / (self.days * 86_400_000)).cast("int")
        rows = ev.select(*EVENT_COLUMNS, "table_name", period.alias("period")).repartition(self.buckets, "device_id")
        writer = rows.write.mode("append").format("parquet").partitionBy("period").bucketBy(self.buckets, "device_id").sortBy("device_id", "table_name", "timestamp")
        writer = writer.option("path", self.location) if self.location else writer
        writer.saveAsTable(self.name)

    def events(self, low_ms: int | None = None, high_ms: int | None = None) -> DataFrame:
        """The events in [low_ms, high_ms), from the periods that hold them."""
        ev = self.spark.table(self.name)
        if low_ms is not None:
            ev = ev.filter((F.col("timestamp") >= low_ms) & (F.col("period") >= low_ms // (self.days * 86_400_000)))
        if high_ms is not None:
            ev = ev.filter((F.col("timestamp") < high_ms) & (F.col("period") <= (high_ms - 1) // (self.days * 86_400_000)))
        return ev.drop("period")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

"""The same work as Structured Streaming: every function takes and returns a streaming DataFrame."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scalars as S
from ..operators.rangejoin import small


def with_event_time(sdf: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    return sdf.withColumn("ts", F.timestamp_millis("timestamp")).withWatermark("ts", watermark)


def _middle(ordered):
    """Median of an ascending array without nulls; NULL if it is empty."""
    n = F.size(ordered)
    return F.when(n > 0, (F.element_at(ordered, ((n + 1) / 2).cast("int")) + F.element_at(ordered, (n / 2).cast("int") + 1)) / 2.0)


def stream_chunk_stats(sdf: DataFrame, watermark: str = "10 minutes", chunk: str = "5 minutes", anchor: str = "0 seconds", high_motion: float = 0.75) -> DataFrame:
    """Statistics of value in tumbling chunks by device, as for whole windows: intervals, gaps of over a second, and the
    deviation from the chunk's median.  Chunks start `anchor` after whole ones of the epoch; rows later than the
    watermark are dropped.  The state holds a chunk's samples, whose number a sensor's rate bounds.
    """
    w = with_event_time(sdf, watermark).groupBy("device_id", F.window("ts", chunk, None, anchor).alias("w"))
    out = w.agg(F.count(F.lit(1)).alias("sample_count"), F.avg("value").alias("mean_value"), F.stddev_pop("value").alias("sd_value"), F.array_sort(F.collect_list(F.struct("timestamp", "value"))).alias("s"))
    ms, x = F.col("s.timestamp"), F.array_sort(F.filter("s.value", lambda v: v.isNotNull()))
    steps = F.zip_with(F.slice(ms, 2, F.greatest(F.size(ms) - 1, F.lit(0))), F.slice(ms, 1, F.greatest(F.size(ms) - 1, F.lit(0))), lambda a, b: (a - b) / 1000.0)
    out = out.withColumn("median_value", _middle(x)).withColumn("gaps", F.filter(steps, lambda g: g > 0))
    dynamic = F.array_sort(F.transform(x, lambda v: F.abs(v - F.col("median_value"))))
    out = out.withColumn("dynamic", dynamic)
    total = lambda array: F.aggregate(array, F.lit(0.0), lambda a, g: a + g)
    large = F.filter("gaps", lambda g: g > 1)
    seconds = (F.unix_millis("w.end") - F.unix_millis("w.start")) / 1000.0
    n = F.size("dynamic")
    return out.select(
        "device_id", F.unix_millis("w.start").alias("chunk_start_ms"), "sample_count", "mean_value", "sd_value", "median_value", F.element_at(ms, 1).alias("first_ms"), F.element_at(ms, -1).alias("last_ms"),
        _middle(F.array_sort("gaps")).alias("median_interval_s"), F.array_max("gaps").alias("max_gap_s"), F.size(large).alias("gaps_over_1s"), (total(large) / seconds).alias("gap_burden"),
        F.when(n > 0, total(F.col("dynamic")) / n).alias("dynamic_mean"), _middle(F.col("dynamic")).alias("dynamic_median"), F.when(n > 0, F.size(F.filter("dynamic", lambda d: d >= high_motion)) / n).alias("high_motion_fraction"),
    )


def stream_dedupe(sdf: DataFrame, watermark: str = "10 minutes", keys: list[str] = ("device_id", "timestamp", "data")) -> DataFrame:
    """Exact duplicates removed; state is kept for the watermark only."""
    return with_event_time(sdf, watermark).dropDuplicatesWithinWatermark(list(keys)).drop("ts")


def stream_bursts(sdf: DataFrame, gap: str = "30 seconds", watermark: str = "10 minutes") -> DataFrame:
    """Bursts by device: sessions that end with a pause longer than the gap."""
    w = with_event_time(sdf, watermark).groupBy("device_id", F.session_window("ts", gap).alias("w"))
    out = w.agg(F.count(F.lit(1)).alias("n_events"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))
    return out.select("device_id", "first_ms", "last_ms", "n_events")


def stream_sliding_counts(sdf: DataFrame, size: str = "10 minutes", slide: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    w = with_event_time(sdf, watermark).groupBy("device_id", F.window("ts", size, slide).alias("w"))
    return w.agg(F.count(F.lit(1)).alias("n_events")).select("device_id", F.unix_millis("w.start").alias("start_ms"), F.unix_millis("w.end").alias("end_ms"), "n_events")


_SESSIONS = "device_id string, start_ms long, end_ms long, seconds double"


def _unlock_sessions(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:  # a session that nothing closed
        state.remove()
        return
    (unlocked,) = state.get if state.exists else (None,)
    rows = pd.concat(list(frames)).sort_values(["timestamp", "status"])
    done = []
    for ms, status in zip(rows["timestamp"], rows["status"], strict=True):
        if status == 3:
            unlocked = int(ms)
        elif status in (0, 2) and unlocked is not None:
            done.append((key[0], unlocked, int(ms), (int(ms) - unlocked) / 1000.0))
            unlocked = None
    if unlocked is None:
        if state.exists:
            state.remove()
    else:
        state.update((unlocked,))
        state.setTimeoutTimestamp(max(unlocked + 24 * 3_600_000, state.getCurrentWatermarkMs() + 1))
    if done:
        yield pd.DataFrame(done, columns=["device_id", "start_ms", "end_ms", "seconds"])


def stream_unlock_sessions(sdf: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Unlocked sessions (last unlock to next close) across micro-batches: one number of state per device, dropped
    once the watermark is a day past an unlock that nothing closed."""
    status = S.to_number(F.get_json_object("data", "$.screen_status")).cast("int")
    rows = with_event_time(sdf, watermark).select("device_id", "timestamp", "ts", status.alias("status")).where("status is not null")
    return rows.groupBy("device_id").applyInPandasWithState(_unlock_sessions, _SESSIONS, "unlocked_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_enrich(sdf: DataFrame, device_map: DataFrame, win: DataFrame | None = None) -> DataFrame:
    """Stream-static join with the device map and, if given, the subjects' windows."""
    out = sdf.join(small(device_map), "device_id", "left").withColumn("subject_id", F.coalesce("subject_id", F.lit("NOT_MAPPED")))
    if win is None:
        return out
    w = small(win.select("subject_id", "window_rule", "start_ms", "end_ms").withColumnRenamed("subject_id", "w_subject_id"))
    inside = (F.col("subject_id") == F.col("w_subject_id")) & (F.col("timestamp") >= F.col("start_ms")) & (F.col("timestamp") < F.col("end_ms"))
    return out.join(w, inside).drop("w_subject_id")


#: Live folders of an upserted table beyond which a batch makes one of them, and versions that readers may still hold.
COMPACT_AFTER, KEPT_VERSIONS = 8, 3


class UpsertedTable:
    """A table of the last row of each key, under `path`: folders of rows, and a manifest for each batch that names the
    live ones.

    A manifest gets its name by a rename when all is written, so readers see a batch wholly or not at all; a batch that
    has a manifest is not written again.  When COMPACT_AFTER folders are live, the last row of each key goes to a new one,
    which takes their place; folders that the last KEPT_VERSIONS manifests don't name are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, list(keys)
        self.root = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        where = self._at("manifest")
        names = [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def live(self, version: int) -> list[str]:
        stream = self.files.open(self._at("manifest", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, version: int, live: list[str]) -> None:
        temporary = self._at("manifest", f"_{version:012d}-{uuid.uuid4().hex}")
        stream = self.files.create(temporary, True)
        stream.write(bytearray(json.dumps(live).encode()))
        stream.close()
        self.files.rename(temporary, self._at("manifest", f"{version:012d}.json"))

    def _read(self, live: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{name}" for name in live])

    def _last(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "batch").alias("_last"))
        return last.select(*self.keys, "_last.*")

    def add(self, batch: DataFrame, number: int) -> None:
        """Adds a batch; of its rows of one key any one counts."""
        known = self.versions()
        if number in known:
            return
        earlier = [v for v in known if v < number]
        live = self.live(earlier[-1]) if earlier else []
        name = f"batch-{number:012d}"
        batch.dropDuplicates(self.keys).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        live.append(name)
        if len(live) > COMPACT_AFTER:
            compacted = f"compacted-{number:012d}"
            self._last(self._read(live)).write.mode("overwrite").parquet(f"{self.path}/{compacted}")
            live = [compacted]
        self._publish(number, live)
        self._vacuum([*known, number])

    def _vacuum(self, versions: list[int]) -> None:
        kept = sorted(versions)[-KEPT_VERSIONS:]
        needed = {name for v in kept for name in self.live(v)}
        for status in self.files.listStatus(self.root):
            name = status.getPath().getName()
            old = int(name.rpartition("-")[2]) <= kept[-1] if name.startswith(("batch-", "compacted-")) else False
            if old and name not in needed:
                self.files.delete(status.getPath(), True)
        for v in sorted(versions)[:-KEPT_VERSIONS]:
            self.files.delete(self._at("manifest", f"{v:012d}.json"), True)

    def read(self, version: int | None = None) -> DataFrame:
        """The last row of each key with the batch it came in, as of the last batch or of an earlier one that is kept."""
        versions = self.versions()
        if not versions:
            raise FileNotFoundError(f"no batch has been written to {self.path}")
        return self._last(self._read(self.live(versions[-1] if version is None else version)))


def stream_upsert(sdf: DataFrame, path: str, checkpoint: str, keys: list[str], trigger: dict | None = None, output: str = "append"):
    """Writes each micro-batch to an UpsertedTable at `path`; read_upserted() reads it."""

    def save(batch: DataFrame, number: int) -> None:
        UpsertedTable(batch.sparkSession, path, keys).add(batch, number)

    return sdf.writeStream.foreachBatch(save).outputMode(output).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_upserted(spark, path: str, keys: list[str]) -> DataFrame:
    return UpsertedTable(spark, path, keys).read()

"""Queries: streams of the given tables, played to their end, and what sources write and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import io as IO
from ..streaming import jobs as J
from . import stand_ins as A
from .register import Register, rounded

REGISTER = query = Register()
DAY = 86_400_000
MINUTE = 60_000


def _stream(spark, sf_dir: str) -> DataFrame:
    """The events as a stream of files, with the same columns as the sensor rows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    return A.as_events(rows)


def _played(stream: DataFrame) -> DataFrame:
    """All that the stream emits once its input is read: rows of windows that the watermark has passed."""
    spark, folder = stream.sparkSession, IO.shared_folder(stream.sparkSession, "stream")
    writer = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"""WITH {A.EVENTS}, c AS (SELECT device_id, timestamp, value, timestamp // {DAY} * {DAY} AS chunk_start_ms, timestamp - lag(timestamp) OVER (PARTITION BY device_id, timestamp // {DAY} ORDER BY timestamp, value) AS step, quantile_cont(value, 0.5) OVER (PARTITION BY device_id, timestamp // {DAY}) AS mid FROM e),
    d AS (SELECT *, CASE WHEN step > 0 THEN step / 1000 END AS gap, abs(value - mid) AS dyn FROM c)
    SELECT device_id, chunk_start_ms, count(*) AS sample_count, round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS sd_value, round(min(mid), 6) AS median_value, min(timestamp) AS first_ms, max(timestamp) AS last_ms, round(quantile_cont(gap, 0.5), 6) AS median_interval_s, round(max(gap), 6) AS max_gap_s,
        CAST(coalesce(count_if(gap > 1), 0) AS INTEGER) AS gaps_over_1s, round(coalesce(sum(CASE WHEN gap > 1 THEN gap END), 0) / 86400, 11) AS gap_burden, round(avg(dyn), 6) AS dynamic_mean, round(quantile_cont(dyn, 0.5), 6) AS dynamic_median, round(count_if(dyn >= 0.75) / count(*), 6) AS high_motion_fraction
    FROM d WHERE chunk_start_ms + {DAY} <= (SELECT max(timestamp) FROM e) - {10 * MINUTE} GROUP BY ALL""")
def stream_chunk_stats(spark, sf_dir):
    """Chunks of a day, as the given events are far apart."""
    out = _played(J.stream_chunk_stats(_stream(spark, sf_dir), chunk="1 day"))
    out = rounded(out, "mean_value", "sd_value", "median_value", "median_interval_s", "max_gap_s", "dynamic_mean", "dynamic_median", "high_motion_fraction")
    return rounded(out, "gap_burden", digits=11)


@query(f"WITH {A.EVENTS} SELECT DISTINCT device_id, table_name, timestamp // {DAY} AS day FROM e")
def stream_dedupe(spark, sf_dir):
    """A row for each device, table and day: the others are duplicates within a watermark of 40 days."""
    rows = _stream(spark, sf_dir).withColumn("day", F.floor(F.col("timestamp") / DAY).cast("long"))
    return _played(J.stream_dedupe(rows, "40 days", ["device_id", "table_name", "day"]).select("device_id", "table_name", "day"))


@query(f"""WITH {A.EVENTS}, g AS (SELECT device_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER w < {12 * 60 * MINUTE} THEN 0 ELSE 1 END AS cut FROM e WINDOW w AS (PARTITION BY device_id ORDER BY timestamp)), s AS (SELECT *, sum(cut) OVER (PARTITION BY device_id ORDER BY timestamp RANGE UNBOUNDED PRECEDING) AS burst FROM g)
    SELECT device_id, min(timestamp) AS first_ms, max(timestamp) AS last_ms, count(*) AS n_events FROM s GROUP BY device_id, burst HAVING max(timestamp) + {12 * 60 * MINUTE} <= (SELECT max(timestamp) FROM e) - {10 * MINUTE}""")
def stream_bursts(spark, sf_dir):
    """Bursts that a pause of twelve hours ends."""
    return _played(J.stream_bursts(_stream(spark, sf_dir), gap="12 hours"))


@query(f"""WITH {A.EVENTS}, p AS (SELECT device_id, timestamp, _id % 4 AS st FROM e), q AS (SELECT *, coalesce(sum(CASE WHEN st IN (0, 2) THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY timestamp, st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sess FROM p),
    g AS (SELECT device_id, sess, max(CASE WHEN st = 3 THEN timestamp END) AS s, max(CASE WHEN st IN (0, 2) THEN timestamp END) AS e FROM q GROUP BY ALL)
    SELECT device_id, s AS start_ms, e AS end_ms, round((e - s) / 1000, 3) AS seconds FROM g WHERE s IS NOT NULL AND e IS NOT NULL""")
def stream_unlock_sessions(spark, sf_dir):
    rows = _stream(spark, sf_dir).withColumn("data", A.payload(screen_status=(F.col("_id") % 4).cast("string")))
    return rounded(_played(J.stream_unlock_sessions(rows)), "seconds", digits=3)


@query(f"""WITH {A.EVENTS}, w AS (SELECT device_id, unnest([timestamp // {6 * 60 * MINUTE} * {6 * 60 * MINUTE}, timestamp // {6 * 60 * MINUTE} * {6 * 60 * MINUTE} - {6 * 60 * MINUTE}]) AS start_ms FROM e)
    SELECT device_id, start_ms, start_ms + {12 * 60 * MINUTE} AS end_ms, count(*) AS n_events FROM w WHERE start_ms + {12 * 60 * MINUTE} <= (SELECT max(timestamp) FROM e) - {10 * MINUTE} GROUP BY ALL""")
def stream_sliding_counts(spark, sf_dir):
    return _played(J.stream_sliding_counts(_stream(spark, sf_dir), "12 hours", "6 hours"))


@query(f"{A.ALL} SELECT e._id, coalesce(d.subject_id, 'NOT_MAPPED') AS subject_id, w.window_rule FROM e JOIN (SELECT * FROM dev WHERE right(device_id, 1) <> '7') d USING (device_id) JOIN (SELECT DISTINCT subject_id, window_rule, start_ms, end_ms FROM win) w ON w.subject_id = d.subject_id AND timestamp >= start_ms AND timestamp < end_ms")
def stream_enrich(spark, sf_dir):
    e = A.events(spark, sf_dir)
    names = A.devices(e).where("substring(device_id, -1) <> '7'")
    win = A.windows(e).select("subject_id", "window_rule", "start_ms", "end_ms").distinct()
    return _played(J.stream_enrich(_stream(spark, sf_dir).drop("subject_id"), names, win).select("_id", "subject_id", "window_rule"))


@query(f"WITH {A.EVENTS} SELECT device_id, table_name, max(value) AS value FROM e GROUP BY ALL")
def stream_upsert(spark, sf_dir):
    """The largest value of each device and table, kept up to date by key; a second start finds nothing new."""
    folder = IO.shared_folder(spark, "stream")
    rows = _stream(spark, sf_dir).groupBy("device_id", "table_name").agg(F.max("value").alias("value"))
    for _ in range(2):
        J.stream_upsert(rows, f"{folder}/out", f"{folder}/checkpoint", ["device_id", "table_name"], output="update").awaitTermination()
    return J.read_upserted(spark, f"{folder}/out", ["device_id", "table_name"]).select("device_id", "table_name", "value")


# ------------------------------------------------------------------------------------------------------ sources


@query(f"""WITH {A.EVENTS} SELECT device_id, table_name, count(*) AS n_rows, min(timestamp) AS first_ms, max(timestamp) AS last_ms FROM e
    WHERE timestamp >= {1_704_067_200_000 + 5 * DAY} AND timestamp < {1_704_067_200_000 + 20 * DAY} GROUP BY ALL""")
def stored_events(spark, sf_dir):
    """Fifteen days of the event store, summed up by device and table without a shuffle."""
    name = f"events_{uuid.uuid4().hex}"
    store = IO.EventStore(spark, name, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), IO.shared_folder(spark, name), days=7)
    store.add(A.raw(A.events(spark, sf_dir)))
    rows = store.events(1_704_067_200_000 + 5 * DAY, 1_704_067_200_000 + 20 * DAY)
    return rows.groupBy("device_id", "table_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min("timestamp").alias("first_ms"), F.max("timestamp").alias("last_ms"))


@query(f"WITH {A.EVENTS} SELECT _id, timestamp, device_id, table_name FROM e WHERE table_name = 'view'")
def lake_round_trip(spark, sf_dir):
    """Events written by table, and one table read back: only its partition is read."""
    path = IO.shared_folder(spark, "stream")
    IO.write_tables(A.raw(A.events(spark, sf_dir)), path, ["table_name"])
    return IO.read_events(spark, path, "view").select("_id", "timestamp", "device_id", "table_name")


@query(f"WITH {A.EVENTS} SELECT device_id, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT device_id, 1 AS n FROM e WHERE value > 50 UNION ALL SELECT device_id, 2 FROM e WHERE value > 100) GROUP BY 1")
def appended_records(spark, sf_dir):
    """Two runs appended to one table, one as parquet and one as lines of JSON, read back together."""
    e, path = A.events(spark, sf_dir), IO.shared_folder(spark, "stream")
    runs = [e.where("value > 50").select("device_id", F.lit(1).alias("n")), e.where("value > 100").select("device_id", F.lit(2).alias("n"))]
    IO.append_records(runs[0], f"{path}/parquet")
    IO.write_jsonl(runs[1], f"{path}/lines")
    both = spark.read.parquet(f"{path}/parquet").unionByName(spark.read.schema("device_id string, n int").json(f"{path}/lines"))
    return both.groupBy("device_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n").alias("n"))


@query(f"WITH {A.SIGNAL} SELECT _id, timestamp, device_id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM sig WHERE device_id = 'D00001' AND timestamp >= 788918400000 AND timestamp < 788918400000 + 700::BIGINT * {DAY}")
def export_signal(spark, sf_dir):
    """One device's signal over 700 days, as the operator exports it."""
    s = A.signal(spark, sf_dir).withColumn("data", A.payload(double_values_0=F.col("x"), double_values_1=F.col("y"), double_values_2=F.col("z")))
    return rounded(IO.export_signal(s.select("_id", "timestamp", "device_id", "data"), "D00001", 788_918_400_000, 700), "x", "y", "z")


# ---------------------------------------------------------------------------------------------- column functions


@query(f"""WITH {A.EVENTS}, k AS (SELECT _id, _id % 8 AS r, CAST(_id % 1500 AS VARCHAR) AS n FROM e)
    SELECT _id, CASE WHEN r = 0 THEN NULL WHEN r = 1 THEN NULL WHEN r = 2 AND length(n) < 3 THEN lpad(n, 3, '0') WHEN r = 2 THEN n WHEN r = 3 THEN 'S' || n ELSE CASE WHEN length(n) < 3 THEN lpad(n, 3, '0') ELSE n END END AS subject,
        CASE r WHEN 2 THEN CAST(n AS DOUBLE) WHEN 4 THEN CAST(n AS DOUBLE) WHEN 5 THEN CAST(n AS DOUBLE) WHEN 6 THEN CAST(n AS DOUBLE) WHEN 7 THEN CAST(n AS DOUBLE) END AS number, r = 0 AS yes FROM k""")
def parsed_values(spark, sf_dir):
    """Ids, numbers and yes-or-no texts, with blanks, null-like texts and letters among them."""
    n = (F.col("_id") % 1500).cast("string")
    r = F.col("_id") % 8
    text = F.when(r == 0, " NaN ").when(r == 1, "  ").when(r == 3, F.concat(F.lit("S"), n)).otherwise(F.concat(F.lit(" "), n, F.lit(" ")))
    e = A.events(spark, sf_dir).select("_id", text.alias("t"), F.when(r == 0, " Yes ").when(r == 1, None).otherwise("no").alias("b"))
    return e.select("_id", S.normalize_subject_id("t").alias("subject"), S.to_number("t").alias("number"), S.to_bool("b").alias("yes"))


@query(f"""WITH {A.EVENTS} SELECT _id, DATE '1899-12-30' + CAST(45000 + _id % 400 AS INTEGER) AS day, CASE WHEN _id % 3 = 0 THEN 'a' WHEN _id % 3 = 1 THEN 'b' END AS first, CASE WHEN _id % 2 = 0 THEN 'x[1]' ELSE '[' END AS inner FROM e""")
def sheet_values(spark, sf_dir):
    e = A.events(spark, sf_dir).select("_id", (45000 + F.col("_id") % 400).cast("string").alias("day"), F.when(F.col("_id") % 3 == 0, "a").otherwise("").alias("p"), F.when(F.col("_id") % 3 == 1, " b ").otherwise(" ").alias("q"), F.when(F.col("_id") % 2 == 0, "[x[1]]").otherwise("[").alias("t"))
    return e.select("_id", S.excel_date("day").alias("day"), S.first_text("p", "q").alias("first"), S.strip_brackets("t").alias("inner"))


@query(f"""WITH {A.EVENTS}, c AS (SELECT device_id, count_if(table_name = 'view') AS a, count_if(table_name = 'click') AS b, count_if(table_name = 'error') AS c FROM e GROUP BY 1), f AS (SELECT *, a + b + c AS t FROM c)
    SELECT device_id, CASE WHEN t > 0 THEN round(abs(-(CASE WHEN a > 0 THEN a / t * log2(a / t) ELSE 0 END + CASE WHEN b > 0 THEN b / t * log2(b / t) ELSE 0 END + CASE WHEN c > 0 THEN c / t * log2(c / t) ELSE 0 END)), 6) END AS entropy FROM f""")
def entropy_of_counts(spark, sf_dir):
    n = lambda t: F.count_if(F.col("table_name") == t).cast("double")
    e = A.events(spark, sf_dir).groupBy("device_id").agg(F.array(n("view"), n("click"), n("error")).alias("n"))
    return rounded(e.select("device_id", F.abs(S.entropy_of("n")).alias("entropy")), "entropy")


@query(f"""WITH {A.EVENTS}, p AS (SELECT _id, device_id, value - 60 AS lat, (_id * 37 % 300) - 150.0 AS lon, timestamp FROM e), h AS (SELECT *, pow(sin(radians(lat - 31.0) / 2), 2) + cos(radians(31.0)) * cos(radians(lat)) * pow(sin(radians(lon - 35.0) / 2), 2) AS h FROM p)
    SELECT _id, round(2 * 6371.0088 * asin(sqrt(least(1.0, h))), 3) AS km, CAST(make_timestamp((timestamp + {A.SHIFT}) * 1000) AS DATE) AS day, hour(make_timestamp((timestamp + {A.SHIFT}) * 1000)) >= 22 OR hour(make_timestamp((timestamp + {A.SHIFT}) * 1000)) < 6 AS night, round(h2, 6) AS bits FROM h, (SELECT 1.5 AS h2) WHERE lat BETWEEN -90 AND 90""")
def registered_functions(spark, sf_dir):
    """The functions under their SQL names."""
    S.register(spark)
    e = A.events(spark, sf_dir).withColumn("lat", F.col("value") - 60).withColumn("lon", F.col("_id") * 37 % 300 - 150.0).where("lat between -90 and 90")
    out = e.selectExpr("_id", "haversine_km(31.0D, 35.0D, lat, lon) AS km", f"local_day(timestamp, '{A.TZ}') AS day", f"night_flag(timestamp, '{A.TZ}') AS night", "shannon_entropy(array(2.0D, 1.0D, 1.0D)) AS bits")
    return rounded(rounded(out, "bits"), "km", digits=3)

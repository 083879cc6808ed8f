import json
import os

from pyspark.sql import functions as F

from cohortwire.streaming import jobs as J

SCHEMA = "_id long, timestamp long, device_id string, data string, value double"


def play(spark, tmp_path, batches, build, name, mode="append"):
    """Feeds batches as files, one micro-batch each, and returns the sink's rows."""
    folder = str(tmp_path / "in")
    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        part.write.mode("append").parquet(folder)
        del n
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = build(sdf).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    return spark.table(name).collect()


def row(i, ms, device="D1", status=None, value=1.0):
    return (i, ms, device, json.dumps({"screen_status": str(status)}), value)


def test_chunks_and_late_rows(spark, tmp_path):
    batches = [[row(i, i * 60_000) for i in range(30)], [row(98, 3_600_000)], [row(99, 1_000)], [row(100, 7_200_000)]]
    got = play(spark, tmp_path, batches, J.stream_chunk_stats, "chunks")
    first = {r.chunk_start_ms: r.sample_count for r in got}
    assert first[0] == 5, "the row at 1 s comes after the watermark has passed and is dropped"


def test_duplicates_go(spark, tmp_path):
    got = play(spark, tmp_path, [[row(1, 1000), row(2, 1000)], [row(3, 1000)], [row(4, 2000)]], J.stream_dedupe, "deduped")
    assert len(got) == 2


def test_bursts_split_after_thirty_seconds(spark, tmp_path):
    batches = [[row(1, 0), row(2, 30_000), row(3, 60_001)], [row(4, 10_000_000)], [row(5, 20_000_000)]]
    got = play(spark, tmp_path, batches, J.stream_bursts, "bursts")
    assert sorted(r.n_events for r in got if r.first_ms < 100_000) == [1, 2]


def test_sliding_counts(spark, tmp_path):
    got = play(spark, tmp_path, [[row(1, 0), row(2, 400_000)], [row(3, 10_000_000)], [row(4, 20_000_000)]], J.stream_sliding_counts, "sliding")
    assert {r.start_ms: r.n_events for r in got if r.start_ms < 1_000_000} == {-300_000: 1, 0: 2, 300_000: 1}


def test_unlock_session_spans_batches(spark, tmp_path):
    got = play(spark, tmp_path, [[row(1, 0, status=3), row(2, 1000, status=3)], [row(3, 5000, status=0)], [row(4, 6000, status=2)]], J.stream_unlock_sessions, "unlocks")
    assert [(r.start_ms, r.end_ms) for r in got] == [(1000, 5000)]


def test_enrich_and_upsert(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.createDataFrame([row(1, 10), row(2, 20, "D2")], SCHEMA).coalesce(1).write.parquet(folder)
    names = spark.createDataFrame([("D1", "S1")], "device_id string, subject_id string")
    sdf = J.stream_enrich(spark.readStream.schema(SCHEMA).parquet(folder), names)
    for _ in range(2):  # a second start finds nothing new
        J.stream_upsert(sdf, str(tmp_path / "out"), str(tmp_path / "ck"), ["_id"]).awaitTermination()
    got = J.read_upserted(spark, str(tmp_path / "out"), ["_id"])
    assert sorted((r["_id"], r.subject_id) for r in got.collect()) == [(1, "S1"), (2, "NOT_MAPPED")]
    assert got.select(F.count(F.lit(1))).first()[0] == 2

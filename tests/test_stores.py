"""The event store, upserted tables, day bitmaps and bounded examples."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from cohortwire.operators import discovery as D
from cohortwire.operators import presence as B
from cohortwire.sources import io as IO
from cohortwire.streaming import jobs as J

DAY = 86_400_000
EVENT = "_id long, timestamp long, device_id string, data string, table_name string"


def some_events(n=400, seed=1):
    rng = random.Random(seed)
    return [(i, rng.randint(0, 60 * DAY), rng.choice("abcdef"), "{}", rng.choice("xy")) for i in range(n)]


def test_event_store_needs_no_shuffle_by_device(spark):
    name = f"events_{uuid.uuid4().hex}"
    store = IO.EventStore(spark, name, 4, IO.shared_folder(spark, name), days=10)
    rows = some_events()
    store.add(spark.createDataFrame(rows[:200], EVENT))
    store.add(spark.createDataFrame(rows[200:], EVENT))
    got = store.events(15 * DAY, 40 * DAY)
    want = {r[0] for r in rows if 15 * DAY <= r[1] < 40 * DAY}
    assert {r._id for r in got.collect()} == want
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counted = got.groupBy("device_id", "table_name").agg(F.count(F.lit(1)).alias("n"))
    assert "Exchange" not in plan(counted) and sum(r.n for r in counted.collect()) == len(want)
    joined = got.join(got.groupBy("device_id").agg(F.min("timestamp").alias("first_ms")).hint("merge"), "device_id")
    assert "Exchange hashpartitioning" not in plan(joined) and joined.count() == len(want)
    assert "PartitionFilters: [isnotnull(period" in plan(got)
    assert {r._id for r in store.events().collect()} == {r[0] for r in rows}
    store.drop()


def upserted(spark, tmp_path):
    return J.UpsertedTable(spark, str(tmp_path / "table"), ["k"])


def test_upserts_keep_the_last_row_and_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(J, "COMPACT_AFTER", 3)
    table, want = upserted(spark, tmp_path), {}
    with pytest.raises(FileNotFoundError):
        table.read()
    for number in range(9):
        rows = [(k, number * 10 + k) for k in range(number % 3, 6, 2)]
        want |= {k: (v, number) for k, v in rows}
        table.add(spark.createDataFrame(rows, "k int, v int"), number)
        assert {r.k: (r.v, r.batch) for r in table.read().collect()} == want
        assert len(table.live(table.versions()[-1])) <= 3
    folders = {p.name for p in (tmp_path / "table").iterdir() if p.name != "manifest"}
    assert len(table.versions()) == J.KEPT_VERSIONS and folders == {n for v in table.versions() for n in table.live(v)}
    earlier = {r.k: r.v for r in table.read(7).collect()}
    assert earlier != {k: v for k, (v, _) in want.items()} and max(earlier.values()) < 80


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    table = upserted(spark, tmp_path)
    table.add(spark.createDataFrame([(1, 1), (2, 1)], "k int, v int"), 0)
    table.add(spark.createDataFrame([(1, 2)], "k int, v int"), 1)
    table.add(spark.createDataFrame([(1, 99)], "k int, v int"), 1)
    assert {r.k: r.v for r in table.read().collect()} == {1: 2, 2: 1}


def test_a_broken_batch_is_not_seen(spark, tmp_path):
    """Rows without a manifest, as a lost driver leaves them, are no part of the table; the next try replaces them."""
    table = upserted(spark, tmp_path)
    table.add(spark.createDataFrame([(1, 1)], "k int, v int"), 0)
    spark.createDataFrame([(1, 99, 1)], "k int, v int, batch long").write.parquet(str(tmp_path / "table" / "batch-000000000001"))
    assert table.read().first()["v"] == 1
    table.add(spark.createDataFrame([(1, 2)], "k int, v int"), 1)
    assert [(r.k, r.v) for r in table.read().collect()] == [(1, 2)]


@pytest.mark.parametrize("tz", [None, "Asia/Jerusalem"])
def test_bitmaps_hold_the_days(spark, tz):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.choice([-3, 0, 1, 7, 8, 9, 19_700, 32_768, 32_769, 40_000]) * DAY + rng.randint(0, DAY - 1)) for _ in range(200)] + [("n", None)]
    ev = spark.createDataFrame(rows, "device_id string, timestamp long").repartition(4)
    day = F.date_from_unix_date(F.floor(F.col("timestamp") / DAY).cast("int")) if tz is None else F.to_date(F.from_utc_timestamp(F.timestamp_millis("timestamp"), tz))
    want = {tuple(r) for r in ev.where("timestamp is not null").select("device_id", day).distinct().collect()}
    bitmaps = B.day_bitmaps(ev, tz=tz)
    got = [tuple(r) for r in B.days_of(bitmaps).collect()]
    assert set(got) == want and len(got) == len(want)
    counts = {r.device_id: r.n_days for r in B.day_counts(bitmaps).collect()}
    assert counts == {d: sum(x == d for x, _ in want) for d in "abc"}


def test_new_days_are_merged_and_sets_compared(spark):
    frame = lambda days: spark.createDataFrame([("a", d * DAY) for d in days], "device_id string, timestamp long")
    a, b = B.day_bitmaps(frame([1, 2, 3, 40_000])), B.day_bitmaps(frame([3, 4]).unionByName(frame([5]).withColumn("device_id", F.lit("z"))))
    assert {(r.device_id, r.n_days, r.first_day, r.last_day) for r in B.day_counts(B.merged_days(a, b)).collect()} == {("a", 5, 1, 40_000), ("z", 1, 5, 5)}
    assert {tuple(r) for r in B.compared_days(a, b).collect()} == {("a", 4, 2, 1, 3, 1), ("z", 0, 1, 0, 0, 1)}


def test_smallest_distinct_values(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["t", None]), rng.choice("kl"), rng.choice([None, "é", "z", "", *map(str, range(40))]), rng.choice(["integer", "string"])) for _ in range(600)]
    df = spark.createDataFrame(rows, "table_name string, key string, value string, type string").repartition(7)
    got = {}
    for r in D.smallest_distinct(df, ["table_name", "key"], ["value", "type"], 6).collect():
        got.setdefault((r.table_name, r.key), set()).add((r.value, r.type))
    for group in {r[:2] for r in rows}:
        own = sorted({r[2:] for r in rows if r[:2] == group}, key=lambda v: (v[0] is not None, v[0] or "", v[1]))
        assert got[group] == set(own[:6])

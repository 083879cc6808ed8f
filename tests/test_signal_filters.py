"""Block filters and series cut into pieces against sample-by-sample loops and whole series."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortwire.functions import numeric as N
from cohortwire.operators import signal as G


def loop(b, a, x):
    """One section, sample by sample, from the steady state of the first value."""
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    gain = b.sum() / a.sum()
    state = [(b[k + 1 :].sum() - a[k + 1 :].sum() * gain) * x[0] for k in range(n - 1)] + [0.0]
    out = []
    for v in x:
        y = b[0] * v + state[0]
        state = [b[k + 1] * v - a[k + 1] * y + state[k + 1] for k in range(n - 1)] + [0.0]
        out.append(y)
    return np.array(out)


def looped_zero_phase(sections, x):
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            y = loop(b, a, y)
        y = y[::-1]
    return y[pad : len(y) - pad]


FILTERS = [(2, (0.05,), 1.0), (4, (0.5, 5.0), 50.0), (4, (0.3, 8.0), 100.0), (3, (1.0,), 20.0), (1, (0.1,), 1.0)]


@pytest.mark.parametrize("order,edges,fs", FILTERS)
@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 5000])
def test_blocks_equal_the_loop(order, edges, fs, n):
    x = 9.8 + np.random.default_rng(n).normal(size=n)
    for b, a in N.butterworth(order, edges, fs):
        want = loop(b, a, x)
        assert np.abs(N.filtered(b, a, x) - want).max() <= 1e-9 * max(1, np.abs(want).max())
    want = looped_zero_phase(N.butterworth(order, edges, fs), x - x.mean())
    assert np.abs(N.zero_phase(N.butterworth(order, edges, fs), x - x.mean()) - want).max() < 1e-9


def test_ten_million_samples_take_seconds():
    x = np.random.default_rng(1).normal(size=10_000_000)
    sections = N.butterworth(4, (0.5, 5.0), 50.0)
    start = time.perf_counter()
    y = N.zero_phase(sections, x)
    assert time.perf_counter() - start < 10
    assert np.abs(y[:20_000] - looped_zero_phase(sections, x[:30_000])[:20_000]).max() < 1e-9


def test_pieces_with_halos_equal_the_whole():
    sections = N.butterworth(4, (0.3, 8.0), 50.0)
    halo = N.memory_of(sections)
    x = 9.8 + np.random.default_rng(2).normal(size=40_000)
    whole = N.zero_phase(sections, x)
    for begin, stop in ((0, 10_000), (10_000, 30_000), (30_000, 40_000)):
        low, high = max(0, begin - halo), min(len(x), stop + halo)
        own = N.zero_phase(sections, x[low:high], low == 0, high == len(x))
        assert np.abs(own[begin - low : stop - low] - whole[begin:stop]).max() < 1e-9


@pytest.mark.parametrize("piece", [1, 3000, 10**6])
def test_windows_of_pieces_equal_those_of_the_series(spark, piece):
    rng = np.random.default_rng(3)
    series = {}
    for device, n, ms in (("a", 9000, 20), ("b", 4000, 100), ("c", 30, 20), ("d", 1, 20), ("e", 500, 1000), ("f", 60, 9000)):
        t = 1_700_000_000_123 + np.cumsum(rng.choice([ms, ms, ms, ms + 1, 0, 40 * ms], n))
        series[device] = (t, 9.8 + rng.normal(size=n))
    rows = [(d, int(t), float(x), i) for d, (ts, xs) in series.items() for i, (t, x) in enumerate(zip(ts, xs))]
    rng.shuffle(rows)
    frame = pd.DataFrame(rows, columns=["device_id", "timestamp", "magnitude", "n"]).astype({"timestamp": "int64", "magnitude": float, "n": "int64"})
    ev = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", 5, None, 1), (None, 5, 1.0, 1)], "device_id string, timestamp long, magnitude double, n long")).repartition(5)
    got = G.sliding_power(ev, piece=piece).toPandas()
    for device, (t, x) in series.items():
        want = G.window_powers(t, x, G.SLIDING_BANDS).melt(["first_ms"], list(G.SLIDING_BANDS), "band", "power")
        own = got[got.device_id == device].sort_values(["band", "first_ms"], kind="stable")
        want = want.sort_values(["band", "first_ms"], kind="stable")
        assert own[["band", "first_ms"]].values.tolist() == want[["band", "first_ms"]].values.tolist()
        assert np.allclose(own["power"], want["power"], rtol=1e-8, atol=1e-12)
    assert len(got) and set(got["day"]) == {1}


def test_samples_are_numbered_across_stretches(spark):
    rng = np.random.default_rng(4)
    t = np.sort(rng.integers(0, 5 * G.NUMBERED_MS, 300))
    rows = [("a", int(x), float(i % 7), 0) for i, x in enumerate(t)] + [("b", 3 * G.NUMBERED_MS, 1.0, 0)]
    got = G.numbered_samples(spark.createDataFrame(rows, "device_id string, timestamp long, magnitude double, t0 long").repartition(4))
    a = got.filter("device_id = 'a'").orderBy("place").collect()
    assert [r.place for r in a] == list(range(300)) and [r.timestamp for r in a] == t.tolist()
    assert [r.step_ms for r in a] == [None, *np.diff(t).tolist()] and {r.n for r in a} == {300}
    assert got.filter("device_id = 'b' and place = 0 and n = 1 and step_ms is null").count() == 1


def test_hits_equal_a_loop():
    rng = np.random.default_rng(6)
    for size in (0, 1, 50, 20_000):
        seconds = np.cumsum(rng.integers(1, 4, size)).astype(float)
        elevation = np.cumsum(rng.normal(size=size) * 0.4)
        want, anchor, last = [], 0, None
        for i in range(1, size):
            change = elevation[i] - elevation[anchor]
            if abs(change) >= 3 and seconds[i] - seconds[anchor] >= 10 and (last is None or seconds[i] - last >= 30):
                want.append((i, float(change)))
                anchor, last = i, seconds[i]
        assert N.elevation_hits(seconds, elevation) == want
        assert size < 100 or want


def test_pressure_is_smoothed_from_seconds(spark):
    """Means of a time, then medians of a second, then gaps, medians and filter: as for the raw rows in one frame."""
    rng = np.random.default_rng(7)
    ms = np.sort(rng.integers(0, 90_000, 900)) // 50 * 50
    ms = np.concatenate([ms, [200_000, 200_100]])
    p = 1000 + np.round(rng.normal(size=len(ms)), 3)
    rows = [("s", "barometer", "w", "d", int(t), f'{{"double_values_0": {x}}}') for t, x in zip(ms, p)]
    we = spark.createDataFrame(rows, "subject_id string, table_name string, window_rule string, device_id string, timestamp long, data string").repartition(3)
    got = G.barometer_signal(we).orderBy("second").collect()
    frame = pd.Series(p).groupby(ms).mean()
    seconds = frame.groupby(frame.index // 1000).median()
    at, want = G.smoothed_pressure(seconds.index.to_numpy(), seconds.to_numpy())
    assert [r.second for r in got] == at.tolist() and 60 < len(at) < 120
    assert np.allclose([r.pressure for r in got], want) and np.allclose([r.elevation_m for r in got], -8.3 * (want - want[0]))


def test_day_power_of_chunks(spark):
    t = np.arange(0, 120_000, 20)
    x = 9.8 + np.sin(2 * np.pi * 2 * t / 1000)
    ev = spark.createDataFrame(pd.DataFrame({"device_id": "a", "timestamp": t, "magnitude": x}))
    got = G.daily_band_power(ev, tz="UTC", minutes=1).first()
    assert got["n_samples"] == len(t) and abs(got["band_power"] - 0.5) < 0.02
    assert ev.agg(F.count("magnitude")).first()[0] == len(t)


def test_short_series_share_a_filters_matrices():
    """Thousands of devices of one rate have the matrices of four sections made once, not for each of them."""
    rng = np.random.default_rng(3)
    N._block_matrices.cache_clear()
    for _ in range(50):
        N.zero_phase(N.butterworth(4, (0.5, 5.0), 20.0), rng.normal(size=300))
    assert N._block_matrices.cache_info().misses == 4


def test_groups_are_whole_whatever_the_batches(spark):
    """Many groups to a batch and a group over many batches, null keys and groups that give nothing included."""
    from cohortwire.operators.series import over_groups

    rows = [(f"k{i % 7}" if i % 7 else None, i % 3, i, float(i)) for i in range(500)] + [("long", 0, i, 1.0) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b int, t long, x double").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        one = lambda key, c: None if key[1] == 2 else {"n": np.array([len(c["t"])]), "s": np.array([(c["x"] * np.arange(len(c["t"]))).sum()])}
        got = {(r.a, r.b): (r.n, r.s) for r in over_groups(df, ["a", "b"], one, {"n": "long", "s": "double"}, ["t"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for a, b, _, x in rows:
        want.setdefault((a, b), []).append(x)
    assert got == {k: (len(v), sum(i * x for i, x in enumerate(v))) for k, v in want.items() if k[1] != 2}


def test_tasks_of_chunk_statistics_follow_the_samples(spark, monkeypatch):
    """6,000 samples at 500 a task are dealt over 12 tasks, and no window sorts a device's samples for its first."""
    from cohortwire.plans import query_features as Q

    monkeypatch.setattr(Q, "_TASK_ROWS", 500)
    stats = Q._stats(spark, "/root/testdata/sf0.001")
    plan = stats._jdf.queryExecution().executedPlan().toString()
    samples = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert f"{-(-samples // 500)}), REPARTITION_BY_NUM" in plan
    assert "windowspecdefinition(device_id" not in plan


def test_sliding_power_numbers_its_samples_once(spark):
    """Rates and windows both read the numbered samples, which were derived anew for each."""
    rows = spark.createDataFrame([("d", 50 * i, float(i % 7)) for i in range(400)], "device_id string, timestamp long, magnitude double")
    plan = G.sliding_power(rows)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan

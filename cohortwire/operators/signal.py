"""High-rate signals: duplicates, chunks of five minutes, spectra, states, days, and the barometer.

Input is the output of range_join with x, y, z (signal_axes) and start_ms, end_ms of the window.  The key
(device_id, chunk_index) deals even one device's rows over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import scalars as S
from ..sources.io import intermediate
from .features import KEY
from .series import over_groups

#: Frequency bands in Hz, low <= f < high, cut at half the resampling rate.
BANDS = {
    "very_low_lt_0_3hz": (0.0, 0.3),
    "handling_0_3_1hz": (0.3, 1.0),
    "walking_like_1_3hz": (1.0, 3.0),
    "vigorous_2_5_4hz": (2.5, 4.0),
    "shaking_like_3_8hz": (3.0, 8.0),
    "high_freq_8_12hz": (8.0, 12.0),
}
#: Thresholds of the dynamic magnitude and of a band's share of the power.
STILL, HANDLING, HIGH_MOTION, BAND_SHARE = 0.10, 0.20, 0.75, 0.35
RESAMPLE_HZ = 10.0
CHUNK_KEY = ["subject_id", "device_id", "chunk_index"]


def signal_axes(we: DataFrame) -> DataFrame:
    axes = {n: S.json_field("data", f"$.double_values_{i}", "double") for i, n in enumerate("xyz")}
    return we.withColumns(axes).where("x is not null and y is not null and z is not null").withColumn("magnitude", S.magnitude())


def dedupe_signal(we: DataFrame) -> DataFrame:
    """One row of each (device, timestamp, x, y, z), with duplicates: how many more there were."""
    key = ["device_id", "timestamp", "x", "y", "z"]
    rest = [c for c in we.columns if c not in key]
    return we.groupBy(*key).agg(*[F.min(c).alias(c) for c in rest], (F.count(F.lit(1)) - 1).alias("duplicates"))


def assign_chunks(we: DataFrame, minutes: int = 5) -> DataFrame:
    """chunk_index: tumbling chunks that start with the window, not with the epoch."""
    return we.withColumn("chunk_index", F.floor((F.col("timestamp") - F.col("start_ms")) / (minutes * 60_000)).cast("int"))


def chunk_grid(win: DataFrame, minutes: int = 5) -> DataFrame:
    last = F.ceil((F.col("end_ms") - F.col("start_ms")) / (minutes * 60_000)).cast("int") - 1
    return win.select("subject_id", "device_id", "start_ms", F.explode(F.sequence(F.lit(0), last)).alias("chunk_index"))


def chunk_stats(chunks: DataFrame, win: DataFrame | None = None, minutes: int = 5, tz: str = S.DEFAULT_TZ) -> DataFrame:
    """Statistics of each chunk; with win, chunks without rows are kept as `no_rows`.

    Intervals are the positive ones; gap_burden is the time in gaps of over a second as a share of the chunk's length.
    """
    w = Window.partitionBy(*CHUNK_KEY).orderBy("timestamp", "_id")
    gap = (F.col("timestamp") - F.lag("timestamp").over(w)) / 1000.0
    rows = chunks.withColumn("gap_s", F.when(gap > 0, gap))
    rows = rows.withColumn("base", F.percentile("magnitude", F.lit(0.5)).over(Window.partitionBy(*CHUNK_KEY)))
    rows = rows.withColumn("dynamic", F.abs(F.col("magnitude") - F.col("base")))
    gap, dyn = F.col("gap_s"), F.col("dynamic")
    out = rows.groupBy(*CHUNK_KEY).agg(
        F.min("start_ms").alias("start_ms"), F.count(F.lit(1)).alias("sample_count"), ((F.max("timestamp") - F.min("timestamp")) / 1000.0).alias("span_s"),
        S.percentile(gap, 0.5).alias("median_interval_s"), S.percentile(gap, 0.95).alias("p95_interval_s"), F.max(gap).alias("max_gap_s"), F.count_if(gap > 1).alias("gaps_over_1s"),
        (F.coalesce(F.sum(F.when(gap > 1, gap)), F.lit(0.0)) / (60.0 * minutes)).alias("gap_burden"), F.min("base").alias("median_magnitude"), F.avg(dyn).alias("dynamic_mean"),
        S.percentile(dyn, 0.5).alias("dynamic_median"), F.stddev_pop(dyn).alias("dynamic_sd"), (F.count_if(dyn >= HIGH_MOTION) / F.count(F.lit(1))).alias("high_motion_fraction"),
    )
    if win is not None:
        out = chunk_grid(win, minutes).join(out.drop("start_ms"), CHUNK_KEY, "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    status = F.when(F.col("sample_count") == 0, "no_rows").when(F.col("sample_count") < 100, "too_few_samples").otherwise("ok")
    at = F.col("start_ms") + F.col("chunk_index").cast("long") * minutes * 60_000
    return out.withColumn("chunk_start_ms", at).withColumn("status", status).withColumn("night", S.is_night("chunk_start_ms", tz)).withColumn("local_hour", S.local_hour("chunk_start_ms", tz))


def spectrum_of(ms: np.ndarray, magnitude: np.ndarray, hz: float = RESAMPLE_HZ, minutes: int = 5) -> dict[str, float] | None:
    """Band powers of the rectified deviation from the median: means of slots of 1 / hz that start at whole slots of the
    clock, interpolated, detrended, Welch over segments of a minute.  None if a gate fails: 100 samples, 30 s from first
    to last, gaps of over a second for half of the chunk at most, 30 s of slots."""
    if len(ms) < 100 or (ms.max() - ms.min()) < 30_000:
        return None
    gaps = np.diff(np.sort(ms)) / 1000.0
    if gaps[gaps > 1].sum() > 0.5 * 60 * minutes:
        return None
    dynamic = np.abs(magnitude - np.median(magnitude))
    slot = ms // int(1000 / hz)
    step = (slot - slot.min()).astype(np.int64)
    n = int(step.max()) + 1
    if n < int(30 * hz):
        return None
    count = np.bincount(step, minlength=n)
    mean = np.bincount(step, weights=dynamic, minlength=n) / np.maximum(count, 1)
    there = np.flatnonzero(count)
    series = N.detrended(np.interp(np.arange(n), there, mean[there]))
    f, p = N.welch(series, hz, min(n, int(60 * hz)))
    total = N.trapezoid(p[1:], f[1:])
    out = {"total_power": total, "dominant_hz": float(f[1:][p[1:].argmax()])}
    for name, (low, high) in BANDS.items():
        inside = (f >= low) & (f < min(high, hz / 2))
        power = N.trapezoid(p[inside], f[inside]) if low < hz / 2 and inside.any() else None
        out[f"power_{name}"] = power
        out[f"ratio_{name}"] = power / total if power is not None and total > 0 else None
    return out


SPECTRUM = ["total_power", "dominant_hz", *[f"{k}_{b}" for b in BANDS for k in ("power", "ratio")]]


def chunk_spectrum(chunks: DataFrame, hz: float = 10) -> DataFrame:
    """A row of spectral features per chunk that passes the gates (100 samples, 30 s, gap burden 0.5)."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = spectrum_of(pdf["timestamp"].to_numpy(), pdf["magnitude"].to_numpy(), hz)
        return pd.DataFrame([] if found is None else [(*key, *[found[c] for c in SPECTRUM])], columns=[*CHUNK_KEY, *SPECTRUM])

    schema = "subject_id string, device_id string, chunk_index int, " + ", ".join(f"{c} double" for c in SPECTRUM)
    return chunks.select(*CHUNK_KEY, "timestamp", "magnitude").groupBy(*CHUNK_KEY).applyInPandas(one, schema)


STATES = {
    "insufficient": "insufficient_signal", "fragmented": "fragmented_signal", "still": "still_phone_candidate", "walking": "walking_like_phone_motion_candidate",
    "shaking": "shaking_like_phone_motion_candidate", "handling": "phone_handling_motion_candidate", "low_motion": "low_motion_phone_candidate",
}


def _ratio(stats: DataFrame, band: str):
    return F.col(f"ratio_{band}") if f"ratio_{band}" in stats.columns else F.lit(None).cast("double")


def chunk_state(stats: DataFrame) -> DataFrame:
    """state: the first of STATES, in that order, that holds.  Without a spectrum no chunk is walking or shaking."""
    median = F.col("dynamic_median")
    dominant = F.col("dominant_hz") if "dominant_hz" in stats.columns else F.lit(None).cast("double")

    def rhythm(band):
        low, high = BANDS[band]
        return (_ratio(stats, band) >= BAND_SHARE) & (dominant >= low) & (dominant < high)

    state = (
        F.when(F.col("sample_count") < 100, STATES["insufficient"])
        .when(F.col("gap_burden") > 0.5, STATES["fragmented"])
        .when(median <= STILL, STATES["still"])
        .when(rhythm("walking_like_1_3hz"), STATES["walking"])
        .when(rhythm("shaking_like_3_8hz"), STATES["shaking"])
        .when(median >= HANDLING, STATES["handling"])
        .otherwise(STATES["low_motion"])
    )
    return stats.withColumn("state", state)


def movement_summary(stats: DataFrame, minutes: int = 5) -> DataFrame:
    """Minutes per state, stillness share, day and night motion, hourly motion entropy and means, all over the chunks
    whose status is ok; a chunk moves if its median dynamic magnitude reaches the handling threshold."""
    ok = stats.filter(F.col("status") == "ok")
    moving = F.col("dynamic_median") >= HANDLING
    day = minutes * F.count_if(moving & ~F.col("night"))
    night = minutes * F.count_if(moving & F.col("night"))
    in_state = lambda s: F.count_if(F.col("state") == STATES[s])
    tremor = F.col("power_shaking_like_3_8hz") if "power_shaking_like_3_8hz" in stats.columns else F.lit(None).cast("double")
    base = ok.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("valid_chunks"), (minutes * F.count(F.lit(1))).alias("valid_minutes"), S.percentile("median_interval_s", 0.5).alias("median_interval_s"),
        *[(minutes * in_state(s)).alias(f"{s}_minutes") for s in ("still", "handling", "walking", "shaking")], (in_state("still") / F.count(F.lit(1))).alias("stillness_fraction"),
        F.avg("gap_burden").alias("gap_burden"), F.avg("dynamic_mean").alias("dynamic_mean"), F.avg("dynamic_sd").alias("dynamic_sd"), F.avg("high_motion_fraction").alias("high_motion_fraction"),
        F.avg(tremor).alias("tremor_power_mean"), day.alias("day_motion_minutes"), night.alias("night_motion_minutes"), F.when(night > 0, day / night).alias("day_night_ratio"),
    )
    hours = ok.filter(moving).groupBy("subject_id", "local_hour").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    entropy = hours.groupBy("subject_id").agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("hourly_motion_entropy"))
    return base.join(entropy, "subject_id", "left")


def hourly_summary(stats: DataFrame, minutes: int = 5) -> DataFrame:
    ok = F.col("status") == "ok"
    return stats.groupBy("subject_id", "local_hour").agg(
        F.count_if(ok).alias("valid_chunks"), S.percentile(F.when(ok, F.col("dynamic_median")), 0.5).alias("median_dynamic"), F.avg(F.when(ok, F.col("dynamic_mean"))).alias("mean_dynamic"),
        F.avg(F.when(ok, F.col("high_motion_fraction"))).alias("mean_high_motion"), *[(minutes * F.count_if(ok & (F.col("state") == STATES[s]))).alias(f"{s}_minutes") for s in ("walking", "shaking")],
    )


def state_summary(stats: DataFrame, minutes: int = 5) -> DataFrame:
    return stats.groupBy("subject_id", "state").agg(F.count(F.lit(1)).alias("chunks"), (minutes * F.count(F.lit(1))).alias("minutes"))


def threshold_sensitivity(stats: DataFrame, thresholds=(0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.75, 1.0), minutes: int = 5) -> DataFrame:
    """Active chunks, minutes and their share by threshold, by the chunks' median and mean, and day and night minutes by
    the median."""
    rows = stats.where("status = 'ok'").withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    out = []
    for m in ("median", "mean"):
        active = F.count_if(F.col(f"dynamic_{m}") >= F.col("threshold"))
        out += [active.alias(f"chunks_by_{m}"), (minutes * active).alias(f"minutes_by_{m}"), (active / F.count(F.lit(1))).alias(f"fraction_by_{m}")]
    by_median = F.col("dynamic_median") >= F.col("threshold")
    out += [(minutes * F.count_if(by_median & side)).alias(f"{name}_minutes_by_median") for name, side in (("day", ~F.col("night")), ("night", F.col("night")))]
    return rows.groupBy("subject_id", "threshold").agg(*out)


def with_band_gates(chunks: DataFrame) -> DataFrame:
    """A row per ok chunk and band: power, ratio, feasible (the sampling, and the resampling, reach the band's end) and
    selected (feasible, enough motion by the mean, and the band is the first of largest ratio, with enough of it)."""
    ok = chunks.where("status = 'ok'")
    top = F.greatest(*[F.col(f"ratio_{b}") for b in BANDS])
    first = F.coalesce(*[F.when(F.col(f"ratio_{b}") == top, F.lit(b)) for b in BANDS])
    rows = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(high).alias("high_hz"), F.col(f"power_{b}").alias("power"), F.col(f"ratio_{b}").alias("ratio")) for b, (_, high) in BANDS.items()])
    rows = ok.withColumn("dominant_band", first).select("subject_id", "local_hour", "night", "median_interval_s", "dynamic_mean", "dynamic_median", "dominant_band", F.explode(rows).alias("b"))
    rows = rows.select("subject_id", "local_hour", "night", "dynamic_mean", "dynamic_median", "dominant_band", "median_interval_s", "b.*")
    feasible = F.col("dominant_band").isNotNull() & (0.5 / F.col("median_interval_s") >= F.col("high_hz")) & (F.lit(RESAMPLE_HZ / 2) >= F.col("high_hz"))
    rows = rows.withColumn("feasible", F.coalesce(feasible, F.lit(False)))
    selected = F.col("feasible") & (F.col("dynamic_mean") >= HANDLING) & (F.col("dominant_band") == F.col("band")) & (F.col("ratio") >= BAND_SHARE)
    return rows.withColumn("selected", F.coalesce(selected, F.lit(False)))


def band_summary(chunks: DataFrame, minutes: int = 5) -> DataFrame:
    """By subject and band: feasible and selected chunks and minutes, by day and night, mean and median ratio, mean power."""
    chosen = F.col("selected")
    return with_band_gates(chunks).groupBy("subject_id", "band").agg(
        F.count_if("feasible").alias("feasible_chunks"), (minutes * F.count_if("feasible")).alias("feasible_minutes"), F.avg("ratio").alias("mean_ratio"), S.percentile("ratio", 0.5).alias("median_ratio"),
        F.avg("power").alias("mean_power"), F.count_if(chosen).alias("selected_chunks"), (minutes * F.count_if(chosen)).alias("selected_minutes"),
        (minutes * F.count_if(chosen & ~F.col("night"))).alias("day_minutes"), (minutes * F.count_if(chosen & F.col("night"))).alias("night_minutes"),
    )


def band_hourly(chunks: DataFrame, minutes: int = 5) -> DataFrame:
    """By subject, local hour and band: valid chunks and minutes, motion, selected minutes and mean ratio."""
    return with_band_gates(chunks).groupBy("subject_id", "local_hour", "band").agg(
        F.count(F.lit(1)).alias("valid_chunks"), (minutes * F.count(F.lit(1))).alias("valid_minutes"), F.avg("dynamic_mean").alias("mean_dynamic"), S.percentile("dynamic_median", 0.5).alias("median_dynamic"),
        (minutes * F.count_if("selected")).alias("selected_minutes"), F.avg("ratio").alias("mean_ratio"),
    )



# -------------------------------------------------------------------------------------------------- whole days


def daily_movement(ev: DataFrame, tz: str = S.DEFAULT_TZ, min_samples: int = 1000, calendar: bool = False) -> DataFrame:
    """Per device and local day: samples, estimated rate, mean and population variance of the squared magnitude and
    log1p of it; with calendar, days without rows between a device's first and last are kept."""
    sq = S.squared_magnitude()
    rows = ev.withColumn("day", S.local_day("timestamp", tz))
    out = rows.groupBy("device_id", "day").agg(
        F.count(F.lit(1)).alias("n_samples"), ((F.max("timestamp") - F.min("timestamp")) / 1000.0).alias("span_s"), F.avg(sq).alias("mean_power"), F.var_pop(sq).alias("var_power")
    )
    if calendar:
        span = out.groupBy("device_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
        days = span.select("device_id", F.explode(F.sequence("a", "b")).alias("day"))
        out = days.join(out, ["device_id", "day"], "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))
    rate = F.when(F.col("span_s") > 0, (F.col("n_samples") - 1) / F.col("span_s"))
    status = F.when(F.col("n_samples") == 0, "no_data").when(F.col("n_samples") < min_samples, "too_few_samples").otherwise("ok")
    return out.withColumn("estimated_hz", rate).withColumn("log_noise", F.log1p("var_power")).withColumn("status", status)


def daily_signal_power(ev: DataFrame, tz: str = S.DEFAULT_TZ) -> DataFrame:
    return ev.groupBy("device_id", S.local_day("timestamp", tz).alias("day")).agg(F.avg(S.squared_magnitude()).alias("signal_power"), F.count(F.lit(1)).alias("n_samples"))


def daily_band_power(ev: DataFrame, low: float = 0.5, high: float = 5.0, tz: str = S.DEFAULT_TZ, minutes: int = 60) -> DataFrame:
    """Mean square of the band-passed magnitude by device and day: filtered in chunks of `minutes`, weighted by size."""

    def one(key: tuple, rows: dict[str, np.ndarray]) -> dict | None:
        ms, x = rows["timestamp"], rows["magnitude"]
        order = np.argsort(ms, kind="stable")
        ms, x = ms[order], x[order]
        steps = np.diff(ms)
        steps = steps[steps > 0]
        fs = 1000.0 / np.median(steps) if len(steps) else 0.0
        if len(x) < 50 or fs <= 2 * high:
            return None
        y = N.zero_phase(N.butterworth(4, (low, high), float(fs)), x - x.mean())
        return {"power": np.array([(y**2).mean()]), "n": np.array([len(y)])}

    rows = ev.select("device_id", S.local_day("timestamp", tz).alias("day"), F.floor(F.col("timestamp") / (minutes * 60_000)).alias("chunk"), "timestamp", "magnitude")
    parts = over_groups(rows, ["device_id", "day", "chunk"], one, {"power": "double", "n": "long"})
    return parts.groupBy("device_id", "day").agg((F.sum(F.col("power") * F.col("n")) / F.sum("n")).alias("band_power"), F.sum("n").alias("n_samples"))


#: Bands of the sliding windows in Hz, both ends included.
SLIDING_BANDS = {"0.5-5Hz": (0.5, 5.0), "0.5-1Hz": (0.5, 1.0), "1-2Hz": (1.0, 2.0), "2-3Hz": (2.0, 3.0), "3-5Hz": (3.0, 5.0)}


def _window_plan(fs: float, win_s: float, overlap: float) -> tuple[int, int, list]:
    """Samples of a window and of a step, and the sections of the band-pass at 0.3 to 8 Hz, or to 0.4 of the rate if that
    is less; none where nothing would be left."""
    size = int(round(win_s * fs))
    high = min(8.0, 0.4 * fs)
    return size, max(1, int(round(size * (1 - overlap)))), N.butterworth(4, (0.3, high), fs) if high > 0.3 else []


def _powers(y: np.ndarray, starts: np.ndarray, size: int, fs: float, bands: dict[str, tuple[float, float]]) -> dict[str, np.ndarray]:
    """Power in each band of the windows of `size` samples at starts, each less its mean, under a Hann window."""
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    seen = np.lib.stride_tricks.sliding_window_view(y, size)
    f, out = np.fft.rfftfreq(size, 1 / fs), {b: [np.zeros(0)] for b in bands}
    for at in range(0, len(starts), 4096):
        rows = seen[starts[at : at + 4096]]
        power = np.abs(np.fft.rfft((rows - rows.mean(1, keepdims=True)) * hann, axis=1)) ** 2 / (fs * (hann**2).sum())
        power[:, 1 : (None if size % 2 else -1)] *= 2
        for b, (low, high) in bands.items():
            out[b].append(power[:, (f >= low) & (f <= high)].sum(1))
    return {b: np.concatenate(v) for b, v in out.items()}


def window_powers(ms: np.ndarray, x: np.ndarray, bands: dict[str, tuple[float, float]], win_s: float = 5.0, overlap: float = 0.5) -> pd.DataFrame:
    """first_ms and the power in each band of windows of win_s that overlap, counted in samples at the median rate, of a
    band-passed series.  Empty without a rate, or for windows of fewer than eight samples."""
    order = np.lexsort([x, ms])
    ms, x = ms[order], x[order]
    steps = np.diff(ms)
    steps = steps[steps > 0]
    fs = 1000.0 / float(np.median(steps)) if len(steps) else 0.0
    size, step, sections = _window_plan(fs, win_s, overlap)
    if size < 8 or len(x) < size:
        return pd.DataFrame({"first_ms": np.zeros(0, np.int64), **{b: np.zeros(0) for b in bands}})
    y = N.zero_phase(sections, x) if sections else x
    starts = np.arange(0, len(y) - size + 1, step)
    return pd.DataFrame({"first_ms": ms[starts], **_powers(y, starts, size, fs, bands)})


#: Samples of a piece of a device's series, and the stretch of time within which samples are numbered.
PIECE, NUMBERED_MS = 200_000, 600_000


def numbered_samples(rows: DataFrame) -> DataFrame:
    """rows (device_id, timestamp, magnitude, t0) with place (0, 1, ... by device in order of time, then value), step_ms
    (since the sample before) and n (of the device).

    Samples are numbered within stretches of time, and the stretches' sizes summed up: no task sorts a whole device.
    """
    key = ["device_id", "stretch"]
    rows = rows.withColumn("stretch", F.floor((F.col("timestamp") - F.col("t0")) / NUMBERED_MS))
    sums = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("here"), F.max("timestamp").alias("last_ms"))
    by_time = Window.partitionBy("device_id").orderBy("stretch")  # of stretches, not samples
    before = sums.select(
        *key, F.coalesce(F.sum("here").over(by_time.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
        F.lag("last_ms").over(by_time).alias("before_ms"), F.sum("here").over(Window.partitionBy("device_id")).alias("n"),
    )
    order = Window.partitionBy(*key).orderBy("timestamp", "magnitude")
    own = rows.withColumn("no", F.row_number().over(order) - 1).withColumn("own_before_ms", F.lag("timestamp").over(order))
    out = own.join(before, key)
    step = F.col("timestamp") - F.coalesce("own_before_ms", "before_ms")
    return out.select("device_id", "t0", "timestamp", "magnitude", (F.col("base") + F.col("no")).alias("place"), step.alias("step_ms"), "n")


def sliding_power(ev: DataFrame, win_s: float = 5, overlap: float = 0.5, bands: dict[str, tuple[float, float]] | None = None, piece: int = PIECE) -> DataFrame:
    """device_id, day (1 or 2), first_ms, band, power: windows of the first two days of each device, as window_powers()
    of the whole series.

    A device's series is cut into pieces, dealt over tasks.  Each has at both sides as many samples more as the filter
    remembers, and to the right a window's; the rate is the median of the steps, from their counts.  Samples without a
    value are left out.  Samples are written as they come and once more with their numbers, as both are read twice.
    """
    bands = SLIDING_BANDS if bands is None else bands
    ev = ev.select("device_id", "timestamp", "magnitude").where("magnitude is not null and timestamp is not null and device_id is not null")
    ev = intermediate(ev, "samples")
    first = ev.groupBy("device_id").agg(F.min("timestamp").alias("t0"))
    samples = numbered_samples(ev.join(first, "device_id").filter(F.col("timestamp") < F.col("t0") + 2 * 86_400_000))
    samples = intermediate(samples, "numbered-samples")
    steps = samples.filter("step_ms > 0").groupBy("device_id", "step_ms").agg(F.count(F.lit(1)).alias("times"))
    rates = steps.groupBy("device_id").agg((1000.0 / F.expr("percentile(step_ms, 0.5, times)")).alias("fs"))

    @F.pandas_udf("size int, halo int")
    def plan(fs: pd.Series) -> pd.DataFrame:
        """Of each device's rate."""
        plans = [_window_plan(x, win_s, overlap) for x in fs]
        return pd.DataFrame({"size": [p[0] for p in plans], "halo": [N.memory_of(p[2]) if p[2] else 0 for p in plans]}).astype("int32")

    rates = rates.withColumn("p", plan("fs")).select("device_id", "fs", "p.*").filter("size >= 8")
    length = F.greatest(F.lit(piece), F.col("size") + F.col("halo"))
    near = samples.join(rates, "device_id").filter(F.col("n") >= F.col("size")).withColumn("length", length)
    low = F.floor((F.col("place") - F.col("size") - F.col("halo")) / F.col("length"))
    high = F.floor((F.col("place") + F.col("halo")) / F.col("length"))
    last = F.floor((F.col("n") - 1) / F.col("length"))
    near = near.withColumn("piece", F.explode(F.sequence(F.greatest(low, F.lit(0)), F.least(high, last))))

    def one(key: tuple, rows: dict[str, np.ndarray]) -> dict:
        fs, n, length, t0 = float(rows["fs"][0]), int(rows["n"][0]), int(rows["length"][0]), int(rows["t0"][0])
        size, step, sections = _window_plan(fs, win_s, overlap)
        x, at = rows["magnitude"], int(rows["place"][0])
        y = N.zero_phase(sections, x, at == 0, at + len(x) == n) if sections else x
        begin, stop = -(-key[1] * length // step) * step, min((key[1] + 1) * length, n - size + 1)
        starts = np.arange(begin, stop, step) - at
        first = rows["timestamp"][starts]
        powers = _powers(y, starts, size, fs, bands)
        return {
            "day": np.tile((1 + (first - t0) // 86_400_000).astype(np.int32), len(bands)), "first_ms": np.tile(first, len(bands)),
            "band": np.repeat(np.arange(len(bands), dtype=np.int32), len(starts)), "power": np.concatenate([powers[b] for b in bands]),
        }

    near = near.select("device_id", "piece", "place", "timestamp", "magnitude", "fs", "n", "length", "t0")
    out = over_groups(near, ["device_id", "piece"], one, {"day": "int", "first_ms": "long", "band": "int", "power": "double"}, ["place"])
    names = F.array(*[F.lit(b) for b in bands])
    return out.select("device_id", "day", "first_ms", names[F.col("band")].alias("band"), "power")


def sliding_day_stats(windows: DataFrame) -> DataFrame:
    """Median, third quartile and IQR of window powers by device, band and day."""
    p = F.col("power")
    return windows.groupBy("device_id", "band", "day").agg(S.percentile(p, 0.5).alias("median"), S.percentile(p, 0.75).alias("p75"), (S.percentile(p, 0.75) - S.percentile(p, 0.25)).alias("iqr"), F.count(F.lit(1)).alias("n_windows"))


def sliding_day_change(days: DataFrame) -> DataFrame:
    """Of each device and band the medians of both days, their difference and, for a positive first, their ratio."""
    day = lambda d: F.max(F.when(F.col("day") == d, F.col("median")))
    out = days.groupBy("device_id", "band").agg(day(1).alias("day1_median"), day(2).alias("day2_median"))
    a, b = F.col("day1_median"), F.col("day2_median")
    return out.withColumn("delta_day2_minus_day1", b - a).withColumn("ratio_day2_div_day1", F.when(a > 0, b / a))


def initial_empty_status(chunks: DataFrame, n: int = 12) -> DataFrame:
    """missing_no_raw_rows_at_accelerometer_anchor if the first n chunks of a subject's window hold no row."""
    first = F.min(F.when(F.col("sample_count") > 0, F.col("chunk_index")))
    status = F.when(F.coalesce(F.col("first_chunk"), F.lit(n)) >= n, "missing_no_raw_rows_at_accelerometer_anchor").otherwise("ok")
    return chunks.groupBy("subject_id").agg(first.alias("first_chunk")).withColumn("status", status)


def density_probe(ev: DataFrame, n: int = 1000) -> DataFrame:
    """The first n rows of each device with the time since the row before and the magnitude: a report of n rows."""
    w = Window.partitionBy("device_id").orderBy("timestamp", "_id")
    rows = ev.withColumn("row_no", F.row_number().over(w)).withColumn("delta_ms", F.col("timestamp") - F.lag("timestamp").over(w))
    return rows.filter(F.col("row_no") <= n).select("device_id", "row_no", "timestamp", "delta_ms", S.magnitude().alias("magnitude"))


# --------------------------------------------------------------------------------------------------- barometer


def _pressure(we: DataFrame) -> DataFrame:
    return we.withColumn("raw", S.json_field("data", "$.double_values_0", "double")).withColumn("pressure", F.when(S.in_range("raw", 300, 1100), F.col("raw")))


def barometer_simple(we: DataFrame) -> DataFrame:
    p = _pressure(we)
    n = F.count("pressure")
    return p.groupBy(*KEY).agg(
        n.alias("pressure_rows"), F.count_if(F.col("raw").isNotNull() & F.col("pressure").isNull()).alias("pressure_outliers"), (F.max("pressure") - F.min("pressure")).alias("pressure_range"),
        F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp("pressure")).alias("pressure_sd"),
    )


def smoothed_pressure(at: np.ndarray, value: np.ndarray, max_gap_s: int = 5, least_s: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(second, pressure) from one-second medians in order of time: gaps of up to max_gap_s interpolated, ten-second
    medians, and a 0.05 Hz zero-phase low-pass on each stretch of least_s seconds."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0)
    full = np.arange(at[0], at[-1] + 1)
    filled = np.interp(full, at, value)
    before = at[np.searchsorted(at, full, side="right") - 1]
    after = at[np.searchsorted(at, full, side="left")]
    known = (after - before) <= max_gap_s + 1
    series = pd.Series(np.where(known, filled, np.nan)).rolling(10, center=True, min_periods=1).median().to_numpy()
    series[~known] = np.nan
    sections = N.butterworth(2, (0.05,), 1.0)
    out_at, out = [], []
    for part in np.split(np.arange(len(full)), np.flatnonzero(np.diff(known.astype(int))) + 1):
        if len(part) >= least_s and known[part[0]]:
            out_at.append(full[part])
            out.append(N.zero_phase(sections, series[part]))
    return (np.concatenate(out_at), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0))


def barometer_signal(we: DataFrame) -> DataFrame:
    """The smoothed pressure and the elevation relative to its start, a row per second of each window's device.

    Means of a time and medians of a second are taken before rows meet, so a task holds a value for each second.
    """

    def one(key: tuple, rows: dict[str, np.ndarray]) -> dict:
        at, p = smoothed_pressure(rows["second"], rows["pressure"])
        return {"second": at, "pressure": p, "elevation_m": -8.3 * (p - p[0]) if len(p) else p}

    rows = _pressure(we).where("pressure is not null").select(*KEY, "device_id", "timestamp", "pressure")
    rows = rows.groupBy(*KEY, "device_id", "timestamp").agg(F.avg("pressure").alias("pressure"))
    seconds = rows.groupBy(*KEY, "device_id", F.floor(F.col("timestamp") / 1000).alias("second")).agg(S.percentile("pressure", 0.5).alias("pressure"))
    return over_groups(seconds, [*KEY, "device_id"], one, {"second": "long", "pressure": "double", "elevation_m": "double"}, ["second"])


def elevation_transitions(signal: DataFrame) -> DataFrame:
    """A row per detected change of floor: second and signed change in metres."""

    def one(key: tuple, rows: dict[str, np.ndarray]) -> dict:
        seconds = rows["second"]
        hits = N.elevation_hits(seconds, rows["elevation_m"])
        return {"second": seconds[[i for i, _ in hits]] if hits else seconds[:0], "change_m": np.array([change for _, change in hits], float)}

    rows = signal.select(*KEY, "device_id", "second", "elevation_m")
    return over_groups(rows, [*KEY, "device_id"], one, {"second": "long", "change_m": "double"}, ["second"])


def transition_summary(signal: DataFrame) -> DataFrame:
    """Counts up and down and the sum of changes; a window with a signal and no transition has 0."""
    hits = elevation_transitions(signal).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("transitions"), F.count_if(F.col("change_m") > 0).alias("up"), F.count_if(F.col("change_m") < 0).alias("down"), F.sum(F.abs("change_m")).alias("total_change_m")
    )
    return signal.select(*KEY).distinct().join(hits, KEY, "left").fillna(0, ["transitions", "up", "down", "total_change_m"])

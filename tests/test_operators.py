import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwire.operators import features as X
from cohortwire.operators import mapping as M
from cohortwire.operators import quality as Q
from cohortwire.operators import rangejoin as R
from cohortwire.operators import signal as G
from cohortwire.operators import stats as T
from cohortwire.operators import windows as W

DAY = 86_400_000


def rows(spark, payloads, table="t", step=1000, start=0, device="D1"):
    data = [(i, start + (p[0] if isinstance(p, tuple) else i * step), device, table, json.dumps(p[1] if isinstance(p, tuple) else p)) for i, p in enumerate(payloads)]
    ev = spark.createDataFrame(data, "_id long, timestamp long, device_id string, table_name string, data string")
    return ev.withColumn("subject_id", F.lit("S1")).withColumn("window_rule", F.lit("w")).withColumn("start_ms", F.lit(0).cast("long"))


def events(spark, moments, device="D1", table="t"):
    return spark.createDataFrame([(i, m, device, table, "{}") for i, m in enumerate(moments)], "_id long, timestamp long, device_id string, table_name string, data string")


def windows(spark, *spans, device="D1", table="t"):
    return spark.createDataFrame([("S1", device, table, f"w{i}", a, b) for i, (a, b) in enumerate(spans)], "subject_id string, device_id string, table_name string, window_rule string, start_ms long, end_ms long")


def test_window_ends_are_half_open(spark):
    ev = events(spark, [9, 10, 19, 20])
    assert sorted(r.timestamp for r in R.range_join(ev, windows(spark, (10, 20))).collect()) == [10, 19]
    assert R.range_join(ev, windows(spark, (10, 20)), closed=True).count() == 3
    assert R.has_rows(ev, windows(spark, (10, 20), (30, 40))).count() == 1


def test_first_event_search_includes_its_end(spark):
    anchors = spark.createDataFrame([("S1", "D1", 100)], "subject_id string, device_id string, anchor_ms long")
    assert R.first_event_after(events(spark, [200]), anchors, 100).first().found_ms == 200
    assert R.first_event_after(events(spark, [201]), anchors, 100).count() == 0
    assert R.last_event_before(events(spark, [99, 100]), anchors, 100).first().found_ms == 99


def test_fallback_window_at_its_last_moment(spark):
    subjects = spark.createDataFrame([("S1", 0)], "subject_id string, t1_ms long")
    devices = spark.createDataFrame([("S1", "D1")], "subject_id string, device_id string")
    got = W.t1_day_or_fallback(events(spark, [6 * DAY]), subjects, devices, 24, ["t", "u"]).collect()
    by = {r.table_name: r for r in got}
    assert by["t"].window_rule == "t1_week_fallback" and by["t"].start_ms == 6 * DAY
    assert by["u"].window_rule == "no_window" and by["u"].start_ms is None
    assert W.t1_day_or_fallback(events(spark, [6 * DAY + 1]), subjects, devices, 24, ["t"]).first().start_ms is None
    assert W.t1_day_or_fallback(events(spark, [10, DAY + 5]), subjects, devices, 24).first().window_rule == "t1_primary_day"


def test_exact_label_wins(spark):
    m = spark.createDataFrame([("2", "A;B", 1), ("002", "C", 0), ("3", "D", 0), ("03", "E", 1)], "label string, device_ids string, row_order int")
    got = {(r.subject_id, r.device_id) for r in M.strict_device_map(m).collect()}
    assert got == {("002", "C"), ("003", "E")}
    e = M.subject_device_episodes(spark.createDataFrame([("002",), ("009",)], "subject_id string"), m.where("label = '002'"))
    assert {(r.subject_id, r.device_id, r.status) for r in e.collect()} == {("002", "C", "ok"), ("009", None, "no_label_match")}


def test_merge_fails_on_repeated_keys(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2)], "k string, a int")
    with pytest.raises(Exception, match="repeated"):
        M.outer_merge_unique(a, a.select("k", F.col("a").alias("b")).limit(1), ["k"]).collect()


def test_screen_sessions_from_the_last_unlock(spark):
    we = rows(spark, [{"screen_status": str(s)} for s in (3, 3, 0, 2, 3, 0)])
    r = X.features_screen_sessions(we).first()
    assert r.screen_sessions == 2 and r.screen_session_median_s == 1.0


def test_typing_bursts_and_words(spark):
    typed = [(0, "", "a"), (1000, "a", "ab"), (2000, "ab", "ab "), (33_001, "ab ", "c "), (34_001, "c ", "d")]
    we = rows(spark, [(ms, {"before_text": b, "current_text": c, "package_name": "p", "is_password": "0"}) for ms, b, c in typed])
    r = X.features_keyboard(we).first()
    assert r.key_bursts == 2
    assert X.features_keyboard_words(we).first().key_words_completed == 1
    same = rows(spark, [(0, {"before_text": "", "current_text": "a", "package_name": "p"}), (30_000, {"before_text": "a", "current_text": "ab", "package_name": "p"})])
    assert X.features_keyboard(same).first().key_bursts == 1


def test_cell_transitions_skip_blanks(spark):
    we = rows(spark, [{"cid": c, "lac": "1"} for c in ("A", "", "A", "B")])
    assert X.features_gsm(we).first().gsm_cell_transitions == 1


def test_missing_is_not_zero(spark):
    we = rows(spark, [{"battery_status": "2"}])
    r = X.features_battery(we).first()
    assert r.battery_low_count is None and r.battery_charging_count == 1
    bad = rows(spark, [{}]).withColumn("data", F.lit("{bad"))
    r = X.features_messages(bad).first()
    assert r.message_count is None and r.json_parse_errors == 1 and r.feature_status == "no_valid_rows"


def test_bluetooth_counts_missing_address_as_missing(spark):
    r = X.features_bluetooth(rows(spark, [{"bt_address": "a"}, {"bt_rssi": "1"}, {"bt_address": "a"}])).first()
    assert r.bt_unique_devices == 1 and r.bt_observations == 3


def test_dark_threshold_is_exclusive(spark):
    assert X.features_light(rows(spark, [{"double_light_lux": 9.99}, {"double_light_lux": 10}])).first().light_dark_percent == 50


def test_row_order_does_not_change_results(spark):
    we = rows(spark, [{"screen_status": str(i * 7 % 4)} for i in range(60)])
    a = X.features_screen(we).first()
    b = X.features_screen(we.orderBy(F.rand(3)).repartition(3)).first()
    assert a == b


def chunk_rows(spark, n, f, step=100):
    ms = np.arange(n) * step
    x = f(ms / 1000)
    return spark.createDataFrame([(int(i), int(t), "D1", "S1", 0, float(v)) for i, (t, v) in enumerate(zip(ms, x))], "_id long, timestamp long, device_id string, subject_id string, start_ms long, magnitude double")


@pytest.mark.parametrize(("n", "status"), [(99, "too_few_samples"), (100, "ok")])
def test_chunk_gate(spark, n, status):
    assert G.chunk_stats(G.assign_chunks(chunk_rows(spark, n, lambda t: 1 + 0 * t))).first().status == status


def test_empty_chunks_are_kept(spark):
    win = windows(spark, (0, 900_000)).select("subject_id", "device_id", "start_ms", "end_ms")
    s = G.chunk_stats(G.assign_chunks(chunk_rows(spark, 120, lambda t: 1 + 0 * t)), win)
    assert {r.chunk_index: r.status for r in s.collect()} == {0: "ok", 1: "no_rows", 2: "no_rows"}


def test_rectified_oscillation_doubles(spark):
    r = G.chunk_spectrum(G.assign_chunks(chunk_rows(spark, 3000, lambda t: 1 + np.sin(2 * np.pi * 2 * t + 0.3)))).first()
    assert r.dominant_hz == pytest.approx(4.0, abs=0.05)


def test_pressure_step_is_one_transition_down(spark):
    we = rows(spark, [{"double_values_0": 1000.0 + (0.5 if i >= 300 else 0.0)} for i in range(600)])
    r = G.transition_summary(G.barometer_signal(we)).first()
    assert (r.transitions, r.up, r.down) == (1, 0, 1)


def test_sliding_windows_overlap(spark):
    ev = chunk_rows(spark, 600, lambda t: np.sin(2 * np.pi * 1.5 * t), step=50)
    got = G.sliding_power(ev)
    assert {r.band: r.n for r in got.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()} == dict.fromkeys(G.SLIDING_BANDS, 11)
    days = {r.band: r for r in G.sliding_day_stats(got).collect()}
    assert days["1-2Hz"]["median"] > 100 * days["3-5Hz"]["median"] and days["1-2Hz"].n_windows == 11
    change = G.sliding_day_change(G.sliding_day_stats(got)).collect()
    assert all(r.day2_median is None and r.delta_day2_minus_day1 is None for r in change)


def test_delta_consistency_tolerance(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 1.1), ("b", 1.0, 2.0, 1.2), ("c", None, 2.0, 1.0)], "subject_id string, x_t1 double, x_t2 double, x_delta double")
    assert [r.subject_id for r in Q.delta_consistency(df).collect()] == ["b"]


def test_artifacts_and_unlabelled_rows(spark):
    df = spark.createDataFrame([("a", 1.0, None), (None, 2.0, None), ("b", None, None)], "subject_id string, x double, y double")
    clean, loose = Q.drop_artifacts(df)
    assert clean.columns == ["subject_id", "x"] and [r.subject_id for r in clean.collect()] == ["a"] and loose.count() == 1


def test_ridge_from_sums_matches_direct(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.0] + 0.1 * rng.normal(size=200) + 5
    df = spark.createDataFrame([(f"s{i}", *map(float, x[i]), float(y[i])) for i in range(200)], "subject_id string, a double, b double, c double, y double")
    df = T.assign_folds(df, 4, 1)
    pred, coefs = T.ridge_cv(df, ["a", "b", "c"], alphas=(0.001,))
    r = T.metrics(pred.withColumn("model", F.lit("r"))).where("repeat is null and model = 'r'").first()
    assert r.rmse < 0.15 and len(coefs) == 4
    _, signed = T.signed_ridge_cv(df, ["a", "b", "c"], {"b": 1}, alphas=(0.001,))
    assert all(c["beta"][1] >= 0 for c in signed)


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert T.adjusted_rand(df, "a", "b") == 1.0


def test_folds_are_the_same_every_time(spark):
    df = spark.createDataFrame([(f"s{i}",) for i in range(50)], "subject_id string")
    a, b = (sorted(map(tuple, T.assign_folds(df.repartition(n), 5, 2).collect())) for n in (1, 3))
    assert a == b


def test_states_follow_the_spectrum_and_the_median(spark):
    names = "sample_count long, gap_burden double, dynamic_median double, dominant_hz double, ratio_walking_like_1_3hz double, ratio_shaking_like_3_8hz double"
    rows = [(99, 0.0, 1.0, 2.0, 1.0, 0.0), (100, 0.51, 1.0, 2.0, 1.0, 0.0), (100, 0.5, 0.1, 2.0, 1.0, 0.0), (100, 0.0, 0.11, 1.0, 0.35, 0.0), (100, 0.0, 0.5, 3.0, 0.9, 0.34), (100, 0.0, 0.5, 3.0, 0.9, 0.35), (100, None, 0.19, None, None, None), (100, 0.0, 0.2, None, None, None)]
    got = [r.state for r in G.chunk_state(spark.createDataFrame(rows, names).coalesce(1)).collect()]
    want = ["insufficient", "fragmented", "still", "walking", "handling", "shaking", "low_motion", "handling"]
    assert got == [G.STATES[w] for w in want]


def test_bands_stop_at_half_the_resampling_rate():
    ms = np.arange(0, 120_000, 100)
    found = G.spectrum_of(ms, 1 + np.sin(2 * np.pi * 0.8 * ms / 1000))
    assert found["power_high_freq_8_12hz"] is None and found["ratio_high_freq_8_12hz"] is None
    assert found["dominant_hz"] == pytest.approx(1.6, abs=0.05) and found["ratio_walking_like_1_3hz"] > 0.35
    assert G.spectrum_of(ms[:250], np.ones(250)) is None and G.spectrum_of(np.arange(0, 400_000, 2_000), np.ones(200)) is None


def test_early_and_late_windows_that_touch_overlap(spark):
    base = {"T1_start_ms": 0, "T1_end_ms": 1, "T2_start_ms": 5, "T2_end_ms": 6, "early_window_start_ms": 0, "early_window_end_ms": 3, "late_window_start_ms": 3, "late_window_end_ms": 5}
    base = {k: 1_710_000_000_000 + v for k, v in base.items()}
    rows = [("touch", *base.values()), ("apart", *(base | {"late_window_start_ms": base["late_window_start_ms"] + 1}).values()), ("before", *(base | {"late_window_start_ms": base["early_window_start_ms"] - 9, "late_window_end_ms": base["early_window_start_ms"] - 1}).values())]
    df = spark.createDataFrame(rows, "subject_id string, " + ", ".join(f"{k} long" for k in base))
    assert {(r.subject_id, r.issue) for r in Q.window_issues(df).collect()} == {("touch", "early_late_window_overlap")}


def test_types_of_keys_come_from_their_own_values(spark):
    from cohortwire.operators import discovery as D

    payloads = ['{"a": 5, "b": {"a": "x"}}', '{"a": 5.5, "b": [1], "c": null}', '{"a": "7", "c": true}', "[1]", "{bad", None]
    ev = spark.createDataFrame([(i, i, "t", p) for i, p in enumerate(payloads)], "_id long, timestamp long, table_name string, data string")
    got = {(r["_id"], r.key): (r.type, r.value) for r in D.exploded_keys(ev).collect()}
    assert got == {(0, "a"): ("integer", "5"), (0, "b"): ("object", '{"a":"x"}'), (1, "a"): ("number", "5.5"), (1, "b"): ("array", "[1]"), (1, "c"): ("null", None), (2, "a"): ("string", "7"), (2, "c"): ("boolean", "true")}
    kinds = {r.key: r.key_type for r in D.key_examples(ev).collect()}
    assert kinds == {"a": "mixed", "b": "mixed", "c": "boolean"}


def test_pairwise_rand_is_the_single_one(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([tuple(map(int, r)) for r in rng.integers(0, 3, (200, 3))], "x int, y int, z int")
    for r in T.pairwise_rand(df, ["x", "y", "z"]).collect():
        assert r.rand == pytest.approx(T.adjusted_rand(df, r.a, r.b))


def test_imputed_ridge_uses_the_other_folds_medians(spark):
    rows = [(f"s{i}", 0, i % 4, float(i) if i % 5 else None, 2.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id string, repeat int, fold int, a double, y double")
    pred, coefs = T.ridge_cv(df, ["a"], alphas=(0.001,), impute=True)
    assert pred.count() == 60 and pred.where("prediction is null").count() == 0 and len(coefs) == 4
    med = {f: float(np.median([r[3] for r in rows if r[2] != f and r[3] is not None])) for f in range(4)}
    got = {(r.subject_id): r.a for r in pred.collect()}
    assert all(got[r[0]] == med[r[2]] for r in rows if r[3] is None)

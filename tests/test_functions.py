import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwire.functions import numeric as N
from cohortwire.functions import scalars as S
from cohortwire.functions.redact import redact_json


def one(spark, column, **values):
    kinds = {int: "long", float: "double", str: "string", type(None): "string", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(("raw", "want"), [(" 7 ", "007"), ("2", "002"), ("1234", "1234"), ("nan", None), ("", None), ("A1", "A1"), (None, None)])
def test_subject_ids(spark, raw, want):
    assert one(spark, S.normalize_subject_id("s"), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("1.5", 1.5), (" 2 ", 2.0), ("x", None), ("NaN", None), ("", None)])
def test_to_number(spark, raw, want):
    assert one(spark, S.to_number("s"), s=raw) == want


def test_parse_errors_strict_and_first_phase(spark):
    df = spark.createDataFrame([('{"a":1}',), ("{bad",), (None,), ("[1]",)], "data string")
    assert [r.parse_error for r in S.parse_json(df).collect()] == [False, True, True, True]
    assert [r.parse_error for r in S.parse_json(df, null_is_error=False).collect()] == [False, True, False, False]


@pytest.mark.parametrize(("wall", "night"), [("21:59", False), ("22:00", True), ("05:59", True), ("06:00", False)])
def test_night_edges(spark, wall, night):
    ms = int((dt.datetime.fromisoformat(f"2024-01-10T{wall}:00+02:00")).timestamp() * 1000)
    assert one(spark, S.is_night("ms"), ms=ms) is night


@pytest.mark.parametrize(("day", "hours"), [("2025-03-28", 23), ("2025-10-26", 25), ("2025-06-01", 24)])
def test_local_midnight_across_summer_time(spark, day, hours):
    d = F.lit(day).cast("date")
    length = (S.local_midnight_ms(F.date_add(d, 1)) - S.local_midnight_ms(d)) / 3_600_000
    assert one(spark, length, s="x") == hours


def test_iso_has_the_offset_of_the_moment(spark):
    assert one(spark, S.local_iso("ms"), ms=1_704_067_200_000) == "2024-01-01T02:00:00.000+02:00"
    assert one(spark, S.local_iso("ms"), ms=1_719_792_000_000) == "2024-07-01T03:00:00.000+03:00"


def test_first_text_and_brackets(spark):
    assert one(spark, S.first_text("a", "b"), a="", b=" app ") == "app"
    assert one(spark, S.first_text("a", "b"), a="  ", b="app") is None
    assert one(spark, S.strip_brackets("a"), a="[x\ny]") == "x\ny"
    assert one(spark, S.strip_brackets("a"), a="[") == "["


def test_flags(spark):
    assert one(spark, S.charging_flag("a", "b"), a="0", b="2") is True
    assert one(spark, S.charging_flag("a", "b"), a="0", b=None) is False
    assert one(spark, S.charging_flag("a", "b"), a=None, b=None) is None
    assert one(spark, S.data_enabled("a"), a="2") is True
    assert one(spark, S.data_enabled("a"), a="perhaps") is None
    assert one(spark, S.is_moving("a"), a="0") is False
    assert one(spark, S.valid_cell("a"), a="-1") is None
    assert one(spark, S.scroll_direction("a"), a="x_scrolled_up") == "up"
    assert one(spark, S.battery_percent("a", "b"), a="30", b="60") == 50
    assert one(spark, S.excel_date("a"), a="45292") == dt.date(2024, 1, 1)
    assert one(spark, S.to_bool("a"), a=" Yes ") is True


def test_haversine_and_entropy(spark):
    assert one(spark, S.haversine_km("a", "b", "c", "d"), a=0.0, b=0.0, c=0.0, d=1.0) == pytest.approx(111.195, abs=1e-2)
    assert one(spark, S.entropy_of("a"), a=[4.0]) == 0
    assert one(spark, S.entropy_of("a"), a=[3.0, 3.0]) == 1
    assert one(spark, S.entropy_of("a"), a=[0.0]) is None


def test_registered_names(spark):
    S.register(spark)
    r = spark.sql("SELECT haversine_km(0D, 0D, 0D, 1D) h, local_day(1704067200000, 'Asia/Jerusalem') d, night_flag(1704067200000, 'Asia/Jerusalem') n, shannon_entropy(array(1D, 1D)) e").first()
    assert r.h == pytest.approx(111.195, abs=1e-2) and r.d == dt.date(2024, 1, 1) and r.n is True and r.e == 1


def test_best_activity_first_wins_ties(spark):
    items = json.dumps([{"activity": "a", "confidence": 40}, {"activity": "b", "confidence": 60}, {"activity": "c", "confidence": 60}])
    assert one(spark, S.best_activity("d")["label"], d=json.dumps({"activities": items})) == "b"
    assert one(spark, S.best_activity("d")["label"], d=json.dumps({"activity_name": "still", "activities": items})) == "still"
    assert one(spark, S.best_activity("d"), d="{}") is None


def test_redaction_reaches_nested_values(spark):
    data = json.dumps({"application_name": "ok", "user_name": "Ann", "inner": {"ssid": "home", "n": 1}, "list": '[{"phone_number": "1"}]'})
    out = redact_json(spark.createDataFrame([(data,), ("bad",), (None,)], "data string"), "data").collect()
    got = json.loads(out[0].data)
    assert got["application_name"] == "ok" and got["user_name"] == S.REDACTED and got["inner"] == {"ssid": S.REDACTED, "n": 1} and S.REDACTED in got["list"]
    assert out[1].data is None and out[2].data is None


def test_welch_of_a_sine():
    t = np.arange(3000) / 10
    f, p = N.welch(np.sin(2 * np.pi * 2 * t), 10, 600)
    inside = (f >= 1) & (f < 3)
    assert f[p.argmax()] == pytest.approx(2.0) and N.trapezoid(p[inside], f[inside]) / N.trapezoid(p, f) > 0.99
    assert N.trapezoid(p, f) == pytest.approx(0.5, rel=0.02)


def test_band_pass_keeps_its_band():
    t = np.arange(4000) / 50
    sections = N.butterworth(4, (0.5, 5.0), 50)
    inside = N.zero_phase(sections, np.sin(2 * np.pi * 2 * t))[500:-500]
    outside = N.zero_phase(sections, np.sin(2 * np.pi * 15 * t))[500:-500]
    assert np.abs(inside).max() == pytest.approx(1, abs=0.02) and np.abs(outside).max() < 1e-3


def test_low_pass_keeps_a_constant():
    y = N.zero_phase(N.butterworth(2, (0.05,), 1.0), np.full(100, 7.0))
    assert np.allclose(y, 7.0)


def test_elevation_anchor_moves_and_rests():
    s = np.arange(100)
    e = np.where(s < 20, 0.0, np.where(s < 60, 4.0, 8.0))
    assert [i for i, _ in N.elevation_hits(s, e)] == [20, 60]
    quick = np.where(s < 20, 0.0, np.where(s < 35, 4.0, 8.0))
    assert [i for i, _ in N.elevation_hits(s, quick)] == [20, 50]


def test_no_personal_key_gets_through(spark):
    keys = ["email", "phone", "message", "body", "subscriber_id", "sim_serial", "bssid", "name", "device_name", "name_first", "Line_Number"]
    data = json.dumps({**{k: "private" for k in keys}, "application_name": "app", "is_system_app": "1", "inner": {"email": "private", "list": [{"imei": "private"}], "text_in": json.dumps({"address": "private"})}})
    df = spark.createDataFrame([(data,)], "data string")
    deep = redact_json(df).first().data
    assert "private" not in deep and json.loads(deep)["application_name"] == "app" and json.loads(deep)["is_system_app"] == "1"
    flat = json.loads(df.select(S.redact_flat("data").alias("d")).first().d)
    assert all(flat[k] == S.REDACTED for k in keys) and flat["application_name"] == "app"


def test_thinned_times(spark):
    df = spark.createDataFrame([(t,) for t in (-3, -1, 0, 2, 3, 5)], "t long")
    assert [r.t for r in df.filter(S.thinned("t", 3)).collect()] == [-3, 0, 3]
    assert [r.t for r in df.filter(S.thinned("t", 3, 5)).collect()] == [-1, 2, 5]

"""Column functions: parsing, coercion, local time, flags and geometry.  All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_TZ = "Asia/Jerusalem"
EARTH_KM = 6371.0088
#: Texts that stand for a missing value.
NULL_TEXTS = ["", "nan", "none", "null", "<na>", "nat"]
#: Parts of JSON keys whose values never reach an output; `name` counts as a key or as its first or last word.
SENSITIVE = [
    "text", "current_text", "before_text", "message", "body", "phone", "number", "line_number", "subscriber", "imei",
    "imei_meid_esn", "sim_serial", "contact", "email", "address", "ssid", "bssid", "^name$", "_name$", "^name_",
]
ALLOWED_KEYS = ["application_name"]
REDACTED = "[REDACTED_SENSITIVE_FIELD]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ------------------------------------------------------------------------------------------------ JSON and text


def json_object(col="data") -> Column:
    """The payload as map<string,string>; NULL for NULL, bad JSON and anything but an object."""
    return F.when(F.json_object_keys(_c(col)).isNotNull(), F.from_json(_c(col), "map<string,string>"))


def parse_json(ev: DataFrame, schema: str | None = None, null_is_error: bool = True) -> DataFrame:
    """Adds `payload` (by the schema, or as a map) and `parse_error`.

    With null_is_error, NULL, bad text and non-objects are errors; without, only text that isn't JSON is.
    """
    keys = F.json_object_keys("data")
    payload = F.from_json("data", schema) if schema else F.from_json("data", "map<string,string>")
    bad = keys.isNull() if null_is_error else F.col("data").isNotNull() & F.try_parse_json("data").isNull()
    return ev.withColumn("payload", F.when(keys.isNotNull(), payload)).withColumn("parse_error", bad)


def json_field(col, path: str, kind: str = "string") -> Column:
    return F.get_json_object(_c(col), path).try_cast(kind)


def to_number(col) -> Column:
    """Text to double; junk, blanks and NaN to NULL."""
    x = F.trim(_c(col).cast("string")).try_cast("double")
    return F.when(~F.isnan(x), x)


def normalize_subject_id(col, strip_decimal: bool = False) -> Column:
    """Trimmed; NULL-like texts to NULL; all-digit ids padded to three digits, longer ones untouched."""
    x = F.trim(_c(col).cast("string"))
    if strip_decimal:
        x = F.regexp_replace(x, r"\.0$", "")
    x = F.when(~F.lower(x).isin(NULL_TEXTS), x)
    return F.when(x.rlike("^[0-9]+$") & (F.length(x) < 3), F.lpad(x, 3, "0")).otherwise(x)


def to_bool(col) -> Column:
    return F.coalesce(F.lower(F.trim(_c(col).cast("string"))).isin("1", "true", "t", "yes", "y"), F.lit(False))


def first_text(*cols) -> Column:
    """The first value that isn't the empty string, trimmed; blank after trimming is NULL."""
    return F.nullif(F.trim(F.coalesce(*[F.nullif(_c(c), F.lit("")) for c in cols])), F.lit(""))


def strip_brackets(col) -> Column:
    c = _c(col)
    return F.when(F.length(c) >= 2, F.regexp_replace(c, r"(?s)^\[(.*)\]$", "$1")).otherwise(c)


# ------------------------------------------------------------------------------------------------------- time


def local_ts(ms="timestamp", tz: str = DEFAULT_TZ) -> Column:
    """Local wall-clock timestamp; needs the session time zone UTC."""
    return F.from_utc_timestamp(F.timestamp_millis(_c(ms)), tz)


def local_day(ms="timestamp", tz: str = DEFAULT_TZ) -> Column:
    return F.to_date(local_ts(ms, tz))


def local_hour(ms="timestamp", tz: str = DEFAULT_TZ) -> Column:
    return F.hour(local_ts(ms, tz))


def local_hour_bucket(ms="timestamp", tz: str = DEFAULT_TZ) -> Column:
    return F.date_format(local_ts(ms, tz), "yyyy-MM-dd HH")


def local_iso(ms="timestamp", tz: str = DEFAULT_TZ) -> Column:
    """ISO text with the offset of that moment."""
    wall = local_ts(ms, tz)
    minutes = ((F.unix_millis(wall) - _c(ms)) / 60_000).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    offset = F.format_string("%s%02d:%02d", sign, F.floor(F.abs(minutes) / 60).cast("int"), F.abs(minutes) % 60)
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSS"), offset)


def is_night(ms="timestamp", tz: str = DEFAULT_TZ, start: int = 22, end: int = 6) -> Column:
    hour = local_hour(ms, tz)
    return (hour >= start) | (hour < end)


def local_midnight_ms(date, tz: str = DEFAULT_TZ) -> Column:
    """UTC milliseconds of local midnight of a date: exact across changes of summer time."""
    return F.unix_millis(F.to_utc_timestamp(_c(date).cast("timestamp"), tz))


def excel_date(col) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), to_number(col).cast("int"))


# ------------------------------------------------------------------------------------------------------ flags


def charging_flag(adaptor, status) -> Column:
    """Plugged if the adaptor isn't 0 or the status is 2 or 5; NULL if both are missing."""
    a, s = to_number(adaptor), to_number(status).cast("int")
    flag = F.coalesce(a != 0, F.lit(False)) | F.coalesce(s.isin(2, 5), F.lit(False))
    return F.when(a.isNotNull() | s.isNotNull(), flag)


def data_enabled(col) -> Column:
    x = F.lower(F.trim(_c(col).cast("string")))
    yes, no = ["true", "yes", "enabled", "on", "connected"], ["false", "no", "disabled", "off", "disconnected"]
    number = to_number(col).cast("int")
    return F.when(x.isin(yes), True).when(x.isin(no), False).when(number.isNotNull(), number.isin(1, 2))


def is_moving(col) -> Column:
    x = F.lower(F.trim(_c(col).cast("string")))
    number = to_number(col)
    return F.when(x.isin("true", "yes", "moving"), True).when(x.isin("false", "no", "still"), False).when(number.isNotNull(), number != 0)


def battery_percent(level, scale) -> Column:
    n, s = to_number(level), to_number(scale)
    return F.when(s > 0, 100 * n / s).otherwise(n)


def valid_cell(col) -> Column:
    x = F.trim(_c(col).cast("string"))
    return F.when(~F.lower(x).isin("", "nan", "none", "null", "-1"), x)


def scroll_direction(action) -> Column:
    x = F.upper(_c(action))
    return F.when(x.contains("SCROLLED_UP"), "up").when(x.contains("SCROLLED_DOWN"), "down")


# --------------------------------------------------------------------------------------------------- geometry


def squared_magnitude(x="x", y="y", z="z") -> Column:
    return _c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z)


def magnitude(x="x", y="y", z="z") -> Column:
    return F.sqrt(squared_magnitude(x, y, z))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, a2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat, half_lon = (a2 - a1) / 2, (F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin(half_lon), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def in_range(col, low: float, high: float) -> Column:
    return _c(col).between(low, high)


def valid_position(lat, lon) -> Column:
    return in_range(lat, -90, 90) & in_range(lon, -180, 180)


def entropy_of(counts) -> Column:
    """Shannon entropy (bits) of an array of counts; NULL if they sum to nothing."""
    c = _c(counts)
    total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    bits = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0))
    return F.when(total > 0, bits)


def percentile(col, q: float) -> Column:
    """Linear-interpolated percentile over non-null values."""
    return F.percentile(_c(col), F.lit(q))


def thinned(ms, k: int, offset: int = 0) -> Column:
    """True for the times that are `offset` more than a multiple of k: the same rows on every run, whatever the order."""
    return F.pmod(_c(ms), F.lit(k)) == F.lit(offset % k)


def sensitive_key(key: Column, patterns=SENSITIVE, allowed=ALLOWED_KEYS) -> Column:
    low = F.lower(key)
    hit = low.rlike("|".join(patterns))
    return hit & ~low.isin(*allowed) if allowed else hit


def redact_flat(col="data", patterns=SENSITIVE, allowed=ALLOWED_KEYS) -> Column:
    """A flat JSON object with the values of sensitive keys replaced; anything else becomes NULL."""
    clean = F.transform_values(json_object(col), lambda k, v: F.when(sensitive_key(k, patterns, allowed), REDACTED).otherwise(v))
    return F.to_json(clean)


def best_activity(col="data") -> Column:
    """struct(label, confidence): top-level keys, else the most confident item of `activities` (array, or array in a
    string; the first wins ties)."""
    c = _c(col)
    label = first_text(F.get_json_object(c, "$.activity_name"), F.get_json_object(c, "$.activity"))
    confidence = to_number(F.get_json_object(c, "$.confidence"))
    items = F.from_json(F.get_json_object(c, "$.activities"), "array<struct<activity:string,confidence:string>>")
    best = F.aggregate(
        F.transform(F.coalesce(items, F.array()), lambda x: F.struct(x["activity"].alias("label"), to_number(x["confidence"]).alias("confidence"))),
        F.lit(None).cast("struct<label:string,confidence:double>"),
        lambda a, x: F.when(a.isNull() | (F.coalesce(x["confidence"], F.lit(-1.0)) > F.coalesce(a["confidence"], F.lit(-1.0))), x).otherwise(a),
    )
    return F.when(label.isNotNull(), F.struct(label.alias("label"), confidence.alias("confidence"))).otherwise(best)


def register(spark: SparkSession) -> None:
    """SQL names for the library's own functions, as SQL functions that Catalyst inlines."""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE
        RETURN 2 * {EARTH_KM} * asin(sqrt(least(1.0D, pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION local_day(ms BIGINT, tz STRING) RETURNS DATE
        RETURN to_date(from_utc_timestamp(timestamp_millis(ms), tz))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION night_flag(ms BIGINT, tz STRING) RETURNS BOOLEAN
        RETURN hour(from_utc_timestamp(timestamp_millis(ms), tz)) >= 22 OR hour(from_utc_timestamp(timestamp_millis(ms), tz)) < 6""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION shannon_entropy(counts ARRAY<DOUBLE>) RETURNS DOUBLE
        RETURN aggregate(counts, 0.0D, (a, x) -> a + CASE WHEN x > 0 THEN -(x / aggregate(counts, 0.0D, (s, y) -> s + y)) * log2(x / aggregate(counts, 0.0D, (s, y) -> s + y)) ELSE 0.0D END)""")

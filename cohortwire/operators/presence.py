"""Days with rows as bitmaps: a device's days in a few bytes, for set operations and for adding new days.

A bitmap holds the days of one bucket of 32,768, so about ninety years are two rows a device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

BITMAP = ["bucket", "days", "first_day", "last_day"]


def _day_number(tz: str | None) -> Column:
    """Days since 1970: of UTC, or of the local date."""
    if tz is None:
        return F.floor(F.col("timestamp") / 86_400_000).cast("long")
    return F.unix_date(S.local_day("timestamp", tz)).cast("long")


def day_bitmaps(ev: DataFrame, keys: list[str] = ("device_id",), tz: str | None = None) -> DataFrame:
    """keys, bucket, days (bitmap), first_day, last_day: the days on which there are rows; combined before the shuffle."""
    rows = ev.select(*keys, _day_number(tz).alias("_day")).where("_day is not null")
    bucket = F.bitmap_bucket_number("_day")
    return rows.groupBy(*keys, bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_day")).alias("days"), F.min("_day").alias("first_day"), F.max("_day").alias("last_day")
    )


def merged_days(known: DataFrame, new: DataFrame, keys: list[str] = ("device_id",)) -> DataFrame:
    """Bitmaps of the days of either: new days are added to known ones without their events."""
    both = known.select(*keys, *BITMAP).unionByName(new.select(*keys, *BITMAP))
    return both.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("days").alias("days"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def day_counts(bitmaps: DataFrame, keys: list[str] = ("device_id",)) -> DataFrame:
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("days")).cast("long").alias("n_days"), F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))


def _bit(days: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(days, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def days_of(bitmaps: DataFrame, keys: list[str] = ("device_id",)) -> DataFrame:
    """keys, day (date): the days of the bitmaps, one row each."""
    days = bitmaps.select(*keys, "days", F.explode(F.sequence("first_day", "last_day")).alias("_day"))
    return days.filter(_bit(F.col("days"), F.bitmap_bit_position("_day"))).select(*keys, F.date_from_unix_date(F.col("_day").cast("int")).alias("day"))


def compared_days(a: DataFrame, b: DataFrame, keys: list[str] = ("device_id",)) -> DataFrame:
    """keys, n_a, n_b, n_both, n_only_a, n_only_b: days of two sets of bitmaps, from counts of each and of either."""
    n = lambda df, name: df.groupBy(*keys).agg(F.sum(F.bitmap_count("days")).cast("long").alias(name))
    out = n(merged_days(a, b, keys), "n_either").join(n(a, "n_a"), list(keys), "left").join(n(b, "n_b"), list(keys), "left")
    out = out.fillna(0, ["n_a", "n_b"]).withColumn("n_both", F.col("n_a") + F.col("n_b") - F.col("n_either"))
    return out.select(*keys, "n_a", "n_b", "n_both", (F.col("n_a") - F.col("n_both")).alias("n_only_a"), (F.col("n_b") - F.col("n_both")).alias("n_only_b"))

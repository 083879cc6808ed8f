"""Ranks and quantiles of whole tables by value ranges.

Approximate percentiles cut a group's values into ranges, and counts by range say how many values lie below each; exact
places are then found within ranges, all of which are dealt over tasks.  A value that is a cut is a range of its own,
whose rows need no order: so values that very many rows share cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import intermediate
from .rangejoin import small

#: Rows of a range, about, and the bounds of how many ranges there are.
RANGE_ROWS, FEWEST, MOST = 1_000_000, 16, 4096


def _range_no(value: Column, cuts: Column) -> Column:
    """2 i between the cuts i - 1 and i, 2 i + 1 on the cut i."""
    below = F.size(F.filter(cuts, lambda c: c < value))
    return F.when(value.isNotNull(), 2 * below + F.when(F.array_contains(cuts, value), 1).otherwise(0))


def _cut(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """rows (written) with the range of each column's value, {column}_range."""
    ranges = min(MOST, max(FEWEST, -(-rows.count() // RANGE_ROWS)))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.groupBy(*by).agg(*[F.array_distinct(F.percentile_approx(c, shares, F.lit(10 * ranges))).alias(f"_{c}_cuts") for c in columns])
    same = F.lit(True)
    for b in by:
        same = same & rows[b].eqNullSafe(F.col(f"_by_{b}"))
    out = rows.join(small(cuts.withColumnsRenamed({b: f"_by_{b}" for b in by})), same)
    return out.select(*rows.columns, *[_range_no(F.col(c), F.col(f"_{c}_cuts")).alias(f"{c}_range") for c in columns])


def _sizes(cut: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """by, column, range, size, below (rows in lower ranges) and n (of the group): one count of all columns."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_range").alias("range")) for c in columns])
    present = F.array_compact(F.transform(each, lambda e: F.when(e["range"].isNotNull(), e)))
    sizes = cut.select(*by, F.explode(present).alias("e")).groupBy(*by, "e.column", "e.range").agg(F.count(F.lit(1)).alias("size"))
    group = Window.partitionBy(*by, "column")
    before = group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # of ranges, not rows
    return sizes.select("*", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("below"), F.sum("size").over(group).alias("n"))


def placed(rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """rows with {column}_below, how many rows of the group have a smaller value, {column}_ties, how many have the same,
    and n, how many there are.  Values are not NULL; `by` may have no columns.

    The rows are written once.  Each column costs one exchange, by group and range; no task orders more than a range.
    """
    keep = rows.columns
    named = rows if by else rows.withColumn("_all", F.lit(0))
    by = list(by) or ["_all"]
    out = _cut(intermediate(named), columns, by)
    sizes = small(_sizes(out, columns, by))
    for c in columns:
        own = sizes.filter(F.col("column") == c).select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("range").alias("_range"), "size", "below", F.col("n").alias(f"_n_{c}"))
        same = F.col(f"{c}_range") == F.col("_range")
        for b in by:
            same = same & out[b].eqNullSafe(F.col(f"_by_{b}"))
        out = out.join(own, same).drop("_range", *[f"_by_{b}" for b in by])
        # Rows on a cut are all alike: their place is the range's, so they are dealt anywhere.
        on_cut = F.col(f"{c}_range") % 2 == 1
        spread = F.when(on_cut, F.spark_partition_id()).otherwise(F.lit(-1))
        out = out.withColumn("_spread", spread)
        within = Window.partitionBy(*by, f"{c}_range", "_spread").orderBy(c)
        alike = Window.partitionBy(*by, f"{c}_range", "_spread", c)
        below = F.col("below") + F.when(on_cut, F.lit(0)).otherwise(F.rank().over(within) - 1)
        ties = F.when(on_cut, F.col("size")).otherwise(F.count(F.lit(1)).over(alike))
        out = out.withColumns({f"{c}_below": below, f"{c}_ties": ties}).drop("_spread", "size", "below", f"{c}_range")
    return out.select(*keep, *[f"{c}_{what}" for c in columns for what in ("below", "ties")], F.col(f"_n_{columns[0]}").alias("n"))


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float], by: list[str], written: bool = False) -> DataFrame:
    """by and {column}_q0, {column}_q1, ...: interpolated quantiles of each column's values that are not NULL, as
    percentile() gives them; NULL for a column without any, and no row for a group without any value.

    Only the ranges that hold a wanted place are counted by value, so no task holds a column's values.
    """
    rows = rows.select(*by, *columns)
    cut = _cut(rows if written else intermediate(rows), columns, by)
    sizes = _sizes(cut, columns, by)
    place = lambda n, q: (n - 1) * F.lit(float(q))
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(F.col("n"), q)), F.ceil(place(F.col("n"), q))) for q in shares])))
    here = F.filter(wanted, lambda i: (i >= F.col("below")) & (i < F.col("below") + F.col("size")))
    picked = small(sizes.select(*[F.col(b).alias(f"_by_{b}") for b in by], "column", "range", "below", "n", here.alias("places")).filter(F.size("places") > 0))
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_range").alias("range"), F.col(c).cast("double").alias("value")) for c in columns])
    long = cut.select(*by, F.explode(each).alias("e")).select(*by, F.col("e.column").alias("_column"), F.col("e.range").alias("_range"), "e.value").where("value is not null")
    same = (F.col("_column") == F.col("column")) & (F.col("_range") == F.col("range"))
    for b in by:
        same = same & long[b].eqNullSafe(F.col(f"_by_{b}"))
    values = long.join(picked, same).groupBy(*by, "column", "range", "below", "n", "places", "value").agg(F.count(F.lit(1)).alias("ties"))
    before = Window.partitionBy(*by, "column", "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("first", F.col("below") + F.coalesce(F.sum("ties").over(before), F.lit(0)))
    hit = F.filter("places", lambda i: (i >= F.col("first")) & (i < F.col("first") + F.col("ties")))
    found = values.select(*by, "column", "n", "value", F.explode(hit).alias("place"))
    at = lambda c, i: F.max(F.when((F.col("column") == c) & (F.col("place") == i), F.col("value")))
    out = {}
    for c in columns:
        for k, q in enumerate(shares):
            h = place(F.col("n"), q)
            low, high = at(c, F.floor(h)), at(c, F.ceil(h))
            share = F.max(F.when(F.col("column") == c, h - F.floor(h)))
            out[f"{c}_q{k}"] = F.when(low == high, low).otherwise((1 - share) * low + share * high)
    return found.groupBy(*by).agg(*[v.alias(k) for k, v in out.items()])

"""Places and quantiles of value ranges against sorted lists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwire.operators import profiles as P
from cohortwire.operators import quality as Q
from cohortwire.operators import ranks as R
from cohortwire.operators import stats as T


@pytest.fixture(params=["one range", "many ranges"])
def ranges(request, monkeypatch):
    if request.param == "many ranges":
        monkeypatch.setattr(R, "RANGE_ROWS", 7)


def some_values(seed, n=300):
    rng = np.random.default_rng(seed)
    return [float(v) for v in [*rng.integers(0, 9, n), *rng.normal(size=n), *([3.0] * n)]]


def test_places_of_tied_values(spark, ranges):
    xs, ys = some_values(1), [round(v, 1) for v in some_values(2)]
    rows = [("f" if i % 3 else None, f"s{i}", x, y) for i, (x, y) in enumerate(zip(xs, ys))]
    df = spark.createDataFrame(rows, "feature string, subject_id string, x double, y double").repartition(6)
    got = R.placed(df, ["x", "y"], ["feature"]).collect()
    assert len(got) == len(rows)
    for feature in ("f", None):
        x, y = [np.array([r[k] for r in rows if r[0] == feature]) for k in (2, 3)]
        for r in (r for r in got if r.feature == feature):
            assert (r.x_below, r.x_ties, r.y_below, r.y_ties, r.n) == ((x < r.x).sum(), (x == r.x).sum(), (y < r.y).sum(), (y == r.y).sum(), len(x))


def test_places_without_groups(spark, ranges):
    xs = some_values(3, 50)
    df = spark.createDataFrame([(x,) for x in xs], "x double").repartition(4)
    got = R.placed(df, ["x"], [])
    assert got.columns == ["x", "x_below", "x_ties", "n"]
    assert sorted((r.x, r.x_below, r.x_ties) for r in got.collect()) == sorted((x, sum(v < x for v in xs), xs.count(x)) for x in xs)
    assert R.placed(df.limit(0), ["x"], []).isEmpty()


def test_a_value_of_many_rows_is_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    df = spark.range(0, 4000, 1, 8).select(F.lit("f").alias("feature"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    plan = R.placed(df, ["x"], ["feature"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "_spread" in plan


@pytest.mark.parametrize("shares", [[0.5], [0.0, 0.25, 0.5, 0.9, 1.0]])
def test_quantiles_are_those_of_percentile(spark, ranges, shares):
    rng = np.random.default_rng(4)
    rows = [(f, None if rng.random() < 0.1 else x, None if f == "b" else x * 2) for f, seed in (("a", 5), ("b", 6), (None, 7)) for x in some_values(seed, 70)]
    rows += [("one", 4.0, None), ("two", 1.0, 1.0), ("two", 4.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "feature string, x double, y double").repartition(5)
    got = {r.feature: r for r in R.exact_quantiles(df, ["x", "y"], shares, ["feature"]).collect()}
    want = df.groupBy("feature").agg(*[F.percentile(c, F.lit(q)).alias(f"{c}_q{k}") for c in "xy" for k, q in enumerate(shares)]).collect()
    for w in want:
        if w.feature == "none":
            assert "none" not in got
        else:
            assert [got[w.feature][c] for c in w.asDict() if c != "feature"] == pytest.approx([w[c] for c in w.asDict() if c != "feature"], nan_ok=True)


def test_summaries_and_variability(spark, ranges):
    rows = [("a", x) for x in some_values(8, 60)] + [("a", None), ("gone", None)]
    df = spark.createDataFrame(rows, "feature string, value double")
    xs = np.array([x for f, x in rows if x is not None])
    s = {r.feature: r for r in Q.numeric_summary(df).collect()}
    assert s["a"].median == np.median(xs) and s["a"].n == len(xs) and s["a"].zeros == (xs == 0).sum() and s["gone"].n == 0 and s["gone"].median is None
    v = {r.feature: r for r in P.variability(df).collect()}
    assert v["a"].iqr == pytest.approx(np.subtract(*np.percentile(xs, [75, 25]))) and v["gone"].iqr is None and v["a"].variability_rank == 1


def test_spearman_is_the_correlation_of_average_ranks(spark, ranges):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 20, 200).astype(float)
    y = x + rng.normal(size=200) * 5
    ranks = lambda v: np.array([(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v])
    df = spark.createDataFrame([("f", f"s{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("f", "z", None, 1.0)], "feature string, subject_id string, value double, y double")
    r = T.spearman_weights(df).first()
    assert r.rho == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1]) and r.n == 200 and r.n_values == len(set(x)) and r.weight == pytest.approx(1 + abs(r.rho))


def test_spearman_reads_its_rows_once(spark):
    df = spark.createDataFrame([("f", "s", 1.0, 2.0)] * 9, "feature string, subject_id string, value double, y double")
    plan = T.spearman_weights(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") <= 3

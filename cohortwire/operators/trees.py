"""Tree models fitted without each fold, and what a feature adds on the rows that a model has not seen."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import intermediate
from .stats import fit_preprocess

#: Settings of the forest and of the boosted trees.
FOREST = {"numTrees": 300, "maxDepth": 2, "minInstancesPerNode": 6, "featureSubsetStrategy": "0.7"}
BOOSTED = {"maxIter": 100, "stepSize": 0.03, "maxDepth": 2, "minInstancesPerNode": 8, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.7"}
SHUFFLES = 3
#: Rows of a task that fits trees, at least, and rows that one task puts in order.
FITTED_ROWS = 50_000
ORDERED_ROWS = 100_000


def estimators(y: str, seed: int = 7) -> dict:
    same = {"labelCol": y, "featuresCol": "features", "seed": seed}
    return {"random_forest": RandomForestRegressor(**FOREST, **same), "boosted_trees": GBTRegressor(**BOOSTED, **same)}


def in_hash_order(rows: DataFrame, by: list[str], key: str, seed: int, n: int) -> DataFrame:
    """rows with place: 0, 1, ... within `by` in the order of a hash of the key, the same on every run.

    Hashes are even, so rows are numbered within equal ranges of them and the ranges' sizes summed up; no task orders
    more than about ORDERED_ROWS rows.
    """
    ranges = max(1, -(-n // ORDERED_ROWS))
    h = F.xxhash64(key, F.lit(seed))
    rows = rows.withColumn("_hash", h).withColumn("_range", F.floor((h / F.lit(2.0**64) + 0.5) * ranges))
    sizes = rows.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # of ranges
    sizes = sizes.select(*by, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, "_range").orderBy("_hash", key)
    out = rows.join(F.broadcast(sizes), [*by, "_range"]).withColumn("place", F.col("_before") + F.row_number().over(within) - 1)
    return out.drop("_hash", "_range", "_before")


def dealt_anew(rows: DataFrame, by: list[str], key: str, values: str, seed: int, n: int) -> DataFrame:
    """rows with `dealt`: the `values` of another row of the same `by`, each row's going to exactly one."""
    to = in_hash_order(rows, by, key, seed=0, n=n)
    given = in_hash_order(rows.select(*by, key, F.col(values).alias("dealt")), by, key, seed, n).drop(key)
    return to.join(given, [*by, "place"]).drop("place")


def tree_cv(df: DataFrame, cols: list[str], y: str = "y", models: dict | None = None, shuffles: int = SHUFFLES, key: str = "subject_id", parallel: int = 8) -> tuple[DataFrame, DataFrame | None]:
    """(predictions, importance) of tree models, each fold's from models fitted on the others.

    predictions: key, fold, model, y, prediction.  importance: fold, model, feature, importance_mean, importance_std:
    how much the RMSE on the held-out rows rises when a feature's values are dealt out anew among them, over `shuffles`
    deals.  Features are median-imputed and standardised by the training rows, with missing__ indicators.  df has fold;
    rows without y take no part.  Folds are fitted side by side.  Without shuffles nothing is dealt and importance is None.
    """
    models = models or estimators(y)
    names = [*[f"{c}__z" for c in cols], *[f"missing__{c}" for c in cols]]
    kept = df.select(key, "fold", F.col(y).cast("double").alias(y), *cols).where(F.col(y).isNotNull()).persist()
    try:
        sizes = {r["fold"]: r["count"] for r in kept.groupBy("fold").count().collect()}  # a row a fold
        few = kept.coalesce(max(1, sum(sizes.values()) // FITTED_ROWS))  # as trees take many short jobs

        def prepared(fold: int) -> DataFrame:
            ready = VectorAssembler(inputCols=names, outputCol="features").transform(fit_preprocess(few, cols, fold))
            return ready.select(key, "fold", y, F.array(*[F.col(c).cast("double") for c in names]).alias("values"), "features")

        def fit(which: tuple[int, str]):
            fold, name = which
            return models[name].fit(ready[fold].filter(F.col("fold") != fold))

        pairs = [(fold, name) for name in models for fold in sorted(sizes)]
        with ThreadPoolExecutor(parallel) as pool:
            ready = dict(zip(sorted(sizes), pool.map(prepared, sorted(sizes)), strict=True))
            fitted = dict(zip(pairs, pool.map(fit, pairs), strict=True))
        # Every row as its own fold's models see it, while the rows are at hand.
        held = intermediate(reduce(DataFrame.unionByName, [rows.filter(F.col("fold") == fold).drop("features") for fold, rows in ready.items()]), "held-out")
    finally:
        kept.unpersist()

    def scored(rows: DataFrame) -> DataFrame:
        """rows(fold, values) with model and prediction, from the models that have not seen the fold."""
        rows = rows.withColumn("features", array_to_vector("values"))
        each = [m.transform(rows.filter(F.col("fold") == fold)).withColumn("model", F.lit(name)) for (fold, name), m in fitted.items()]
        return reduce(DataFrame.unionByName, each)

    predictions = scored(held).select(key, "fold", "model", y, "prediction")
    if not shuffles:
        return predictions, None

    # And with the values of others, dealt out for all folds at once.
    dealt = reduce(DataFrame.unionByName, [dealt_anew(held, ["fold"], key, "values", s, sum(sizes.values())).withColumn("shuffle", F.lit(s)) for s in range(1, shuffles + 1)])
    dealt = intermediate(dealt, "dealt")
    each = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    changed = each.withColumn("values", F.transform("values", lambda v, i: F.when(i == F.col("at"), F.col("dealt")[i]).otherwise(v)))
    error = F.col(y) - F.col("prediction")
    rmse = scored(changed).groupBy("fold", "model", "shuffle", "at").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    base = scored(held).groupBy("fold", "model").agg(F.sqrt(F.avg(error * error)).alias("base"))  # a row a fold and model
    gains = rmse.join(F.broadcast(base), ["fold", "model"]).withColumn("rise", F.col("rmse") - F.col("base"))
    feature = F.array(*[F.lit(c.removesuffix("__z")) for c in names])[F.col("at")]
    importance = gains.groupBy("fold", "model", feature.alias("feature")).agg(F.avg("rise").alias("importance_mean"), F.stddev_pop("rise").alias("importance_std"))
    return predictions, importance

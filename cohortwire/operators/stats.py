"""Statistics and models from distributed sums.

Rows are never gathered: a pass over the data gives sums per fold (k x k at most), and only those are solved.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import placed
from .ridge import ALPHAS


# ------------------------------------------------------------------------------------------- folds and baselines


def assign_folds(df: DataFrame, k: int = 5, repeats: int = 1, key: str = "subject_id") -> DataFrame:
    """A row per row and repeat with its fold: a hash of the key and the repeat, the same on every run."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, "repeat"), F.lit(k)).cast("int"))


def mean_baseline_oof(df: DataFrame, y: str = "y") -> DataFrame:
    """prediction: the mean of y over the other folds, from totals less the fold's own sums."""
    fold = Window.partitionBy("repeat", "fold")
    whole = Window.partitionBy("repeat")
    s = lambda w: F.sum(y).over(w)
    n = lambda w: F.count(y).over(w)
    if df.columns and "fold" in df.columns:
        sums = df.groupBy("repeat", "fold").agg(F.sum(y).alias("s"), F.count(y).alias("n"))
        totals = sums.select("repeat", "fold", ((F.sum("s").over(whole) - F.col("s")) / (F.sum("n").over(whole) - F.col("n"))).alias("prediction"))
        return df.join(F.broadcast(totals), ["repeat", "fold"])
    return df.withColumn("prediction", (s(whole) - s(fold)) / (n(whole) - n(fold)))


def fit_preprocess(df: DataFrame, cols: list[str], test_fold: int | None = None) -> DataFrame:
    """Columns imputed by the training rows' median, with missing__ indicators, standardised by their mean and
    population SD; training rows are those outside test_fold."""
    train = df if test_fold is None else df.filter(F.col("fold") != test_fold)
    medians = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in cols]).first()
    fill = {c: (medians[c] if medians[c] is not None else 0.0) for c in cols}
    imputed = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float(fill[c])))
    stats = train.agg(*[x for c in cols for x in (F.avg(imputed(c)).alias(f"{c}__m"), F.stddev_pop(imputed(c)).alias(f"{c}__s"))]).first()
    out = {f"missing__{c}": F.col(c).isNull().cast("int") for c in cols}
    for c in cols:
        sd = stats[f"{c}__s"] or 1.0
        out[f"{c}__z"] = (imputed(c) - F.lit(stats[f"{c}__m"] or 0.0)) / F.lit(sd)
    return df.withColumns(out)


# ------------------------------------------------------------------------------------------------- ridge by sums


def gram_by_fold(df: DataFrame, cols: list[str], y: str, by: list[str] = ("repeat", "fold")) -> list[dict]:
    """Sums of products of (1, cols, y) by fold in one aggregation: k * k / 2 numbers for each fold."""
    names = ["_one", *cols, y]
    rows = df.select(*by, F.lit(1.0).alias("_one"), *[F.col(c).cast("double").alias(c) for c in [*cols, y]]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = rows.groupBy(*by).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs])
    out = []
    for r in sums.collect():  # a row per fold
        g = np.zeros((len(names), len(names)))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"s{i}_{j}"] or 0.0
        out.append({"key": tuple(r[b] for b in by), "gram": g})
    return out


def solve_ridge(gram: np.ndarray, alpha: float, signs: np.ndarray | None = None, rounds: int = 500) -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of the standardised ridge from sums of (1, x, y); signs: projected to a sign each."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 1e-12))
    a = xx / np.outer(sd, sd) + alpha * np.eye(len(sd))
    b = xy / sd
    w = np.linalg.solve(a, b)
    if signs is not None:
        w = np.where(w * signs < 0, 0.0, w)
        for _ in range(rounds):  # coordinate descent on the constrained problem
            before = w.copy()
            for i in range(len(w)):
                step = (b[i] - a[i] @ w + a[i, i] * w[i]) / a[i, i]
                w[i] = step if step * signs[i] > 0 or signs[i] == 0 else 0.0
            if np.abs(w - before).max() < 1e-10:
                break
    beta = w / sd
    return float(mean[-1] - beta @ mean[:-1]), beta


def _squared_error(gram: np.ndarray, intercept: float, beta: np.ndarray) -> float:
    v = np.concatenate([[intercept], beta, [-1.0]])
    return float(v @ gram @ v)


def imputed_by_fold(df: DataFrame, cols: list[str]) -> DataFrame:
    """df once for every fold that may be held out (`held`), with its NULLs replaced by the medians of the other folds'
    rows, 0 for a column that has none, and with missing__ indicators."""
    folds = df.select("repeat", F.col("fold").alias("held")).distinct()
    rows = df.join(F.broadcast(folds), "repeat")  # as many rows as folds for each repeat
    medians = rows.filter("fold <> held").groupBy("repeat", "held").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in cols])
    rows = rows.join(F.broadcast(medians), ["repeat", "held"], "left")
    made = {f"missing__{c}": F.col(c).isNull().cast("double") for c in cols}
    made |= {c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}"), F.lit(0.0)) for c in cols}
    return rows.withColumns(made).drop(*[f"_m_{c}" for c in cols])


def ridge_cv(df: DataFrame, cols: list[str], y: str = "y", alphas=ALPHAS, signs: dict[str, int] | None = None, impute: bool = False) -> tuple[DataFrame, list[dict]]:
    """Out-of-fold predictions and coefficients.  Alpha is the one of least summed error over the training folds, each
    held out in turn; every model comes from sums of the other folds' sums.  df has repeat and fold.

    With impute, NULLs become the training folds' medians, beside indicators of where they were; without, rows with a
    NULL take no part in the sums.
    """
    rows = imputed_by_fold(df, cols) if impute else df.withColumn("held", F.lit(-1))
    used = [*cols, *(f"missing__{c}" for c in cols)] if impute else cols
    sign = np.array([signs.get(c, 0) for c in used], float) if signs else None
    sums = gram_by_fold(rows, used, y, ["repeat", "fold", "held"])
    coefs = []
    for repeat, fold in sorted({f["key"][:2] for f in sums}):
        others = [g for g in sums if g["key"][0] == repeat and g["key"][1] != fold and g["key"][2] in (-1, fold)]
        if not others:
            continue
        total = sum(g["gram"] for g in others)

        def error(alpha):
            parts = [(g["gram"], total - g["gram"]) for g in others if len(others) > 1]  # noqa: B023
            return sum(_squared_error(test, *solve_ridge(train, alpha, sign)) for test, train in parts)

        alpha = min(alphas, key=error)
        intercept, beta = solve_ridge(total, alpha, sign)
        coefs.append({"repeat": repeat, "fold": fold, "alpha": float(alpha), "intercept": intercept, "beta": [float(b) for b in beta]})
    spark = df.sparkSession
    table = spark.createDataFrame(coefs, "repeat int, fold int, alpha double, intercept double, beta array<double>")
    out = (rows.filter("fold = held") if impute else rows).drop("held").join(F.broadcast(table), ["repeat", "fold"])
    dot = F.col("intercept")
    for i, c in enumerate(used):
        dot = dot + F.col("beta")[i] * F.col(c)
    return out.withColumn("prediction", dot).drop("intercept", "beta"), coefs


def signed_ridge_cv(df: DataFrame, cols: list[str], signs: dict[str, int], y: str = "y", alphas=ALPHAS):
    return ridge_cv(df, cols, y, alphas, signs)


# ---------------------------------------------------------------------------------------------------- evaluation


def metrics(pred: DataFrame, y: str = "y", by: list[str] = ("model", "repeat")) -> DataFrame:
    """RMSE, MAE and R2 by model and repeat, and pooled over repeats (repeat NULL), in one roll-up."""
    error = F.col(y) - F.col("prediction")
    out = pred.where(F.col(y).isNotNull() & F.col("prediction").isNotNull()).rollup(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.sum(error * error) / F.nullif(F.var_pop(y) * F.count(F.lit(1)), F.lit(0.0))).alias("r2"), F.grouping_id().alias("_g"),
    )
    return out.filter(F.col("_g") < 2 ** len(by) - 1).drop("_g")


def calibration(pred: DataFrame, y: str = "y", by: list[str] = ("model",)) -> DataFrame:
    """Slope, intercept and correlation of y on the prediction."""
    return pred.groupBy(*by).agg(F.regr_slope(y, "prediction").alias("slope"), F.regr_intercept(y, "prediction").alias("intercept"), F.corr(y, "prediction").alias("correlation"), F.count(F.lit(1)).alias("n"))


def quartile_bins(df: DataFrame, col: str, by: list[str] = (), out: str = "bin") -> DataFrame:
    """Bins 0..3 by interpolated value cuts; equal cuts make fewer bins."""
    q = [F.percentile(col, F.lit(p)) for p in (0.25, 0.5, 0.75)]
    cuts = df.groupBy(*by).agg(F.array_distinct(F.array(*q)).alias("_cuts"), F.max(col).alias("_top")) if by else df.agg(F.array_distinct(F.array(*q)).alias("_cuts"), F.max(col).alias("_top"))
    rows = df.join(F.broadcast(cuts), list(by)) if by else df.join(F.broadcast(cuts))
    n = F.size(F.filter("_cuts", lambda c: (c < F.col(col)) & (c < F.col("_top"))))
    return rows.withColumn(out, F.when(F.col(col).isNotNull(), n.cast("int"))).drop("_cuts", "_top")


def calibration_bins(pred: DataFrame, y: str = "y") -> DataFrame:
    return quartile_bins(pred, "prediction", ["model"]).groupBy("model", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg(y).alias("mean_y"))


def coef_stability(coefs: DataFrame) -> DataFrame:
    """Of (feature, coefficient) over fits: mean, SD, median, share above 0."""
    c = F.col("coefficient")
    return coefs.groupBy("feature").agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"), F.percentile(c, F.lit(0.5)).alias("median"), F.avg((c > 0).cast("double")).alias("positive_fraction"), F.count(c).alias("n"))


def quartile_slopes(long: DataFrame, y: str = "y", least_rows: int = 8, least_values: int = 4, least_groups: int = 3, n_up: int = 5, n_down: int = 3) -> DataFrame:
    """Slope of the median y over the value-quartile groups of each feature, and the strongest selected."""
    rows = long.where(F.col("value").isNotNull() & F.col(y).isNotNull())
    fit = rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_values"))
    groups = quartile_bins(rows, "value", ["feature"]).groupBy("feature", "bin").agg(F.percentile(y, F.lit(0.5)).alias("median_y"))
    slopes = groups.groupBy("feature").agg(F.regr_slope("median_y", "bin").alias("slope"), F.count(F.lit(1)).alias("n_groups"))
    out = fit.join(slopes, "feature").filter((F.col("n") >= least_rows) & (F.col("n_values") >= least_values) & (F.col("n_groups") >= least_groups))
    up = F.row_number().over(Window.orderBy(F.desc("slope"), "feature"))
    down = F.row_number().over(Window.orderBy("slope", "feature"))
    chosen = ((F.col("slope") > 0) & (up <= n_up)) | ((F.col("slope") < 0) & (down <= n_down))
    return out.withColumn("selected", chosen)


def spearman_assoc(long: DataFrame, y: str = "y", strongest: int | None = None) -> DataFrame:
    """Spearman correlation of each feature with y over its complete rows: correlation of average ranks."""
    rows = long.where(F.col("value").isNotNull() & F.col(y).isNotNull()).select("feature", F.col("value").alias("x"), F.col(y).alias("y"))
    middle = lambda c: F.col(f"{c}_below") + (F.col(f"{c}_ties") + 1) / 2.0
    out = placed(rows, ["x", "y"], ["feature"]).groupBy("feature").agg(
        F.corr(middle("x"), middle("y")).alias("rho"), F.count(F.lit(1)).alias("n"), F.round(F.sum(1.0 / F.col("x_ties"))).cast("long").alias("n_values")
    )
    return out if strongest is None else out.orderBy(F.desc(F.abs("rho")), "feature").limit(strongest)


def spearman_weights(long: DataFrame, y: str = "y") -> DataFrame:
    """weight 1 + |rho| with at least 5 rows and 2 different values, else 1."""
    rho = F.when((F.col("n") >= 5) & (F.col("n_values") >= 2), F.coalesce("rho", F.lit(0.0))).otherwise(0.0)
    return spearman_assoc(long, y).withColumn("weight", 1 + F.abs(rho))


def standardised_trend(long: DataFrame, y: str = "y") -> DataFrame:
    """Median of each feature's z-values over the quartiles of y."""
    return quartile_bins(_scaled(long.where("value is not null")), y).groupBy("feature", "bin").agg(F.percentile("z", F.lit(0.5)).alias("median_z"), F.count(F.lit(1)).alias("n"))


def rank_trend(long: DataFrame, score: str = "y") -> DataFrame:
    """Slope of each feature over the subjects' rank by score, largest first, ties by id."""
    rows = long.where(F.col("value").isNotNull() & F.col(score).isNotNull()).withColumn("_s", -F.col(score))
    tie = F.row_number().over(Window.partitionBy("feature", "_s").orderBy("subject_id"))
    rows = placed(rows, ["_s"], ["feature"]).withColumn("rank_no", F.col("_s_below") + tie)
    return rows.groupBy("feature").agg(F.regr_slope("value", "rank_no").alias("slope"), F.regr_r2("value", "rank_no").alias("r2"), F.count(F.lit(1)).alias("n"))


def change_estimates(t1: DataFrame, t2: DataFrame, observed: DataFrame) -> DataFrame:
    """Estimated change (est. T2 - est. T1) beside the observed one and the mean-change baseline."""
    both = t1.select("subject_id", F.col("prediction").alias("est_t1")).join(t2.select("subject_id", F.col("prediction").alias("est_t2")), "subject_id")
    both = both.join(observed.select("subject_id", "y"), "subject_id").withColumn("prediction", F.col("est_t2") - F.col("est_t1"))
    mean = observed.agg(F.avg("y").alias("m"))
    base = observed.select("subject_id", "y").join(F.broadcast(mean)).select("subject_id", "y", F.col("m").alias("prediction"), F.lit("mean_change").alias("model"))
    return both.select("subject_id", "y", "prediction", F.lit("independent").alias("model")).unionByName(base)


# --------------------------------------------------------------------------------------------------- Spark MLlib


def _vectors(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="skip").transform(df)


def imputed(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with NULL and NaN in cols replaced by the column's median, 0 where there is none."""
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    medians = df.agg(*[F.percentile(value(c), F.lit(0.5)).alias(c) for c in cols]).first()
    return df.withColumns({c: F.coalesce(value(c), F.lit(float(medians[c] or 0.0))) for c in cols})


def pca(df: DataFrame, cols: list[str], k: int = 10):
    """(scores as array column pcs, loadings, explained variance) of the columns, median-imputed and standardised: at most
    k components, and fewer than there are rows; signs are not defined."""
    ready = _vectors(imputed(df, cols), cols)
    k = max(1, min(k, len(cols), df.count() - 1))
    scaled = StandardScaler(inputCol="features", outputCol="z", withMean=True).fit(ready).transform(ready)
    model = PCA(k=k, inputCol="z", outputCol="pc").fit(scaled)
    return model.transform(scaled).withColumn("pcs", vector_to_array("pc")), model.pc.toArray(), model.explainedVariance.toArray()


def adjusted_rand(pairs: DataFrame, a: str, b: str) -> float:
    """From the contingency table's counts: three sums of n choose 2."""
    c2 = lambda n: n * (n - 1) / 2.0
    table = pairs.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = table.agg(F.sum(c2(F.col("n")))).first()[0] or 0.0
    one = table.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n")))).first()[0] or 0.0
    two = table.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c2(F.col("n")))).first()[0] or 0.0
    n = table.agg(F.sum("n")).first()[0] or 0
    expected = one * two / c2(n) if n > 1 else 0.0
    top = (one + two) / 2 - expected
    return 1.0 if top == 0 else (both - expected) / top


def pairwise_rand(labels: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, rand: the adjusted Rand index of every two columns of labels, all from one count of label pairs."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    counts = labels.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.a", "p.b", "p.x", "p.y").agg(F.count(F.lit(1)).alias("n"))
    c2 = lambda n: n * (n - 1) / 2.0
    one, two = Window.partitionBy("a", "b", "x"), Window.partitionBy("a", "b", "y")  # as many rows as labels
    counts = counts.withColumn("nx", F.sum("n").over(one)).withColumn("ny", F.sum("n").over(two))
    sums = counts.groupBy("a", "b").agg(
        F.sum(c2(F.col("n"))).alias("both"), F.sum(c2(F.col("nx")) * F.col("n") / F.col("nx")).alias("one"), F.sum(c2(F.col("ny")) * F.col("n") / F.col("ny")).alias("two"), F.sum("n").alias("all")
    )
    expected = F.when(F.col("all") > 1, F.col("one") * F.col("two") / c2(F.col("all"))).otherwise(0.0)
    top = (F.col("one") + F.col("two")) / 2 - expected
    return sums.select("a", "b", F.when(top == 0, 1.0).otherwise((F.col("both") - expected) / top).alias("rand"))


def _scaled(long: DataFrame) -> DataFrame:
    """long with z: the value less its feature's mean by its population SD, from one aggregate and a join."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"))
    return long.join(F.broadcast(stats), "feature").withColumn("z", (F.col("value") - F.col("_mean")) / F.nullif(F.col("_sd"), F.lit(0.0))).drop("_mean", "_sd")


def cluster_profile(long: DataFrame, least_observed: float = 0.0) -> DataFrame:
    """Per cluster and feature: mean z, percent missing, mean and median, and the feature's rank by the spread of its
    z-means.  long: subject_id, cluster, feature, value."""
    if least_observed > 0:
        seen = long.groupBy("subject_id").agg((F.count("value") / F.count(F.lit(1))).alias("_o"))
        long = long.join(seen.filter(F.col("_o") >= least_observed).select("subject_id"), "subject_id", "left_semi")
    v: Column = F.col("value")
    rows = _scaled(long).groupBy("cluster", "feature").agg(
        F.avg("z").alias("z_mean"), (100.0 * F.count_if(v.isNull()) / F.count(F.lit(1))).alias("missing_pct"), F.avg(v).alias("mean"), F.percentile("value", F.lit(0.5)).alias("median")
    )
    w = Window.partitionBy("feature")  # as many rows as clusters
    rows = rows.withColumn("z_spread", F.max("z_mean").over(w) - F.min("z_mean").over(w))
    return rows.withColumn("spread_rank", F.dense_rank().over(Window.orderBy(F.desc_nulls_last("z_spread"))).cast("long"))

"""Models of several targets and tree models, against direct computation."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from cohortwire.operators import ridge as R
from cohortwire.operators import stats as M
from cohortwire.operators import trees as T


def direct_ridge(x, y, alpha, test, sd=None):
    """Median-imputed with indicators by the training rows, standardised, solved; predictions of test."""
    fill = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    made = lambda v: np.column_stack([np.where(np.isnan(v), fill, v), np.isnan(v)])
    a, b = made(x), made(test)
    mean, sd = a.mean(0), a.std(0)
    unit = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    z = (a - mean) * unit
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + ((b - mean) * unit) @ w, z


def direct_alpha(x, y, folds, alphas):
    _, z = direct_ridge(x, y, 1.0, x)
    errors = []
    for alpha in alphas:
        rmse = []
        for f in np.unique(folds):
            train, test = z[folds != f], z[folds == f]
            t = y[folds != f]
            centred = train - train.mean(0)
            w = np.linalg.solve(centred.T @ centred + alpha * np.eye(z.shape[1]), centred.T @ (t - t.mean()))
            rmse.append(np.sqrt(np.mean((y[folds == f] - t.mean() - (test - train.mean(0)) @ w) ** 2)))
        errors.append(np.mean(rmse))
    return alphas[int(np.argmin(errors))]


def make(n=160, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 5] + [0, 100, 3, -7]
    y1 = x @ [1.0, 0.3, -4.0, 0.0] + rng.normal(size=n)
    y2 = x @ [0.0, -0.2, 0.0, 1.0] + rng.normal(size=n)
    x[rng.random((n, 4)) < 0.15] = np.nan
    x[:, 3] = np.where(np.arange(n) < 40, np.nan, x[:, 3])  # a column without a value in the smallest cohort
    y2[rng.random(n) < 0.2] = np.nan
    folds = rng.integers(0, 5, (2, n))
    return x, y1, y2, folds


def as_frame(spark, x, y1, y2, folds):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(f"s{i}", r, int(folds[r, i]), i + 1, *map(none, x[i]), none(y1[i]), none(y2[i])) for r in range(len(folds)) for i in range(len(x))]
    return spark.createDataFrame(rows, "subject_id string, repeat int, fold int, coverage_rank int, a double, b double, c double, d double, y1 double, y2 double").repartition(5)


DOMAINS = {"one": ("y1", ["a", "b"]), "two": ("y2", ["b", "d"]), "three": ("y1", ["c"])}


@pytest.mark.parametrize("alphas", [(3.0,), R.ALPHAS])
def test_target_models_equal_direct_ridge(spark, alphas):
    x, y1, y2, folds = make()
    df = as_frame(spark, x, y1, y2, folds)
    got = {(r.cohort, r.domain, r.model, r.repeat, r.subject_id): (r.prediction, r.alpha, r.y) for r in R.target_models(df, DOMAINS, {"top": 40, "full": None}, alphas=alphas).collect()}
    seen = 0
    for cohort, n in (("top", 40), ("full", len(x))):
        for domain, (target, cols) in DOMAINS.items():
            y = {"y1": y1, "y2": y2}[target][:n]
            valid = ~np.isnan(y)
            for repeat in range(2):
                fold = folds[repeat, :n][valid]
                for model, used in (("ridge", "abdc"), ("domain_group_ridge", cols)):
                    own, t = x[:n][valid][:, ["abcd".index(c) for c in used]], y[valid]
                    for held in np.unique(fold):
                        train = fold != held
                        alpha = direct_alpha(own[train], t[train], fold[train], alphas) if len(alphas) > 1 else alphas[0]
                        want, _ = direct_ridge(own[train], t[train], alpha, own[~train])
                        for i, w in zip(np.flatnonzero(valid)[~train], want):
                            prediction, its_alpha, its_y = got[cohort, domain, model, repeat, f"s{i}"]
                            assert its_alpha == pytest.approx(alpha) and its_y == y[i] and prediction == pytest.approx(w, rel=1e-6, abs=1e-6)
                            seen += 1
                for held in np.unique(fold):
                    for i in np.flatnonzero(valid)[fold == held]:
                        assert got[cohort, domain, "mean_baseline", repeat, f"s{i}"][0] == pytest.approx(y[valid][fold != held].mean())
                        seen += 1
    assert seen == len(got)


def test_domain_metrics_by_repeat_and_pooled(spark):
    x, y1, y2, folds = make()
    pred = R.target_models(as_frame(spark, x, y1, y2, folds), DOMAINS, alphas=(3.0,)).cache()
    rows = pred.filter("domain = 'two' and model = 'ridge'").toPandas()
    got = {r.repeat: r for r in R.domain_metrics(pred).filter("domain = 'two' and model = 'ridge'").collect()}
    assert set(got) == {0, 1, None}
    for repeat, own in ((0, rows[rows.repeat == 0]), (1, rows[rows.repeat == 1]), (None, rows)):
        e = own.y - own.prediction
        assert got[repeat].n == len(own) and got[repeat].rmse == pytest.approx(np.sqrt((e**2).mean()))
        assert got[repeat].r2 == pytest.approx(1 - (e**2).sum() / ((own.y - own.y.mean()) ** 2).sum())
    pred.unpersist()


def test_models_without_rows_or_targets(spark):
    empty = as_frame(spark, *make(1)).limit(0)
    assert R.target_models(empty, DOMAINS).isEmpty()
    x, y1, y2, folds = make(30)
    none = R.target_models(as_frame(spark, x, y1, np.full(30, np.nan), folds), DOMAINS, alphas=(1.0,))
    assert {r.domain for r in none.select("domain").distinct().collect()} == {"one", "three"}


def test_sums_of_many_keys_are_let_go_in_time(spark, monkeypatch):
    x, y1, y2, folds = make(90)
    df = as_frame(spark, x, y1, y2, folds)
    whole = {(r.repeat, r.at): r.s for r in R.basis_sums(df, ["repeat"], ["a", "b"], ["y1"]).collect()}
    basis = np.column_stack([np.ones(90), np.nan_to_num(x[:, :2]), np.isnan(x[:, :2]), y1])
    want = (basis.T @ basis)[np.triu_indices(6)]
    assert np.allclose([whole[1, i] for i in range(len(want))], want)


def test_hash_order_is_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(T, "ORDERED_ROWS", 50)
    df = spark.range(1000).select(F.col("id").cast("string").alias("subject_id"), (F.col("id") % 3).cast("int").alias("fold"))
    got = T.in_hash_order(df, ["fold"], "subject_id", 5, 400).collect()
    for fold in range(3):
        places = sorted((r.place, r.subject_id) for r in got if r.fold == fold)
        assert [p for p, _ in places] == list(range(len(places)))
        assert [s for _, s in places] != sorted(s for _, s in places)
    dealt = T.dealt_anew(df.withColumn("values", F.array(F.col("subject_id").cast("double"))), ["fold"], "subject_id", "values", 1, 400).collect()
    assert sorted(r.subject_id for r in dealt) == sorted(str(int(r.dealt[0])) for r in dealt)
    assert all(int(r.dealt[0]) % 3 == r.fold for r in dealt) and sum(r.subject_id != str(int(r.dealt[0])) for r in dealt) > 950


def test_trees_are_scored_on_rows_that_they_have_not_seen(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", i % 3, float(a), float(b), None if i % 11 == 0 else float(c), float(np.sign(a) * 5 + c)) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "subject_id string, fold int, a double, noise double, c double, y double")
    tree = {"tree": DecisionTreeRegressor(labelCol="y", featuresCol="features", maxDepth=4)}
    pred, importance = T.tree_cv(df, ["a", "noise", "c"], models=tree)
    assert pred.count() == 300
    # By hand: the same tree fitted on the rows of two folds.
    prepared = M.fit_preprocess(df, ["a", "noise", "c"], 0)
    names = ["a__z", "noise__z", "c__z", "missing__a", "missing__noise", "missing__c"]
    v = M._vectors(prepared, names)
    model = tree["tree"].fit(v.filter("fold <> 0"))
    want = {r.subject_id: r.prediction for r in model.transform(v.filter("fold = 0")).collect()}
    assert {r.subject_id: r.prediction for r in pred.filter("fold = 0").collect()} == pytest.approx(want)
    found = {(r.fold, r.feature): r.importance_mean for r in importance.collect()}
    assert set(found) == {(f, c) for f in range(3) for c in ["a", "noise", "c", "missing__a", "missing__noise", "missing__c"]}
    for f in range(3):
        assert found[f, "a"] > 2 and found[f, "missing__a"] == pytest.approx(0, abs=1e-9)
        assert found[f, "a"] > found[f, "c"] > found[f, "noise"]


def test_components_of_columns_with_nulls(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 5))
    x[rng.random((80, 5)) < 0.1] = np.nan
    df = spark.createDataFrame([(f"s{i}", *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "subject_id string, a double, b double, c double, d double, e double")
    scores, loadings, explained = M.pca(df, list("abcde"))
    full = np.where(np.isnan(x), np.nanmedian(x, 0), x)
    z = (full - full.mean(0)) / full.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    assert scores.count() == 80 and loadings.shape == (5, 5)
    assert np.allclose(explained, values[::-1] / values.sum())
    assert np.allclose(np.abs((loadings * vectors[:, ::-1]).sum(0)), 1, atol=1e-6)


def test_elastic_net_meets_its_conditions():
    """At the optimum the gradient of the smooth part equals the penalty's slope, or stays within it where w is 0."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6)) @ np.triu(np.ones((6, 6)))
    x = np.column_stack([x, np.full(120, 7.0)])  # a column that doesn't vary
    y = x[:, 0] - 0.5 * x[:, 3] + rng.normal(size=120) + 4
    basis = np.column_stack([np.ones(120), x, y])
    grid = [(r, a) for r in R.RATIOS for a in (0.05, 0.3, 1.0, 30.0)]
    intercepts, betas = R.solved_elastic(basis.T @ basis, grid)
    sd = np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z = (x - x.mean(0)) / sd
    for (ratio, alpha), intercept, beta in zip(grid, intercepts, betas):
        w = beta * sd
        assert intercept == pytest.approx(y.mean() - beta @ x.mean(0)) and w[-1] == 0
        slope = z.T @ (y - y.mean() - z @ w) / 120 - alpha * (1 - ratio) * w
        used = w != 0
        assert np.allclose(slope[used], alpha * ratio * np.sign(w[used]), atol=1e-6) and (np.abs(slope[~used]) <= alpha * ratio + 1e-6).all()
    assert (betas[-1] == 0).all() and (betas[0] != 0).sum() > 2


def test_kmeans_side_by_side(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from cohortwire.operators import clusters as K

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 2)) * 0.3 + c for c in ((0, 0), (5, 0), (0, 5))] + [np.array([[9.0, 9.0]])])
    df = spark.createDataFrame([(f"s{i}", list(map(float, r))) for i, r in enumerate(x)], "subject_id string, x array<double>").repartition(4)
    models = K.fitted(df.select("x"), 2, [K.first_centres(x, k, np.random.default_rng(k)) for k in (2, 3, 5)])
    sums = K._summed(df.select("x"), 2, models)
    silhouettes, (table,) = K._compared(df.select("x"), 2, models, sums, [(0, 2)])
    labels, distances = K._labels(x, models)
    for m, (centres, label) in enumerate(zip(models, labels)):
        for j in range(len(centres)):  # a fixed point: every centre is the mean of its points
            assert np.allclose(centres[j], x[label == j].mean(0), atol=2e-4) and sums[m][j, 0] == (label == j).sum()
        assert sums[m][:, -1].sum() == pytest.approx(distances[m].sum())
        rows = spark.createDataFrame([(list(map(float, p)), float(c)) for p, c in zip(x, label)], "x array<double>, prediction double").withColumn("features", array_to_vector("x"))
        assert silhouettes[m] == pytest.approx(ClusteringEvaluator().evaluate(rows))
    pairs = spark.createDataFrame([(int(a), int(b)) for a, b in zip(labels[0], labels[2])], "a int, b int")
    assert K.rand_index(table) == pytest.approx(M.adjusted_rand(pairs, "a", "b"))
    got = {r.k: r for r in K.kmeans_stability(df.filter("x[0] < 8"), "x", ks=(2, 3, 4), seeds=4).collect()}
    assert got[3].best and got[3].rand_min == 1.0 and got[3].silhouette_mean > 0.9 and got[2].silhouette_mean < got[3].silhouette_mean
    assert K.kmeans_stability(df.limit(0), "x").isEmpty()


def test_means_of_equal_rows_are_equal_in_any_order(spark, tmp_path):
    """Their mean, 263301.80125, is a tie at four digits: sums of doubles in these two orders fall on different sides."""
    from cohortwire.plans import stand_ins as A

    one = [186783.44, 318282.23, 296219.53, 12573.09, 296973.01, 249537.78, 369007.67, 377037.66]
    other = [12573.09, 318282.23, 369007.67, 296973.01, 249537.78, 296219.53, 186783.44, 377037.66]
    assert sorted(one) == sorted(other)
    rows = [(k, p) for k, prices in ((1, one), (2, other), (3, [float("nan"), 1.0])) for p in prices]
    spark.createDataFrame(rows, "o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(k, 5.0, "A", 0) for k in (1, 2, 3, 4)]
    spark.createDataFrame(customers, "c_custkey long, c_acctbal double, c_mktsegment string, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.subject_id: r.mean_price for r in A.cohort(spark, str(tmp_path)).collect()}
    assert got["C00001"] == got["C00002"] == 263301.8013
    assert np.isnan(got["C00003"]) and got["C00004"] is None


def test_labels_hold_few_distances_at_once():
    """Labels of 20,000 points by 1,400 centres are the nearest centres, without all 28 million distances at once (224 MB)."""
    import tracemalloc

    from cohortwire.operators import clusters as K

    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 10))
    models = [rng.normal(size=(k, 10)) for k in (2, 3, 4, 5) for _ in range(100)]
    tracemalloc.start()
    labels, distances = K._labels(x, models)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for at in (0, 150, 399):
        d = ((x[:, None] - models[at][None]) ** 2).sum(2)
        assert (labels[at] == d.argmin(1)).all() and np.allclose(distances[at], d.min(1))
    assert most < 200e6  # labels and distances are 128 MB


def test_predictions_alone_deal_nothing(spark, monkeypatch):
    rows = [(f"s{i}", i % 2, float(i % 7), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "subject_id string, fold int, a double, y double")
    tree = {"tree": DecisionTreeRegressor(labelCol="y", featuresCol="features", maxDepth=2)}
    want = sorted(map(tuple, T.tree_cv(df, ["a"], models=tree)[0].collect()))
    monkeypatch.setattr(T, "dealt_anew", None)
    found, importance = T.tree_cv(df, ["a"], models=tree, shuffles=0)
    assert sorted(map(tuple, found.collect())) == want and importance is None

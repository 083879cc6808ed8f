"""Queries: statistics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as K
from ..operators import coverage as C
from ..operators import ridge as R
from ..operators import stats as M
from ..operators import trees as T
from . import stand_ins as A
from .register import Register, rounded

REGISTER = query = Register()


def _folded(spark, sf_dir):
    """Customers with orders; folds by number, so that the SQL has the same."""
    co = A.cohort(spark, sf_dir).dropna(subset=["y", "n_orders", "mean_price"])
    return co.withColumn("repeat", F.lit(0)).withColumn("fold", (A.number("subject_id") % 5).cast("int")).withColumn("mean_price", F.col("mean_price") / 1000).withColumn("max_price", F.col("max_price") / 1000)


_FOLDED = f"{A.COHORT}, fo AS (SELECT subject_id, y, n_orders, mean_price / 1000 AS mean_price, CAST(substr(subject_id, 2) AS INTEGER) % 5 AS fold FROM co WHERE y IS NOT NULL AND n_orders IS NOT NULL)"


@query(f"WITH {_FOLDED}, s AS (SELECT fold, sum(y) AS s, count(y) AS n FROM fo GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM s) SELECT subject_id, fo.fold, y, round((t.s - s.s) / (t.n - s.n), 6) AS prediction FROM fo JOIN s USING (fold), t")
def mean_baseline_oof(spark, sf_dir):
    return rounded(M.mean_baseline_oof(_folded(spark, sf_dir)).select("subject_id", "fold", "y", "prediction"), "prediction")


@query(f"""WITH {_FOLDED}, s AS (SELECT fold, sum(y) AS s, count(y) AS n FROM fo GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM s), p AS (SELECT fo.fold, y, (t.s - s.s) / (t.n - s.n) AS q FROM fo JOIN s USING (fold), t)
    SELECT 'mean' AS model, fold AS repeat, count(*) AS n, round(sqrt(avg((y - q) * (y - q))), 4) AS rmse, round(avg(abs(y - q)), 4) AS mae, round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 4) AS r2 FROM p GROUP BY GROUPING SETS ((fold), ())""")
def baseline_metrics(spark, sf_dir):
    p = M.mean_baseline_oof(_folded(spark, sf_dir)).withColumn("model", F.lit("mean")).withColumn("repeat", F.col("fold"))
    return rounded(M.metrics(p), "rmse", "mae", "r2", digits=4)


@query(f"WITH {A.COHORT}, p AS (SELECT y, mean_price / 30 AS q FROM co WHERE y IS NOT NULL AND mean_price IS NOT NULL) SELECT 'm' AS model, round(regr_slope(y, q), 6) AS slope, round(regr_intercept(y, q), 4) AS intercept, round(corr(y, q), 6) AS correlation, count(*) AS n FROM p")
def calibration(spark, sf_dir):
    p = A.cohort(spark, sf_dir).dropna(subset=["y", "mean_price"]).select("subject_id", "y", (F.col("mean_price") / 30).alias("prediction"), F.lit("m").alias("model"))
    return rounded(rounded(M.calibration(p), "slope", "correlation"), "intercept", digits=4)


_BIN = "CASE WHEN v <= a THEN 0 WHEN v <= b THEN 1 WHEN v <= c THEN 2 ELSE 3 END"


@query(f"WITH {A.COHORT}, p AS (SELECT y, mean_price / 30 AS v FROM co WHERE y IS NOT NULL AND mean_price IS NOT NULL), q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM p) SELECT 'm' AS model, {_BIN} AS bin, count(*) AS n, round(avg(v), 4) AS mean_prediction, round(avg(y), 4) AS mean_y FROM p, q GROUP BY ALL")
def calibration_bins(spark, sf_dir):
    p = A.cohort(spark, sf_dir).dropna(subset=["y", "mean_price"]).select("subject_id", "y", (F.col("mean_price") / 30).alias("prediction"), F.lit("m").alias("model"))
    return rounded(M.calibration_bins(p), "mean_prediction", "mean_y", digits=4)


def _long(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    return C.unpivoted(co, ["mean_price", "max_price"]).join(co.select("subject_id", "y"), "subject_id")


_LONG = f"{A.COHORT}, lg AS (SELECT subject_id, 'mean_price' AS feature, mean_price AS v, y FROM co WHERE mean_price IS NOT NULL UNION ALL SELECT subject_id, 'max_price', max_price, y FROM co WHERE max_price IS NOT NULL)"


@query(f"""WITH {_LONG}, q AS (SELECT feature, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c, count(*) AS n, count(DISTINCT v) AS n_values FROM lg GROUP BY 1),
    g AS (SELECT feature, {_BIN} AS bin, quantile_cont(y, 0.5) AS m FROM lg JOIN q USING (feature) GROUP BY ALL), s AS (SELECT feature, regr_slope(m, bin) AS slope, count(*) AS n_groups FROM g GROUP BY 1)
    SELECT feature, n, n_values, round(slope, 4) AS slope, n_groups, slope <> 0 AS selected FROM s JOIN q USING (feature)""")
def quartile_slopes(spark, sf_dir):
    return rounded(M.quartile_slopes(_long(spark, sf_dir)), "slope", digits=4)


@query(f"""WITH {_LONG}, r AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS px, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS py FROM lg)
    SELECT feature, round(corr(px, py), 6) AS rho, count(*) AS n, count(DISTINCT px) AS n_values, round(1 + abs(corr(px, py)), 6) AS weight FROM r GROUP BY 1""")
def spearman_weights(spark, sf_dir):
    return rounded(M.spearman_weights(_long(spark, sf_dir)), "rho", "weight")


@query(f"WITH {_LONG}, r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY y DESC, subject_id) AS k FROM lg) SELECT feature, round(regr_slope(v, k), 6) AS slope, round(regr_r2(v, k), 6) AS r2, count(*) AS n FROM r GROUP BY 1")
def rank_trend(spark, sf_dir):
    return rounded(M.rank_trend(_long(spark, sf_dir)), "slope", "r2")


@query(f"""WITH {_LONG}, z AS (SELECT *, (v - avg(v) OVER (PARTITION BY feature)) / stddev_pop(v) OVER (PARTITION BY feature) AS z FROM lg), q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM lg)
    SELECT feature, CASE WHEN y <= a THEN 0 WHEN y <= b THEN 1 WHEN y <= c THEN 2 ELSE 3 END AS bin, round(quantile_cont(z, 0.5), 6) AS median_z, count(*) AS n FROM z, q GROUP BY ALL""")
def standardised_trend(spark, sf_dir):
    return rounded(M.standardised_trend(_long(spark, sf_dir)), "median_z")


@query(f"""WITH {_LONG}, s AS (SELECT feature, avg(v) AS a, stddev_pop(v) AS d FROM lg GROUP BY 1), x AS (SELECT CAST(c_nationkey % 3 AS INTEGER) AS cluster, feature, value AS v FROM (SELECT subject_id, c_nationkey, 'mean_price' AS feature, mean_price AS value FROM co UNION ALL SELECT subject_id, c_nationkey, 'max_price', max_price FROM co)),
    p AS (SELECT cluster, feature, avg((v - a) / d) AS z, round(100.0 * count_if(v IS NULL) / count(*), 6) AS missing_pct, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS median FROM x JOIN s USING (feature) GROUP BY ALL),
    w AS (SELECT *, max(z) OVER (PARTITION BY feature) - min(z) OVER (PARTITION BY feature) AS sp FROM p)
    SELECT cluster, feature, round(z, 6) AS z_mean, missing_pct, mean, median, round(sp, 6) AS z_spread, dense_rank() OVER (ORDER BY sp DESC) AS spread_rank FROM w""")
def cluster_profile(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    long = C.unpivoted(co, ["mean_price", "max_price"]).join(co.select("subject_id", (F.col("c_nationkey") % 3).cast("int").alias("cluster")), "subject_id")
    return rounded(rounded(M.cluster_profile(long), "z_mean", "z_spread", "missing_pct"), "mean", "median", digits=3)


@query()
def ridge_cv(spark, sf_dir):
    """The whole grid of penalties, NULLs as medians with indicators."""
    cols = ["n_orders", "mean_price", "max_price"]
    found = R.target_models(_folded(spark, sf_dir), {"score": ("y", cols)}).filter("model = 'ridge'")
    return found.select("subject_id", "fold", "y", "alpha", "prediction")


def _customers(spark, sf_dir):
    """All customers with a score; folds by number, and every seventh customer's mean price as missing."""
    co = A.cohort(spark, sf_dir).dropna(subset=["y"])
    return co.withColumn("repeat", F.lit(0)).withColumn("fold", (A.number("subject_id") % 5).cast("int")).withColumn("mean_price", F.when(A.number("subject_id") % 7 != 0, F.col("mean_price") / 1000))


@query(f"""WITH {A.COHORT}, al AS (SELECT subject_id, y, CASE WHEN CAST(substr(subject_id, 2) AS BIGINT) % 7 <> 0 THEN mean_price / 1000 END AS x, CAST(substr(subject_id, 2) AS BIGINT) % 5 AS fold FROM co WHERE y IS NOT NULL), h AS (SELECT unnest(range(0, 5)) AS held), m AS (SELECT held, quantile_cont(x, 0.5) AS med FROM al, h WHERE fold <> held GROUP BY 1),
    r AS (SELECT al.*, held, coalesce(x, med) AS a, CAST(x IS NULL AS INTEGER)::DOUBLE AS b FROM al, h JOIN m USING (held)), t AS (SELECT held, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM r WHERE fold <> held GROUP BY 1),
    g AS (SELECT *, n + 10.0 AS d, n * cab / (sa * sb) AS o, n * cay / sa AS ra, n * cby / sb AS rb FROM t), w AS (SELECT *, (d * ra - o * rb) / (d * d - o * o) / sa AS wa, (d * rb - o * ra) / (d * d - o * o) / sb AS wb FROM g)
    SELECT subject_id, CAST(fold AS INTEGER) AS fold, y, 10.0::DOUBLE AS alpha, round(my + wa * (a - ma) + wb * (b - mb), 4) AS prediction FROM r JOIN w USING (held) WHERE fold = held""")
def ridge_imputed(spark, sf_dir):
    """One feature, its NULLs as medians, its indicator, one alpha: the two-by-two system in closed form."""
    out = M.ridge_cv(_customers(spark, sf_dir), ["mean_price"], alphas=(10.0,), impute=True)[0]
    return rounded(out.select("subject_id", "fold", "y", "alpha", "prediction"), "prediction", digits=4)


@query(f"""WITH {_FOLDED}, h AS (SELECT unnest(range(0, 5)) AS held), t AS (SELECT held, count(*) AS n, avg(n_orders) AS mx, avg(y) AS my, stddev_pop(n_orders) AS s, covar_pop(n_orders, y) AS c FROM fo, h WHERE fold <> held GROUP BY 1), w AS (SELECT *, n * c / s / (n + 10.0) / s AS b FROM t)
    SELECT subject_id, CAST(fold AS INTEGER) AS fold, y, 10.0::DOUBLE AS alpha, round(my + CASE WHEN b > 0 THEN 0 ELSE b END * (n_orders - mx), 4) AS prediction FROM fo JOIN w ON fold = held""")
def signed_ridge_one(spark, sf_dir):
    """One feature that may only lower the score, one alpha."""
    out = M.signed_ridge_cv(_folded(spark, sf_dir), ["n_orders"], {"n_orders": -1}, alphas=(10.0,))[0]
    return rounded(out.select("subject_id", "fold", "y", "alpha", "prediction"), "prediction", digits=4)


@query()
def signed_ridge_cv(spark, sf_dir):
    df = _folded(spark, sf_dir)
    return M.signed_ridge_cv(df, ["n_orders", "mean_price"], {"n_orders": 1, "mean_price": -1})[0].select("subject_id", "fold", "y", "alpha", "prediction")


_DOMAINS = {"balance": ("y", ["mean_price", "max_price"]), "volume": ("n_orders", ["mean_price"])}


@query()
def domain_model_metrics(spark, sf_dir):
    """Two domains with targets of their own, in the cohorts of the first 300, 600 and of all customers by number: the
    domain's features, those of both, and the mean."""
    df = _customers(spark, sf_dir).withColumn("coverage_rank", A.number("subject_id"))
    return R.domain_metrics(R.target_models(df, _DOMAINS, {"top_300": 300, "top_600": 600, "full": None}))


@query(f"""WITH {A.COHORT},
    c AS (SELECT * FROM (VALUES ('top_300', 300), ('full', 1000000000000)) v(cohort, most)),
    al AS (SELECT subject_id, y, n_orders, CASE WHEN no % 7 <> 0 THEN mean_price / 1000 END AS x, no, no % 5 AS fold
           FROM (SELECT *, CAST(substr(subject_id, 2) AS BIGINT) AS no FROM co) WHERE y IS NOT NULL),
    p AS (SELECT cohort, domain, target, subject_id, fold, x, CASE target WHEN 'y' THEN y ELSE n_orders END AS t
          FROM al JOIN c ON no <= most CROSS JOIN (VALUES ('balance', 'y'), ('volume', 'n_orders')) d(domain, target)
          WHERE CASE target WHEN 'y' THEN y ELSE n_orders END IS NOT NULL),
    h AS (SELECT unnest(range(0, 5)) AS held),
    m AS (SELECT cohort, domain, held, quantile_cont(x, 0.5) AS med FROM p, h WHERE fold <> held GROUP BY ALL),
    r AS (SELECT p.*, held, coalesce(x, med) AS a, CAST(x IS NULL AS INTEGER)::DOUBLE AS b FROM p CROSS JOIN h JOIN m USING (cohort, domain, held)),
    t AS (SELECT cohort, domain, held, avg(a) AS ma, avg(b) AS mb, avg(t) AS mt, stddev_pop(a) AS sa, stddev_pop(b) AS sb, count(*) AS n,
                 covar_pop(a, b) AS cab, covar_pop(a, t) AS cat, covar_pop(b, t) AS cbt FROM r WHERE fold <> held GROUP BY ALL),
    g AS (SELECT *, n + 10.0 AS d, n * cab / (sa * sb) AS o, n * cat / sa AS ra, n * cbt / sb AS rb FROM t),
    w AS (SELECT *, (d * ra - o * rb) / (d * d - o * o) / sa AS wa, (d * rb - o * ra) / (d * d - o * o) / sb AS wb FROM g),
    f AS (SELECT r.*, mt, mt + wa * (a - ma) + wb * (b - mb) AS q FROM r JOIN w USING (cohort, domain, held) WHERE fold = held)
    SELECT cohort, domain, target, 'domain_group_ridge' AS model, subject_id, CAST(fold AS INTEGER) AS fold, CAST(t AS DOUBLE) AS y, round(q, 4) AS prediction FROM f
    UNION ALL SELECT cohort, domain, target, 'mean_baseline', subject_id, CAST(fold AS INTEGER), CAST(t AS DOUBLE), round(mt, 4) FROM f""")
def domain_targets(spark, sf_dir):
    """Each domain's own target from one feature with NULLs, one penalty, in two cohorts: two-by-two systems in closed form."""
    df = _customers(spark, sf_dir).withColumn("coverage_rank", A.number("subject_id"))
    domains = {"balance": ("y", ["mean_price"]), "volume": ("n_orders", ["mean_price"])}
    found = R.target_models(df, domains, {"top_300": 300, "full": None}, alphas=(10.0,)).filter("model <> 'ridge'")
    return rounded(found.select("cohort", "domain", "target", "model", "subject_id", "fold", "y", "prediction"), "prediction", digits=4)


@query(f"""WITH {A.COHORT},
    al AS (SELECT subject_id, y, CAST(substr(subject_id, 2) AS BIGINT) AS no, CAST(substr(subject_id, 2) AS BIGINT) % 5 AS fold FROM co WHERE y IS NOT NULL),
    c AS (SELECT * FROM (VALUES ('top_300', 300), ('full', 1000000000000)) v(cohort, most)),
    p AS (SELECT cohort, al.* FROM al JOIN c ON no <= most),
    s AS (SELECT cohort, fold, sum(y) AS s, count(y) AS n FROM p GROUP BY ALL),
    t AS (SELECT cohort, sum(s) AS s, sum(n) AS n FROM s GROUP BY 1),
    q AS (SELECT p.cohort, y, (t.s - s.s) / (t.n - s.n) AS q FROM p JOIN s USING (cohort, fold) JOIN t USING (cohort))
    SELECT cohort, 'balance' AS domain, 'mean_baseline' AS model, count(*) AS n, round(sqrt(avg((y - q) * (y - q))), 4) AS rmse, round(avg(abs(y - q)), 4) AS mae,
           round(1 - sum((y - q) * (y - q)) / (var_pop(y) * count(*)), 6) AS r2
    FROM q GROUP BY 1""")
def cohort_baseline(spark, sf_dir):
    """The mean's part of the domain models, in two cohorts."""
    df = _customers(spark, sf_dir).withColumn("coverage_rank", A.number("subject_id"))
    found = R.target_models(df, {"balance": ("y", ["n_orders"])}, {"top_300": 300, "full": None}).filter("model = 'mean_baseline'")
    return rounded(rounded(R.domain_metrics(found).where("repeat is null").drop("repeat"), "rmse", "mae", digits=4), "r2")


@query()
def elastic_net_predictions(spark, sf_dir):
    """The whole grid of ratios and penalties, each fold's from the others."""
    cols = ["n_orders", "mean_price", "max_price"]
    found = R.target_models(_folded(spark, sf_dir), {"score": ("y", cols)}, alphas=R.ELASTIC_ALPHAS, ratios=R.RATIOS)
    return found.filter("model = 'elastic_net'").select("subject_id", "fold", "y", "alpha", "prediction")


@query(f"""WITH {_FOLDED},
    h AS (SELECT unnest(range(0, 5)) AS held),
    t AS (SELECT held, avg(n_orders) AS mx, avg(y) AS my, stddev_pop(n_orders) AS s, covar_pop(n_orders, y) / stddev_pop(n_orders) AS c FROM fo, h WHERE fold <> held GROUP BY 1),
    w AS (SELECT *, sign(c) * greatest(abs(c) - 20.0 * 0.8, 0) / (1 + 20.0 * (1 - 0.8)) / s AS b FROM t)
    SELECT subject_id, CAST(fold AS INTEGER) AS fold, y, round(my + b * (n_orders - mx), 4) AS prediction FROM fo JOIN w ON fold = held""")
def elastic_net_one(spark, sf_dir):
    """One feature, one ratio and penalty: a soft threshold in closed form."""
    found = R.target_models(_folded(spark, sf_dir), {"score": ("y", ["n_orders"])}, alphas=(20.0,), ratios=(0.8,))
    return rounded(found.filter("model = 'elastic_net'").select("subject_id", "fold", "y", "prediction"), "prediction", digits=4)


_FEATURES = ["n_orders", "mean_price", "max_price"]


@query()
def tree_predictions(spark, sf_dir):
    """Both tree models, each fold's from the others."""
    return T.tree_cv(_customers(spark, sf_dir), _FEATURES, shuffles=0)[0]


@query()
def permutation_importance(spark, sf_dir):
    """What each feature adds on the rows that the forest has not seen."""
    forest = {"random_forest": T.estimators("y")["random_forest"]}
    return T.tree_cv(_customers(spark, sf_dir), _FEATURES, models=forest)[1]


def _components(spark, sf_dir):
    """The first ten components of whole embeddings."""
    e = A.table(spark, sf_dir, "embeddings").where("embedding is not null")
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    cols = [f"e{i}" for i in range(n)]
    wide = e.select(F.col("vec_id").cast("string").alias("subject_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(cols)])
    return M.pca(wide, cols)[0]


@query()
def kmeans_stability(spark, sf_dir):
    """On the components."""
    return K.kmeans_stability(_components(spark, sf_dir).select("subject_id", "pcs"), "pcs")


@query()
def pca_scores(spark, sf_dir):
    return _components(spark, sf_dir).select("subject_id", "pcs")


@query(f"""WITH {A.COHORT}, al AS (SELECT subject_id, n_orders, CAST(substr(subject_id, 2) AS BIGINT) % 5 AS fold FROM (SELECT subject_id, y, CASE WHEN CAST(substr(subject_id, 2) AS BIGINT) % 7 <> 0 THEN mean_price / 1000 END AS n_orders FROM co) WHERE y IS NOT NULL), m AS (SELECT quantile_cont(n_orders, 0.5) AS med FROM al WHERE fold <> 0), i AS (SELECT al.*, coalesce(n_orders, med) AS v FROM al, m), s AS (SELECT avg(v) AS a, stddev_pop(v) AS d FROM i WHERE fold <> 0)
    SELECT subject_id, CAST(n_orders IS NULL AS INTEGER) AS missing__mean_price, round((v - a) / d, 6) AS mean_price__z FROM i, s""")
def fit_preprocess(spark, sf_dir):
    out = M.fit_preprocess(_customers(spark, sf_dir), ["mean_price"], test_fold=0)
    return rounded(out.select("subject_id", "missing__mean_price", "mean_price__z"), "mean_price__z")


@query(f"""WITH {A.COHORT}, c AS (SELECT 'nation_' || (c_nationkey % 5) AS feature, y / 1000 AS coefficient FROM co WHERE y IS NOT NULL)
    SELECT feature, round(avg(coefficient), 6) AS mean, round(stddev_samp(coefficient), 6) AS sd, round(quantile_cont(coefficient, 0.5), 6) AS median, round(avg(CAST(coefficient > 0 AS INTEGER)), 6) AS positive_fraction, count(*) AS n FROM c GROUP BY 1""")
def coef_stability(spark, sf_dir):
    """Scores by group of nations stand for coefficients over fits."""
    co = A.cohort(spark, sf_dir).dropna(subset=["y"])
    c = co.select(F.concat(F.lit("nation_"), (F.col("c_nationkey") % 5).cast("string")).alias("feature"), (F.col("y") / 1000).alias("coefficient"))
    return rounded(M.coef_stability(c), "mean", "sd", "median", "positive_fraction")


@query(f"""WITH {A.COHORT}, o AS (SELECT subject_id, y FROM co WHERE y IS NOT NULL), b AS (SELECT o.subject_id, o.y, mean_price / 1000 - n_orders AS p FROM o JOIN co USING (subject_id) WHERE n_orders IS NOT NULL)
    SELECT subject_id, y, round(p, 8) AS prediction, 'independent' AS model FROM b UNION ALL SELECT subject_id, y, round((SELECT avg(y) FROM o), 8), 'mean_change' FROM o""")
def change_estimates(spark, sf_dir):
    co = A.cohort(spark, sf_dir)
    there = co.where("n_orders is not null")
    t1, t2 = there.select("subject_id", F.col("n_orders").alias("prediction")), there.select("subject_id", (F.col("mean_price") / 1000).alias("prediction"))
    return rounded(M.change_estimates(t1, t2, co.dropna(subset=["y"]).select("subject_id", "y")), "prediction", digits=8)


@query(f"""WITH {A.COHORT}, l AS (SELECT 'a' AS a, 'b' AS b, c_nationkey % 3 AS x, CAST(floor(c_nationkey / 3) AS BIGINT) % 2 AS y FROM co), n AS (SELECT x, y, count(*) AS n FROM l GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS o FROM n), r AS (SELECT sum(k * (k - 1) / 2) AS u FROM (SELECT sum(n) AS k FROM n GROUP BY x)), c AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM n GROUP BY y)), t AS (SELECT sum(n) * (sum(n) - 1) / 2 AS w FROM n)
    SELECT 'x' AS a, 'y' AS b, round((o - u * v / w) / ((u + v) / 2 - u * v / w), 9) AS rand FROM s, r, c, t""")
def adjusted_rand(spark, sf_dir):
    co = A.cohort(spark, sf_dir).select((F.col("c_nationkey") % 3).alias("x"), (F.floor(F.col("c_nationkey") / 3) % 2).alias("y"))
    return rounded(M.pairwise_rand(co, ["x", "y"]), "rand", digits=9)

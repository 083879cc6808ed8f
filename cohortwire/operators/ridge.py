"""Ridge models of several targets, feature groups and cohorts from one pass of sums.

The basis of a row is one, its features with 0 for a NULL, indicators of its NULLs, and its targets.  Replacing NULLs by
any medians is a linear map of that basis, so the sums of products by fold serve every held-out fold, target and group
of features; what is solved are matrices of the number of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rangejoin import small

#: The grid of penalties.
ALPHAS = tuple(float(a) for a in np.logspace(-3, 4, 30))
#: The elastic net's shares of the absolute penalty, and its penalties.
RATIOS, ELASTIC_ALPHAS = (0.05, 0.2, 0.5, 0.8, 0.95, 1.0), tuple(float(a) for a in np.logspace(-1, 4, 14))
#: Bytes of sums that a task holds before it lets them go.
HELD_BYTES = 256 << 20


def basis_sums(rows: DataFrame, by: list[str], features: list[str], targets: list[str]) -> DataFrame:
    """by, at, s: sums of the products of the basis' members, the upper triangle in order of rows.

    A task multiplies matrices and lets one triangle go for each key; those are added up by place.
    """

    def add_up(batches: Iterator[pa.RecordBatch]):
        size = 1 + 2 * len(features) + len(targets)
        upper = np.triu_indices(size)
        held: dict[tuple, np.ndarray] = {}

        def let_go():
            keys = list(zip(*held, strict=True))
            sums = pa.array([g[upper] for g in held.values()], pa.list_(pa.float64()))
            out = pa.RecordBatch.from_arrays([*[pa.array(k, pa.int64()) for k in keys], sums], [*by, "sums"])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            frame = batch.to_pandas()
            x = frame[features].to_numpy(float)
            missing = np.isnan(x)
            basis = np.column_stack([np.ones(len(x)), np.where(missing, 0.0, x), missing, np.nan_to_num(frame[targets].to_numpy(float))])
            keys, group = np.unique(frame[by].to_numpy(np.int64), axis=0, return_inverse=True)
            for k, key in enumerate(map(tuple, keys.tolist())):
                own = basis[group.reshape(-1) == k]
                held[key] = held.get(key, 0.0) + own.T @ own
            if len(held) * size * size * 8 > HELD_BYTES:
                yield let_go()
        if held:
            yield let_go()

    wanted = rows.select(*[F.col(b).cast("long").alias(b) for b in by], *[F.col(c).cast("double").alias(c) for c in [*features, *targets]])
    parts = wanted.mapInArrow(add_up, ", ".join(f"{b} long" for b in by) + ", sums array<double>")
    return parts.select(*by, F.posexplode("sums").alias("at", "s")).groupBy(*by, "at").agg(F.sum("s").alias("s"))


def centred(gram: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, means, products about the means) from sums over (1, x, y)."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    return n, mean, gram[1:, 1:] - n * np.outer(mean, mean)


def solved(gram: np.ndarray, alphas, sd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, coefficients by alpha) of the ridge on standardised columns, all alphas from one decomposition.

    sd: the columns' scale where it isn't that of these rows; a column that doesn't vary gets the coefficient 0.
    """
    n, mean, cov = centred(gram)
    xx, xy = cov[:-1, :-1], cov[:-1, -1]
    if sd is None:
        sd = scale(gram)
    varies = sd > 0
    unit = np.where(varies, 1.0 / np.where(varies, sd, 1.0), 0.0)
    values, vectors = np.linalg.eigh(xx * np.outer(unit, unit))
    turned = vectors.T @ (xy * unit)
    beta = np.stack([vectors @ (turned / (np.maximum(values, 0.0) + a)) * unit for a in alphas])
    return mean[-1] - beta @ mean[:-1], beta


def scale(gram: np.ndarray) -> np.ndarray:
    """Population SD of each column; 0 where only rounding varies."""
    n, mean, cov = centred(gram)
    variance = np.diag(cov)[:-1] / n
    return np.where(variance > 1e-12 * np.maximum(mean[:-1] ** 2, 1e-12), np.sqrt(np.maximum(variance, 0.0)), 0.0)


def mean_squares(gram: np.ndarray, intercepts: np.ndarray, beta: np.ndarray) -> np.ndarray:
    v = np.column_stack([intercepts, beta, -np.ones(len(beta))])
    return np.maximum(np.einsum("ai,ij,aj->a", v, gram, v), 0.0) / gram[0, 0]


def choose_alpha(parts: list[np.ndarray], alphas) -> float:
    """The alpha of least mean RMSE over parts, each held out in turn; columns keep the scale that they have in all."""
    if len(parts) < 2 or len(alphas) == 1:
        return alphas[0]
    whole = sum(parts)
    sd = scale(whole)
    errors = [np.sqrt(mean_squares(part, *solved(whole - part, alphas, sd))) for part in parts if 0 < part[0, 0] < whole[0, 0]]
    return alphas[int(np.argmin(np.mean(errors, axis=0)))] if errors else alphas[0]


def solved_elastic(gram: np.ndarray, grid, sd: np.ndarray | None = None, sweeps: int = 10_000, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, coefficients by (ratio, alpha)) of the elastic net on standardised columns, by coordinate descent on
    the sums: half the mean squared error, plus alpha times ratio absolute and (1 - ratio) / 2 squared coefficients."""
    n, mean, cov = centred(gram)
    sd = scale(gram) if sd is None else sd
    unit = np.where(sd > 0, 1.0 / np.where(sd > 0, sd, 1.0), 0.0)
    xx, xy = cov[:-1, :-1] * np.outer(unit, unit) / n, cov[:-1, -1] * unit / n
    ratio, alpha = np.array(grid, float).T
    w = np.zeros((len(grid), len(xy)))
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(xy)):
            left = xy[j] - w @ xx[:, j] + xx[j, j] * w[:, j]
            weight = xx[j, j] + alpha * (1 - ratio)
            w[:, j] = np.where(weight > 0, np.sign(left) * np.maximum(np.abs(left) - alpha * ratio, 0.0) / np.where(weight > 0, weight, 1.0), 0.0)
        if np.abs(w - before).max() <= close * max(1.0, np.abs(w).max()):
            break
    beta = w * unit
    return mean[-1] - beta @ mean[:-1], beta


def choose_elastic(parts: list[np.ndarray], grid):
    """The (ratio, alpha) of least mean squared error over parts, each held out in turn; columns keep their scale in all."""
    if len(parts) < 2 or len(grid) == 1:
        return grid[0]
    whole = sum(parts)
    sd = scale(whole)
    errors = [mean_squares(part, *solved_elastic(whole - part, grid, sd)) for part in parts if 0 < part[0, 0] < whole[0, 0]]
    return grid[int(np.argmin(np.mean(errors, axis=0)))] if errors else grid[0]


def _fits(sums: pd.DataFrame, medians: pd.DataFrame, plan: dict, features: list[str], targets: list[str], alphas, ratios) -> Iterator[tuple]:
    """Rows of coefficients for one repeat: every cohort, target, group of features and held-out fold."""
    k, size = len(features), 1 + 2 * len(features) + len(targets)
    upper = np.triu_indices(size)
    grams = {}
    for key, own in sums.groupby(["fold", "bracket", "pattern"]):
        g = np.zeros((size, size))
        g[upper[0][own["at"]], upper[1][own["at"]]] = own["s"]
        grams[key] = g + np.triu(g, 1).T
    fills = {(r.cohort, r.target, r.held): np.nan_to_num(np.array(r.medians, float)) for r in medians.itertuples()}
    for cohort, domain, model, target, used in plan:
        whole = {}
        for (fold, bracket, pattern), g in grams.items():
            if bracket <= cohort and pattern >> target & 1:
                whole[fold] = whole.get(fold, 0.0) + g
        for held in whole:
            others = [g for fold, g in whole.items() if fold != held]
            if not others:
                continue
            fill = fills[cohort, target, held]
            # One, the features with their NULLs filled, their indicators, the target: as columns of the basis.
            turn = np.zeros((size, 2 + 2 * len(used)))
            turn[0, 0] = turn[1 + 2 * k + target, -1] = 1.0
            for at, c in enumerate(used):
                turn[1 + c, 1 + at] = 1.0
                turn[1 + k + c, 1 + at] = fill[c]
                turn[1 + k + c, 1 + len(used) + at] = 1.0
            parts = [turn.T @ g @ turn for g in others]
            beta, alpha = np.zeros(2 * k), None
            if model != "mean_baseline":
                if ratios:
                    chosen = choose_elastic(parts, [(r, a) for r in ratios for a in alphas])
                    alpha, ((intercept,), (own,)) = chosen[1], solved_elastic(sum(parts), [chosen])
                else:
                    alpha = choose_alpha(parts, alphas)
                    (intercept,), (own,) = solved(sum(parts), [alpha])
                for at, c in enumerate(used):
                    beta[c] = own[at]
                    beta[k + c] = own[len(used) + at] + own[at] * fill[c]
            else:
                whole_part = sum(parts)
                intercept = whole_part[0, -1] / whole_part[0, 0]
            yield cohort, domain, model, target, held, alpha, float(intercept), beta.tolist()


def target_models(df: DataFrame, domains: dict[str, tuple[str, list[str]]], cohorts: dict[str, int | None] | None = None, rank: str = "coverage_rank", alphas=ALPHAS, key: str = "subject_id", ratios=()) -> DataFrame:
    """Out-of-fold predictions of each domain's own target, in each cohort: a ridge on the domain's features
    (domain_group_ridge), one on those of all domains (ridge), and the mean (mean_baseline).  With ratios the models are
    elastic nets, chosen by least mean squared error (domain_group_elastic_net, elastic_net).

    domains: name -> (target, features); cohorts: name -> largest `rank` of its rows, None for all.  df has repeat and
    fold.  Returns cohort, domain, target, model, repeat, fold, key, y, alpha, prediction, for the rows that have the
    target.  NULL features are the median of the training rows that have it (0 without any), with an indicator; columns
    are standardised; alpha is the one of least mean RMSE over the training folds, each held out in turn.  All models
    come of one pass for medians and one for sums.
    """
    cohorts = cohorts or {"full": None}
    targets = list(dict.fromkeys(t for t, _ in domains.values()))
    features = list(dict.fromkeys(c for _, cols in domains.values() for c in cols))
    limits = sorted(cohorts.items(), key=lambda c: (c[1] is None, c[1] or 0))
    names, numbers = [name for name, _ in limits], {name: i for i, (name, _) in enumerate(limits)}
    plan = []
    for cohort in range(len(limits)):
        for number, (domain, (target, cols)) in enumerate(domains.items()):
            at = targets.index(target)
            kind = "elastic_net" if ratios else "ridge"
            for model, used in ((kind, features), (f"domain_group_{kind}", cols), ("mean_baseline", [])):
                plan.append((cohort, number, model, at, [features.index(c) for c in used]))

    bracket = F.lit(None).cast("int")
    for name, most in reversed(limits):
        bracket = F.when(F.lit(True) if most is None else F.col(rank) <= most, F.lit(numbers[name])).otherwise(bracket)
    numeric = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    rows = df.select(
        F.col(key).alias("key"), F.col("repeat").cast("long"), F.col("fold").cast("long"), bracket.alias("bracket"),
        *[numeric(c).alias(f"x{i}") for i, c in enumerate(features)], *[numeric(t).alias(f"t{i}") for i, t in enumerate(targets)],
    )
    xs, ts = [f"x{i}" for i in range(len(features))], [f"t{i}" for i in range(len(targets))]
    pattern = sum((F.when(F.col(t).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(ts)), F.lit(0))
    rows = rows.withColumn("pattern", pattern).filter("bracket is not null and pattern > 0")

    pairs = F.array(*[F.struct(F.lit(c).alias("cohort"), F.lit(t).alias("target")) for c in range(len(limits)) for t in range(len(targets))])
    holdable = rows.groupBy("repeat").agg(F.collect_set("fold").alias("folds"))  # a row a repeat
    has = lambda bits: F.array(*bits)[F.col("target")]
    training = rows.join(F.broadcast(holdable), "repeat").withColumn("p", F.explode(pairs)).select("*", "p.cohort", "p.target")
    training = training.filter((F.col("bracket") <= F.col("cohort")) & has([F.col(t).isNotNull() for t in ts]))
    training = training.withColumn("held", F.explode("folds")).filter("held <> fold")
    medians = training.groupBy("repeat", "held", "cohort", "target").agg(F.array(*[F.percentile(x, F.lit(0.5)) for x in xs]).alias("medians"))
    sums = basis_sums(rows, ["repeat", "fold", "bracket", "pattern"], xs, ts)

    def fit(keys: tuple, grams: pd.DataFrame, fills: pd.DataFrame) -> pd.DataFrame:
        found = list(_fits(grams, fills, plan, features, targets, list(alphas), list(ratios)))
        out = pd.DataFrame(found, columns=["cohort", "domain", "model", "target", "fold", "alpha", "intercept", "beta"])
        return out.assign(repeat=keys[0])[["repeat", "fold", "cohort", "domain", "model", "target", "alpha", "intercept", "beta"]]

    schema = "repeat long, fold long, cohort int, domain int, model string, target int, alpha double, intercept double, beta array<double>"
    coefs = sums.groupBy("repeat").cogroup(medians.groupBy("repeat")).applyInPandas(fit, schema)
    dot = F.col("intercept")
    for i, x in enumerate(xs):
        dot = dot + F.coalesce(F.col(x), F.lit(0.0)) * F.col("beta")[i] + F.when(F.col(x).isNull(), F.col("beta")[len(xs) + i]).otherwise(0.0)
    out = rows.join(small(coefs), ["repeat", "fold"]).filter((F.col("bracket") <= F.col("cohort")) & has([F.col(t).isNotNull() for t in ts]))
    word = lambda c, values: F.array(*[F.lit(v) for v in values])[F.col(c)].alias(c)
    return out.select(
        word("cohort", names), word("domain", list(domains)), word("target", targets), "model", F.col("repeat").cast("int").alias("repeat"), F.col("fold").cast("int").alias("fold"),
        F.col("key").alias(key), F.array(*ts)[F.col("target")].alias("y"), "alpha", dot.alias("prediction"),
    )


def domain_metrics(predictions: DataFrame) -> DataFrame:
    """RMSE, MAE and R2 of target_models() by cohort, domain, model and repeat, and pooled over repeats (repeat NULL)."""
    error = F.col("y") - F.col("prediction")
    spread = F.nullif(F.var_pop("y") * F.count(F.lit(1)), F.lit(0.0))
    sets = predictions.withColumn("scope", F.explode(F.array(F.col("repeat"), F.lit(None).cast("int"))))
    return sets.groupBy("cohort", "domain", "model", F.col("scope").alias("repeat")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), (1 - F.sum(error * error) / spread).alias("r2")
    )

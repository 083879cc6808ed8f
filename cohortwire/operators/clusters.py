"""K-means for many numbers of clusters, seeds and restarts side by side: each pass over the rows moves all of them.

Only centres, counts and sums by cluster reach the driver, whose number follows the parameters and not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import intermediate

#: Rows of smallest hash among which first centres are sought, rounds at most, and the move that ends them.
SAMPLE_ROWS, ROUNDS, TOLERANCE = 2000, 300, 1e-4


def first_centres(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: rows of the sample, each drawn in proportion to its squared distance from those before."""
    chosen = [sample[rng.integers(len(sample))]]
    nearest = ((sample - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = nearest.sum()
        at = rng.choice(len(sample), p=nearest / total) if total > 0 else rng.integers(len(sample))
        chosen.append(sample[at])
        nearest = np.minimum(nearest, ((sample - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def _points(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    for batch in batches:
        if batch.num_rows:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(float)


#: Points whose distances to all centres are held at once.
LABELLED = 1024


def _labels(x: np.ndarray, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each model every point's cluster, of equally near ones the first, and squared distance."""
    every = np.concatenate(models)
    length, square = (every * every).sum(1)[:, None], (x * x).sum(1)
    labels = [np.zeros(len(x), np.int64) for _ in models]
    distances = [np.zeros(len(x)) for _ in models]
    for first in range(0, len(x), LABELLED):
        part = slice(first, first + LABELLED)
        d = length - 2 * (every @ x[part].T) + square[part]  # a row a centre
        at = 0
        for m, label, distance in zip(models, labels, distances, strict=True):
            least, which = d[at].copy(), label[part]
            for j in range(1, len(m)):
                np.copyto(which, j, where=d[at + j] < least)
                np.minimum(least, d[at + j], out=least)
            np.maximum(least, 0.0, out=distance[part])
            at += len(m)
    return labels, distances


def _summed(rows: DataFrame, dims: int, models: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """By model: rows, sums and sums of squared lengths of its clusters' points, with costs in the last place of each."""

    def add_up(batches):
        totals = [np.zeros((len(m), dims + 3)) for m in models]
        for x in _points(batches, dims):
            one = np.column_stack([np.ones(len(x)), x, (x * x).sum(1)])
            for total, label, distance in zip(totals, *_labels(x, models), strict=True):
                total[:, :-1] += (np.arange(len(total))[:, None] == label).astype(float) @ one
                total[:, -1] += np.bincount(label, distance, len(total))
        where = [(m, j) for m, t in enumerate(totals) for j in range(len(t)) if t[j, 0]]
        values = pa.array([totals[m][j] for m, j in where], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in where], pa.int32()), pa.array([j for _, j in where], pa.int32()), values], ["model", "cluster", "sums"])

    parts = rows.mapInArrow(add_up, "model int, cluster int, sums array<double>")
    sums = parts.groupBy("model", "cluster").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(dims + 3)]).alias("sums"))
    out = [np.zeros((len(m), dims + 3)) for m in models]
    for r in sums.collect():  # a row per model and cluster
        out[r["model"]][r["cluster"]] = r["sums"]
    return out


def fitted(rows: DataFrame, dims: int, models: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The models' centres after rounds of assignment and means, until none moves; a cluster without points stays."""
    models, moving = list(models), list(range(len(models)))
    for _ in range(rounds):
        sums = _summed(rows, dims, [models[i] for i in moving])
        still = []
        for i, s in zip(moving, sums, strict=True):
            n = s[:, :1]
            after = np.where(n > 0, s[:, 1 : dims + 1] / np.maximum(n, 1), models[i])
            if np.sqrt(((after - models[i]) ** 2).sum(1)).max() > TOLERANCE:
                still.append(i)
            models[i] = after
        moving = still
        if not moving:
            break
    return models


def _compared(rows: DataFrame, dims: int, models: list[np.ndarray], sums: list[np.ndarray], pairs: list[tuple[int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Silhouette by model, from squared distances, and of each pair of models how many rows have which two labels."""

    def add_up(batches):
        n, silhouettes = 0, np.zeros(len(models))
        tables = [np.zeros(len(models[a]) * len(models[b])) for a, b in pairs]
        for x in _points(batches, dims):
            labels, _ = _labels(x, models)
            n, square = n + len(x), (x * x).sum(1)
            for m, (s, label) in enumerate(zip(sums, labels, strict=True)):
                size, at = s[:, 0], np.arange(len(x))
                whole = square[:, None] * size + s[:, dims + 1] - 2 * x @ s[:, 1 : dims + 1].T  # summed over each cluster
                own = whole[at, label] / np.maximum(size[label] - 1, 1)
                other = np.where(size > 0, whole / np.maximum(size, 1), np.inf)
                other[at, label] = np.inf
                other = other.min(1)
                most = np.maximum(own, other)
                score = np.where((size[label] > 1) & (most > 0) & np.isfinite(other), (other - own) / np.where(most > 0, most, 1), 0.0)
                silhouettes[m] += score.sum()
            for table, (a, b) in zip(tables, pairs, strict=True):
                table += np.bincount(labels[a] * len(models[b]) + labels[b], minlength=len(table))
        values = [silhouettes, *tables, [n]]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array([list(v) for v in values], pa.list_(pa.float64()))], ["part", "sums"])

    parts = rows.mapInArrow(add_up, "part int, sums array<double>").select("part", F.posexplode("sums").alias("at", "s"))
    found = {}
    for r in parts.groupBy("part", "at").agg(F.sum("s").alias("s")).collect():  # a row per model, or pair and two labels
        found.setdefault(r["part"], {})[r["at"]] = r["s"]
    vector = lambda p: np.array([found[p][i] for i in range(len(found[p]))])
    return vector(0) / found[len(pairs) + 1][0], [vector(1 + i).reshape(len(models[a]), len(models[b])) for i, (a, b) in enumerate(pairs)]


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a table of label pairs."""
    c2 = lambda n: n * (n - 1) / 2.0
    both, one, two, every = c2(table).sum(), c2(table.sum(1)).sum(), c2(table.sum(0)).sum(), c2(table.sum())
    expected = one * two / every if every else 0.0
    top = (one + two) / 2 - expected
    return 1.0 if top == 0 else float((both - expected) / top)


def kmeans_stability(df: DataFrame, features: str, ks=(2, 3, 4, 5), seeds: int = 20, restarts: int = 5, key: str = "subject_id") -> DataFrame:
    """Per k: silhouette mean, SD, min and max over seeds, the mean, least and largest adjusted Rand index over all pairs
    of seeds, and whether it is the best: largest mean silhouette, then largest mean index.

    features: an array of numbers, the same many in each row.  Of a seed's restarts the one of least cost counts.  All
    models are fitted side by side, so the rows are read once a round.  No rows give no k.
    """
    rows = intermediate(df.select(F.col(features).cast("array<double>").alias("x"), F.xxhash64(key).alias("h")), "points")
    sample = np.array([r["x"] for r in rows.orderBy("h", "x").limit(SAMPLE_ROWS).select("x").collect()], float)
    schema = "k int, n_seeds int, silhouette_mean double, silhouette_sd double, silhouette_min double, silhouette_max double, rand_mean double, rand_min double, rand_max double, best boolean"
    if not len(sample):
        return df.sparkSession.createDataFrame([], schema)
    points, dims = rows.select("x"), sample.shape[1]
    starts = [(k, seed, restart) for k in ks for seed in range(seeds) for restart in range(restarts)]
    models = fitted(points, dims, [first_centres(sample, k, np.random.default_rng([seed, restart, k])) for k, seed, restart in starts])
    sums = _summed(points, dims, models)
    best: dict[tuple[int, int], int] = {}
    for i, (k, seed, _) in enumerate(starts):
        if (k, seed) not in best or sums[i][:, -1].sum() < sums[best[k, seed]][:, -1].sum():
            best[k, seed] = i
    chosen = [best[k, seed] for k in ks for seed in range(seeds)]
    pairs = [(a + i, a + j) for a in range(0, len(chosen), seeds) for i in range(seeds) for j in range(i + 1, seeds)]
    silhouettes, tables = _compared(points, dims, [models[i] for i in chosen], [sums[i] for i in chosen], pairs)
    out = []
    for at, k in enumerate(ks):
        own = silhouettes[at * seeds : (at + 1) * seeds]
        rand = [rand_index(t) for (a, _), t in zip(pairs, tables, strict=True) if a // seeds == at] or [1.0]
        out.append((k, seeds, float(own.mean()), float(own.std()), float(own.min()), float(own.max()), float(np.mean(rand)), min(rand), max(rand)))
    first = max(out, key=lambda r: (r[2], r[6]))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == first) for r in out], schema)

"""Gaussian mixture clustering with stable label numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.operators.moments import list_array, matrix_of
from cubeloom.session import cut_lineage


def standardize_labels(df: DataFrame, centroids: DataFrame, label: str = "label") -> DataFrame:
    """Renumbers clusters by ascending centroid mean (centroids: one row per cluster, label and v)."""
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    order = Window.orderBy("_mean", label)
    ranked = centroids.select(label, mean.alias("_mean")).withColumn("_new", (F.row_number().over(order) - 1).cast("int"))
    joined = df.join(F.broadcast(ranked.select(label, "_new")), label)
    return joined.withColumn(label, F.col("_new")).drop("_new")


#: Rows that a start looks at for each class.
START_ROWS = 32


def start_means(df: DataFrame, k: int, seeds: Sequence[int]) -> np.ndarray:
    """(starts, k, width): for each seed, k vectors far apart among the first START_ROWS * k by hash, which reach the driver.

    Each is drawn with a chance that grows with the squared distance to the nearest one before. Where the rows drawn hold too few
    different vectors, the different vectors of the whole table take their place.
    """
    out = []
    for seed in seeds:
        order = [F.xxhash64(F.lit(seed), "v"), F.col("v")]
        found = list(dict.fromkeys(tuple(r["v"]) for r in df.orderBy(*order).limit(START_ROWS * k).collect()))
        if len(found) < k:
            found = [tuple(r["v"]) for r in df.distinct().orderBy(*order).limit(START_ROWS * k).collect()]
        x, rng = np.array(found, dtype=float), np.random.default_rng(seed)
        chosen = [int(rng.integers(len(x)))]
        while len(chosen) < k:
            near = ((x[:, None] - x[chosen][None]) ** 2).sum(axis=2).min(axis=1)
            chosen.append(int(rng.choice(len(x), p=near / near.sum())) if near.sum() else chosen[len(chosen) % len(x)])
        out.append(x[chosen])
    return np.array(out, dtype=float)


def factor(covariance: np.ndarray, floor: float) -> np.ndarray:
    """Inverse of the lower factor of a covariance; the floor grows until rounding no longer hides it."""
    while True:
        try:
            lower = np.linalg.cholesky(covariance + floor * np.eye(len(covariance)))
        except np.linalg.LinAlgError:
            floor *= 10
            continue
        return np.linalg.inv(lower)


def log_shares(x: np.ndarray, weights: np.ndarray, means: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """(rows, k) logarithm of each class's share of the density."""
    out = np.empty((len(x), len(weights)))
    for j, (weight, mean, inverse) in enumerate(zip(weights, means, factors)):
        z = (x - mean) @ inverse.T
        constant = np.log(weight) + np.log(np.diag(inverse)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        out[:, j] = constant - 0.5 * np.einsum("ij,ij->i", z, z)
    return out


def mixture_fit(
    df: DataFrame, k: int, seeds: Sequence[int], max_iter: int = 100, tol: float = 1e-3, floor: float = 1e-6
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[float]]]:
    """(weights, means, factors) of the best start, and each start's mean log-likelihood per step.

    All starts share each pass over the rows: a task sums responsibilities, vectors and outer products per start and class, the sums
    are added on Spark per (start, class), and only k matrices per start reach the driver. Vectors are taken relative to the overall
    mean, so large values cost no digits. ``floor`` is added to the diagonal of every covariance; where rounding hides it, it
    grows until the matrix can be factored. A start stops when a step gains less than ``tol``.
    """
    spark = df.sparkSession
    data = df.select(F.col("v").cast("array<double>").alias("v"))
    total, centre, spread = _moments(data)
    means = start_means(data, k, seeds) - centre
    weights = np.full((len(seeds), k), 1.0 / k)
    factors = np.array([[factor(spread, floor)] * k for _ in seeds])
    gains: list[list[float]] = [[] for _ in seeds]
    active = list(range(len(seeds)))
    width = len(centre)
    for _ in range(max_iter):
        told = spark.sparkContext.broadcast((active, centre, weights, means, factors))  # k matrices per start

        def sums(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            active, centre, weights, means, factors = told.value
            held = np.zeros((len(active), len(weights[0]), 2 + len(centre) + len(centre) ** 2))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix_of(batch.column(0)) - centre
                for i, s in enumerate(active):
                    logs = log_shares(x, weights[s], means[s], factors[s])
                    top = logs.max(axis=1)
                    whole = top + np.log(np.exp(logs - top[:, None]).sum(axis=1))
                    shares = np.exp(logs - whole[:, None])
                    held[i, 0, 0] += whole.sum()
                    held[i, :, 1] += shares.sum(axis=0)
                    held[i, :, 2 : 2 + x.shape[1]] += shares.T @ x
                    for j in range(shares.shape[1]):
                        held[i, j, 2 + x.shape[1] :] += ((shares[:, j, None] * x).T @ x).ravel()
            flat = held.reshape(-1, held.shape[2])
            keys = np.array([(s, j) for s in active for j in range(held.shape[1])], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), list_array(flat)], names=["s", "j", "part"])

        def add(table: pa.Table) -> pa.Table:
            summed = matrix_of(table.column("part")).sum(axis=0, keepdims=True)
            return pa.table([table.column("s").slice(0, 1), table.column("j").slice(0, 1), list_array(summed)], names=["s", "j", "part"])

        kind = "s int, j int, part array<double>"
        found = data.mapInArrow(sums, kind).groupBy("s", "j").applyInArrow(add, kind).collect()
        parts = {(r["s"], r["j"]): np.array(r["part"]) for r in found}
        going = []
        for s in active:
            likelihood = sum(parts[s, j][0] for j in range(k)) / total
            gains[s].append(likelihood)
            if len(gains[s]) > 1 and likelihood - gains[s][-2] < tol:
                continue  # the parameters that gave this likelihood stay
            for j in range(k):
                size = parts[s, j][1] + 10 * np.finfo(float).eps
                mean = parts[s, j][2 : 2 + width] / size
                second = parts[s, j][2 + width :].reshape(width, width) / size
                weights[s, j], means[s, j] = max(size / total, 1e-300), mean
                factors[s, j] = factor(second - np.outer(mean, mean), floor)
            going.append(s)
        active = going
        if not active:
            break
    best = max(range(len(seeds)), key=lambda s: gains[s][-1] if gains[s] else -np.inf)
    return weights[best], means[best] + centre, factors[best], gains


def _moments(data: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, mean and covariance diagonal matrix of the vectors."""
    wide = data.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("q"))
    rows = sorted(wide.collect())  # one row per element of a vector
    return rows[0]["n"], np.array([r["m"] for r in rows]), np.diag([r["q"] for r in rows])


def gmm_cluster(
    df: DataFrame, k: int, vector: str = "v", seeds: Sequence[int] = (42,), max_iter: int = 100, tol: float = 1e-3, floor: float = 1e-6
) -> DataFrame:
    """Adds label: full-covariance mixture with the best likelihood over the seeds, renumbered by ascending mean.

    Repeated, masked or rank-deficient rows are fitted as they are (see ``mixture_fit`` for the floor). An empty table stays empty.
    """
    if df.isEmpty():
        return df.withColumn("label", F.lit(0))
    df = cut_lineage(df)  # read once per step
    weights, means, factors, _ = mixture_fit(df.select(F.col(vector).alias("v")), k, seeds, max_iter, tol, floor)
    order = np.argsort(means.mean(axis=1), kind="stable")
    told = df.sparkSession.sparkContext.broadcast((weights[order], means[order], factors[order]))

    @F.pandas_udf("int")
    def label(vectors: pd.Series) -> pd.Series:
        weights, means, factors = told.value
        if not len(vectors):
            return pd.Series([], dtype="int32")
        centre = means.mean(axis=0)
        return pd.Series(log_shares(np.stack(vectors.to_numpy()) - centre, weights, means - centre, factors).argmax(axis=1).astype(np.int32))

    return df.withColumn("label", label(F.col(vector).cast("array<double>")))

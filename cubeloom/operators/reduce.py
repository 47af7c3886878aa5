"""Dimensionality reduction, standardisation and distances to the mean."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions import bands as band_fn
from cubeloom.functions.vectors import dot, norm, subtract
from cubeloom.operators.moments import (
    DOUBLES,
    Moments,
    band_sums,
    collect_moments,
    collect_moments_by,
    list_array,
    matrix_of,
    noise_differences,
    noise_moments,
    vector_slices,
)

REDUCTIONS = ("PCA", "MNF")


def map_vectors(df: DataFrame, vector: str, out: str, function, out_type: T.DataType) -> DataFrame:
    """Adds ``out`` = function(matrix of vectors), batch by batch (Arrow, no shuffle)."""
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField(out, out_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vector_slices(batches, vector):
            result = function(matrix_of(batch.column(vector)))
            extra = list_array(result) if isinstance(out_type, T.ArrayType) else pa.array(result)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [extra], names=names + [out])
            del batch, result, extra

    return df.mapInArrow(run, schema)


def project(df: DataFrame, matrix: np.ndarray, mean: np.ndarray | None = None, vector: str = "spectrum", out: str = "scores") -> DataFrame:
    """scores = (x - mean) @ matrix; the matrix (bands x components) travels with the task."""
    shift = 0.0 if mean is None else mean
    return map_vectors(df, vector, out, lambda x: (x - shift) @ matrix, DOUBLES)


def canonical_sign(columns: np.ndarray) -> np.ndarray:
    """Flips each column so that its largest absolute entry is positive."""
    pick = np.abs(columns).argmax(axis=0)
    signs = np.sign(columns[pick, np.arange(columns.shape[1])])
    return columns * np.where(signs == 0, 1.0, signs)


def pca_loadings(moments: Moments, k: int) -> np.ndarray:
    """Eigenvectors of the covariance, largest first (B x B work on the driver)."""
    values, vectors = np.linalg.eigh(moments.cov)
    return canonical_sign(vectors[:, np.argsort(values)[::-1][:k]])


def pca(df: DataFrame, k: int = 10, vector: str = "spectrum", out: str = "scores") -> DataFrame:
    """First k principal scores of the uncentred vectors."""
    return project(df, pca_loadings(collect_moments(df, vector), k), vector=vector, out=out)


def mnf_transform(signal: Moments, noise: Moments, k: int) -> np.ndarray:
    """Noise-whitening followed by principal axes: bands x k matrix, largest signal-to-noise first."""
    values, vectors = np.linalg.eigh(noise.cov)
    keep = values > values.max() * 1e-12
    whiten = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
    snr, axes = np.linalg.eigh(whiten @ signal.cov @ whiten)
    return canonical_sign(whiten @ axes[:, np.argsort(snr)[::-1][:k]])


def mnf(
    df: DataFrame,
    k: int = 10,
    vector: str = "spectrum",
    valid: str | None = "valid",
    rows: int | tuple[int, int] | None = None,
    cols: int | tuple[int, int] | None = None,
    noise: Moments | None = None,
    keys: Sequence[str] = ("scene_id",),
    out: str = "scores",
) -> DataFrame:
    """First k minimum-noise-fraction scores of the valid pixels.

    Noise comes from pixel differences over the whole valid scene, or, when a row / column range
    is named, over every pixel of that range.
    """
    pixels = df.filter(F.col(valid)) if valid else df
    if noise is None:
        if rows is None and cols is None:
            noise = noise_moments(df, valid=valid, vector=vector, keys=keys)
        else:
            region = df.filter(band_fn.in_slice(F.col("row"), rows) & band_fn.in_slice(F.col("col"), cols))
            noise = noise_moments(region, valid=None, vector=vector, keys=keys)
    signal = collect_moments(pixels, vector)
    return project(pixels, mnf_transform(signal, noise, k), signal.mean, vector, out)


def mnf_by_block(df: DataFrame, block: str, k: int, vector: str = "spectrum", out: str = "scores") -> DataFrame:
    """MNF of every block with its own statistics; all blocks share the two statistics jobs."""
    noise = collect_moments_by(noise_differences(df, valid=None, vector=vector, keys=[block]), block, "delta")
    signal = collect_moments_by(df, block, vector)
    # a block without neighbouring pixels has no differences of its own: it takes those of all blocks, or none at all
    pairs = sum(m.n for m in noise.values())
    common = sum(m.n * (m.cov + np.outer(m.mean, m.mean)) for m in noise.values()) / pairs if pairs else None

    def halved(b, m: Moments) -> Moments:
        if b in noise:
            return Moments(noise[b].n, noise[b].mean, noise[b].cov / 2.0)
        return Moments(pairs, np.zeros_like(m.mean), np.eye(len(m.mean)) if common is None else common / 2.0)

    plan = {b: (m.mean, mnf_transform(m, halved(b, m), k)) for b, m in signal.items()}
    names = df.columns
    schema = T.StructType(df.schema.fields + [T.StructField(out, DOUBLES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, blocks = matrix_of(batch.column(vector)), batch.column(block).to_numpy()
            scores = np.zeros((len(x), k))
            for b in np.unique(blocks):
                mean, matrix = plan[int(b)]
                scores[blocks == b, : matrix.shape[1]] = (x[blocks == b] - mean) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [list_array(scores)], names=names + [out])

    return df.mapInArrow(run, schema)


def enhance(df: DataFrame, method: str = "PCA", k: int = 10, **kw) -> DataFrame:
    """PCA or MNF scores by name; any other name is an error."""
    if method not in REDUCTIONS:
        raise ValueError(f"method must be one of {REDUCTIONS}")
    if method == "PCA":
        return pca(df.filter("valid"), k, **kw)
    return mnf(df, k, **kw)


def cube_at_mask(scores: DataFrame, labels: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Enhanced features at the pixels of a mask."""
    marked = labels.filter(F.col("label") > 0).select(*keys, "row", "col", "label")
    return scores.join(marked, [*keys, "row", "col"])


def mean_std(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = ()) -> DataFrame:
    """One row per key with the arrays mean and std (population)."""
    sums = band_sums(df, vector, keys)
    entry = F.struct("band", (F.col("s") / F.col("n")).alias("m"), F.sqrt(F.col("m2") / F.col("n")).alias("d"))
    # collect_list holds one entry per band
    grouped = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_p"))
    return grouped.select(
        *keys, F.transform("_p", lambda e: e["m"]).alias("mean"), F.transform("_p", lambda e: e["d"]).alias("std")
    )


def _with_stats(df: DataFrame, vector: str, keys: Sequence[str]) -> DataFrame:
    if keys:
        return df.join(mean_std(df, vector, keys), list(keys))
    stats = mean_std(df, vector).withColumn("_one", F.lit(0))
    # one row of 2 x B numbers
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(stats), "_one").drop("_one")


def standardize(
    df: DataFrame, vector: str = "spectrum", std: bool = True, keys: Sequence[str] = (), out: str = "scaled"
) -> DataFrame:
    """(x - mean) / std per band; a zero std divides by 1; ``std=False`` only centres."""
    joined = _with_stats(df, vector, keys)
    centred = subtract(F.col(vector), F.col("mean"))
    if std:
        divisor = F.transform("std", lambda s: F.when(s == 0, 1.0).otherwise(s))
        centred = F.zip_with(centred, divisor, lambda x, s: x / s)
    return joined.withColumn(out, centred).drop("mean", "std")


def dist_cosine(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = (), out: str = "cosine") -> DataFrame:
    """Cosine of each row to the mean vector; 0 when a norm is 0."""
    joined = _with_stats(df, vector, keys)
    scale = norm(F.col(vector)) * norm(F.col("mean"))
    cosine = F.when(scale == 0, 0.0).otherwise(dot(F.col(vector), F.col("mean")) / scale)
    return joined.withColumn(out, cosine).drop("mean", "std")


def dist_euclidean(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = (), out: str = "distance") -> DataFrame:
    """L2 distance of each row to the mean vector."""
    joined = _with_stats(df, vector, keys)
    return joined.withColumn(out, norm(subtract(F.col(vector), F.col("mean")))).drop("mean", "std")


def dist_mahalanobis(df: DataFrame, vector: str = "spectrum", out: str = "distance") -> DataFrame:
    """Distance to the mean under the pseudo-inverse covariance."""
    m = collect_moments(df, vector)
    inverse = np.linalg.pinv(m.cov, hermitian=True)

    def distance(x: np.ndarray) -> np.ndarray:
        d = x - m.mean
        return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, inverse, d, optimize=True), 0.0))

    return map_vectors(df, vector, out, distance, T.DoubleType())


def spectral_complexity(df: DataFrame, vector: str = "spectrum") -> float:
    """1 - share of the first component's variance on standardised data."""
    m = collect_moments(df, vector)
    sd = np.sqrt(np.diag(m.cov))
    live = sd > 0
    corr = m.cov[np.ix_(live, live)] / np.outer(sd[live], sd[live])
    values = np.linalg.eigvalsh(corr)
    return float(1.0 - values[-1] / values.sum())

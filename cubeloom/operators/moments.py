"""Means, covariances and noise statistics as partial + final aggregation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cubeloom.functions.vectors import subtract

DOUBLES = T.ArrayType(T.DoubleType())
# Keys whose partial results a task holds before handing them on.
HELD_KEYS = 64
NOISE_DIRECTIONS = ("lowerright", "lowerleft", "right", "lower")


def matrix_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """ARRAY<DOUBLE> column -> (rows, width) matrix without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1)


#: Bytes of vectors that a function takes at once: batches are counted in rows, and rows may be wide.
SLICE_BYTES = 16_000_000


def vector_slices(batches: Iterator[pa.RecordBatch], vector: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most SLICE_BYTES of vectors; a batch is let go before the next one is read."""
    for batch in batches:
        step = max(1, SLICE_BYTES * batch.num_rows // max(1, 8 * len(batch.column(vector).flatten())))
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)
        del batch


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """(rows, width) matrix -> ARRAY<DOUBLE> column without a Python loop."""
    matrix = np.ascontiguousarray(matrix, dtype=np.float64)
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()))


def group_slices(table: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key values, row positions) of each key combination in one Arrow batch."""
    if not keys:
        yield (), np.arange(table.num_rows)
        return
    frame = table.select(list(keys)).to_pandas()
    for key, index in frame.groupby(list(keys), sort=False, dropna=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), index


@dataclass(frozen=True)
class Moments:
    """Count, mean vector and sample covariance of one group (B and B x B numbers)."""

    n: int
    mean: np.ndarray
    cov: np.ndarray


def moment_sums(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """sums(keys..., i, n, s, cross): per band i the count, the sum and the row of cross products.

    Every input partition emits B rows of B numbers per key, whatever its size; these add up in an
    ordinary aggregate on (keys, i), so no group of pixels is ever collected.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("i", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("s", T.DoubleType()),
            T.StructField("cross", T.ArrayType(T.DoubleType())),
        ]
    )
    names = list(keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, (n, s, cross) in totals.items():
                width = len(s)
                columns = [pa.array([v] * width, type=t) for v, t in zip(key, key_types)]
                columns += [
                    pa.array(np.arange(width, dtype=np.int32)),
                    pa.array(np.full(width, n, dtype=np.int64)),
                    pa.array(s),
                    list_array(cross),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names + ["i", "n", "s", "cross"])
            totals.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = matrix_of(batch.column(vector))
            for key, index in group_slices(batch, names):
                x = values if len(index) == len(values) else values[index]
                entry = totals.setdefault(key, [0, 0.0, 0.0])
                entry[0] += len(x)
                entry[1] = entry[1] + x.sum(axis=0)
                entry[2] = entry[2] + x.T @ x
            # many keys in one partition: hand the partial sums on instead of holding them all
            if len(totals) > HELD_KEYS:
                yield from flush()
        yield from flush()

    key_types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    parts = df.select(*keys, vector).mapInArrow(partial, schema)
    width = vector_width(df, vector) if width is None else width
    if width == 0:
        return parts
    summed = parts.groupBy(*keys, "i").agg(
        F.sum("n").alias("n"),
        F.sum("s").alias("s"),
        F.expr("array(" + ", ".join(f"sum(cross[{j}])" for j in range(width)) + ")").alias("cross"),
    )
    return summed


def vector_width(df: DataFrame, vector: str) -> int:
    """Length of the vectors (all rows agree); 0 for an empty frame. Reads one row."""
    first = df.select(F.size(vector).alias("w")).first()
    return 0 if first is None else int(first["w"])


def covariance(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """cov(keys..., i, j, n, mean_i, mean_j, cov): sample covariance in long form, in one pass over the vectors."""
    sums = moment_sums(df, vector, keys, width)
    # one row per band: each gets the sums of all bands
    bands = Window.partitionBy(*keys)
    sums = sums.withColumn("_s", F.array_sort(F.collect_list(F.struct("i", "s")).over(bands)))
    joined = sums.select(*keys, "i", "n", "s", "_s", F.posexplode("cross").alias("j", "c")).withColumn("sj", F.get("_s", F.col("j"))["s"])
    n = F.col("n")
    return joined.select(
        *keys,
        "i",
        "j",
        "n",
        (F.col("s") / n).alias("mean_i"),
        (F.col("sj") / n).alias("mean_j"),
        ((F.col("c") - F.col("s") * F.col("sj") / n) / (n - 1)).alias("cov"),
    )


def band_sums(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = ()) -> DataFrame:
    """sums(keys..., band, n, s, m2): count, sum and summed squared deviation of every band.

    A batch emits one row per key and band with its own centred squares; Spark adds them up, map
    side first, so a key that holds most rows costs no more than its batches.
    """
    names = list(keys)
    fields = [df.schema[k] for k in keys]
    key_types = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType(
        fields
        + [T.StructField("band", T.IntegerType()), T.StructField("n", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("s", "inner", "outer")]
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix_of(batch.column(vector))
            if names:
                frame = batch.select(names).to_pandas()
                group = frame.groupby(names, sort=False, dropna=False)
                code = group.ngroup().to_numpy()
                heads = frame.loc[~frame.duplicated()]
            else:
                code, heads = np.zeros(len(x), dtype=np.int64), None
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.diff(code[order], prepend=-1))
            n = np.diff(starts, append=len(x))
            s = np.add.reduceat(x[order], starts, axis=0)
            centred = x - (s / n[:, None])[code]
            inner = np.add.reduceat((centred * centred)[order], starts, axis=0)
            width = x.shape[1]
            columns = [pa.array(np.repeat(heads[k].to_numpy(), width), type=t, from_pandas=True) for k, t in zip(names, key_types)]
            columns += [
                pa.array(np.tile(np.arange(width, dtype=np.int32), len(n))),
                pa.array(np.repeat(n, width)),
                pa.array(s.ravel()),
                pa.array(inner.ravel()),
                pa.array((s * s / n[:, None]).ravel()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    parts = df.select(*keys, vector).mapInArrow(partial, schema)
    added = parts.groupBy(*keys, "band").agg(*[F.sum(c).alias(c) for c in ("n", "s", "inner", "outer")])
    m2 = F.greatest(F.col("inner") + F.col("outer") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0))
    return added.select(*keys, "band", "n", "s", m2.alias("m2"))


def band_stats(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = ()) -> DataFrame:
    """stats(keys..., band, n, mean, var): 0-based band, sample variance."""
    n = F.col("n")
    return band_sums(df, vector, keys).select(
        *keys, "band", "n", (F.col("s") / n).alias("mean"), (F.col("m2") / (n - 1)).alias("var")
    )


def _moments(rows: list) -> Moments:
    rows = sorted(rows, key=lambda r: r["i"])
    n = int(rows[0]["n"])
    s = np.array([r["s"] for r in rows])
    cross = np.array([r["cross"] for r in rows])
    cov = (cross - np.outer(s, s) / n) / max(n - 1, 1)
    return Moments(n, s / n, (cov + cov.T) / 2)


def collect_moments(df: DataFrame, vector: str = "spectrum", width: int | None = None) -> Moments:
    """Moments of one group on the driver: B rows of B numbers, independent of the pixel count."""
    rows = moment_sums(df, vector, width=width).collect()
    if not rows:
        raise ValueError("no rows to take statistics of")
    return _moments(rows)


def collect_moments_by(df: DataFrame, key: str, vector: str = "spectrum") -> dict[int, Moments]:
    """Moments of every value of a key with few values (blocks of a scene), in one job."""
    rows: dict[int, list] = {}
    for row in moment_sums(df, vector, [key]).collect():
        rows.setdefault(row[key], []).append(row)
    return {k: _moments(v) for k, v in rows.items()}


def noise_differences(
    df: DataFrame, direction: str = "lowerright", vector: str = "spectrum", valid: str | None = "valid",
    keys: Sequence[str] = ("scene_id",),
) -> DataFrame:
    """diffs(keys..., row, col, delta): a pixel minus its neighbour in the given direction.

    One shuffle: pixels on the same line of that direction are neighbours in a window ordered
    along it, and a value-range frame of exactly one step skips gaps. A line is bounded by the
    scene's side. Both pixels must be valid.
    """
    name = direction.lower()
    if name not in NOISE_DIRECTIONS:
        raise ValueError(f"direction must be one of {NOISE_DIRECTIONS}")
    line, along = {
        "lowerright": (F.col("row") - F.col("col"), "row"),
        "lowerleft": (F.col("row") + F.col("col"), "row"),
        "right": (F.col("row"), "col"),
        "lower": (F.col("col"), "row"),
    }[name]
    pixels = df.filter(F.col(valid)) if valid else df
    step = Window.partitionBy(*keys, line).orderBy(along).rangeBetween(1, 1)
    paired = pixels.select(
        *keys, "row", "col", F.col(vector).alias("_a"), F.first(vector).over(step).alias("_b")
    )
    return paired.filter(F.col("_b").isNotNull()).select(
        *keys, "row", "col", subtract(F.col("_a"), F.col("_b")).alias("delta")
    )


def noise_moments(df: DataFrame, direction: str = "lowerright", **kw) -> Moments:
    """Noise statistics: moments of the differences with the covariance halved."""
    width = vector_width(df, kw.get("vector", "spectrum"))  # of the input, not of the differences
    m = collect_moments(noise_differences(df, direction, **kw), "delta", width)
    return Moments(m.n, m.mean, m.cov / 2.0)


def noise_covariance(df: DataFrame, direction: str = "lowerright", **kw) -> DataFrame:
    """Long form of :func:`noise_moments`."""
    width = vector_width(df, kw.get("vector", "spectrum"))
    cov = covariance(noise_differences(df, direction, **kw), "delta", width=width)
    return cov.withColumn("cov", F.col("cov") / 2.0)

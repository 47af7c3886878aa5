"""Pixel purity, superpixel statistics and SMACC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.storagelevel import StorageLevel

from cubeloom.functions.vectors import arith_key, dot, sqnorm
from cubeloom.operators.moments import HELD_KEYS, band_sums, group_slices, list_array, matrix_of, moment_sums
from cubeloom.operators.ranking import flag_first, top_per_group
from cubeloom.session import cut_lineage

# Fixed value: guards the min-max normalisation.
NORM_EPS = 1e-12
#: Pixels of a group that meet its extremes in one task, on average.
BLOCK_ROWS = 20_000


def random_sample_mask(
    pixels: DataFrame, rows: int, cols: int, fraction: float, seed: int = 42, ident: str = "pix"
) -> DataFrame:
    """int(rows * cols * fraction) distinct pixels of the whole grid, background then dropped."""
    flagged = flag_first(pixels, [], arith_key(F.col(ident), seed), F.col(ident), int(rows * cols * fraction))
    return flagged.filter("selected AND valid").drop("selected")


def random_directions(niters: int, width: int, seed: int = 0) -> np.ndarray:
    """niters unit vectors, uniform in the centred cube before normalising."""
    r = np.random.default_rng(seed).random((niters, width)) - 0.5
    return r / np.sqrt((r * r).sum(axis=1, keepdims=True))


def direction_extremes(
    df: DataFrame, directions: np.ndarray, vector: str = "spectrum", ident: str = "pix", keys: Sequence[str] = ()
) -> DataFrame:
    """extremes(keys..., dir, hi, hi_pix, lo, lo_pix): each direction's extreme projections.

    Every partition keeps one candidate pair per key and direction, then an ordinary aggregate
    merges them; the first pixel wins a tie. Centring would shift all projections of a direction
    alike, so it is left out.
    """
    names = list(keys)
    fields = [df.schema[k] for k in keys]
    schema = T.StructType(
        fields
        + [
            T.StructField("dir", T.IntegerType()),
            T.StructField("hi", T.DoubleType()),
            T.StructField("hi_pix", T.LongType()),
            T.StructField("lo", T.DoubleType()),
            T.StructField("lo_pix", T.LongType()),
        ]
    )
    key_types = [to_arrow_type(f.dataType) for f in fields]
    count = len(directions)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list[np.ndarray]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key, (hi, hp, lo, lp) in best.items():
                columns = [pa.array([v] * count, type=t) for v, t in zip(key, key_types)]
                columns += [pa.array(np.arange(count, dtype=np.int32)), pa.array(hi), pa.array(hp), pa.array(lo), pa.array(lp)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            best.clear()

        for batch in batches:
            if batch.num_rows == 0:
                continue
            scores = matrix_of(batch.column(vector)) @ directions.T
            pix = batch.column(ident).to_numpy().astype(np.int64)
            for key, index in group_slices(batch, names):
                order = index[np.argsort(pix[index], kind="stable")]
                s, p = scores[order], pix[order]
                top, low = s.argmax(axis=0), s.argmin(axis=0)
                line = np.arange(count)
                new = [s[top, line], p[top], s[low, line], p[low]]
                if key not in best:
                    best[key] = new
                    continue
                old = best[key]
                up = (new[0] > old[0]) | ((new[0] == old[0]) & (new[1] < old[1]))
                down = (new[2] < old[2]) | ((new[2] == old[2]) & (new[3] < old[3]))
                best[key] = [np.where(m, a, b) for m, a, b in zip((up, up, down, down), new, old)]
            # many superpixels in one partition: hand the candidates on instead of holding them all
            if len(best) > HELD_KEYS:
                yield from flush()
        yield from flush()

    parts = df.select(*keys, F.col(ident).cast("long").alias(ident), vector).mapInArrow(partial, schema)
    return parts.groupBy(*keys, "dir").agg(
        F.max("hi").alias("hi"),
        F.max_by("hi_pix", F.struct("hi", (-F.col("hi_pix")).alias("t"))).alias("hi_pix"),
        F.min("lo").alias("lo"),
        F.min_by("lo_pix", F.struct("lo", "lo_pix")).alias("lo_pix"),
    )


def ppi(
    df: DataFrame,
    directions: np.ndarray,
    threshold: float = 0.0,
    vector: str = "spectrum",
    ident: str = "pix",
    keys: Sequence[str] = (),
) -> DataFrame:
    """purity(keys..., ident, count): how often a pixel is extreme; pixels never hit are absent.

    With a threshold every pixel within it of an extreme counts: a second pass compares the pixels with the
    (keys x directions) extremes, held once per task or block, and emits only hits. Rows whose key is null take no part then.
    """
    extremes = direction_extremes(df, directions, vector, ident, keys)
    if threshold == 0:
        hits = extremes.select(*keys, F.explode(F.array("hi_pix", "lo_pix")).alias(ident))
        return hits.groupBy(*keys, ident).agg(F.count("*").alias("count"))
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys] + [T.StructField(ident, T.LongType()), T.StructField("count", T.LongType())]
    schema = T.StructType(fields)
    pixels = df.select(*keys, F.col(ident).cast("long").alias(ident), vector)

    def hits(values: pa.ChunkedArray | pa.Array, hi: np.ndarray, lo: np.ndarray) -> pa.Array:
        s = matrix_of(values) @ directions.T
        return pa.array(((s >= hi - threshold).sum(axis=1) + (s <= lo + threshold).sum(axis=1)).astype(np.int64))

    if not keys:
        # one row per direction, as the directions themselves
        found = extremes.orderBy("dir").collect()
        hi, lo = np.array([r["hi"] for r in found]), np.array([r["lo"] for r in found])

        def count_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(ident), hits(batch.column(vector), hi, lo)], names=schema.names)

        return pixels.mapInArrow(count_hits, schema).filter(F.col("count") > 0)
    # blocks of a group's pixels meet the group's extremes, which are held once per block
    sizes = pixels.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("_blocks"))
    blocked = pixels.join(sizes, list(keys)).withColumn("_block", F.pmod(F.xxhash64(ident), "_blocks")).drop("_blocks")
    copies = extremes.select(*keys, "dir", "hi", "lo").join(sizes, list(keys))
    copies = copies.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")

    types = [to_arrow_type(f.dataType) for f in schema]

    def count_block(rows: pa.Table, bounds: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return pa.table([pa.array([], type=t) for t in types], names=schema.names)
        bounds = bounds.sort_by("dir")
        counts = hits(rows.column(vector), bounds.column("hi").to_numpy(), bounds.column("lo").to_numpy())
        return pa.table([*(rows.column(k) for k in keys), rows.column(ident), counts], names=schema.names)

    on = [*keys, "_block"]
    return blocked.groupBy(*on).cogroup(copies.groupBy(*on)).applyInArrow(count_block, schema).filter(F.col("count") > 0)


def segment_stats(df: DataFrame, vector: str = "spectrum", keys: Sequence[str] = ("seg",)) -> DataFrame:
    """stats(keys..., area, var_sum): size and summed per-band population variance of a superpixel."""
    sums = band_sums(df, vector, keys)
    return sums.groupBy(*keys).agg(F.max("n").alias("area"), F.sum(F.col("m2") / F.col("n")).alias("var_sum"))


def segment_sample_counts(stats: DataFrame, max_samples: int = 20) -> DataFrame:
    """Adds score and n_samples: more samples for varied and for small superpixels."""
    extent = stats.agg(
        F.min("var_sum").alias("_v0"), F.max("var_sum").alias("_v1"), F.min("area").alias("_a0"), F.max("area").alias("_a1")
    ).withColumn("_one", F.lit(0))
    joined = stats.withColumn("_one", F.lit(0)).join(F.broadcast(extent), "_one")

    def scaled(value: str, lo: str, hi: str) -> Column:
        spread = F.col(hi) - F.col(lo)
        return F.when(spread == 0, 0.0).otherwise((F.col(value) - F.col(lo)) / (spread + NORM_EPS))

    score = (scaled("var_sum", "_v0", "_v1") + 1.0 - scaled("area", "_a0", "_a1")) / 2
    n = F.least(F.greatest(F.rint(score * max_samples), F.lit(1.0)), F.lit(float(max_samples)))
    return joined.withColumn("score", score).withColumn("n_samples", n.cast("int")).drop(
        "_one", "_v0", "_v1", "_a0", "_a1"
    )


def segment_mean_color(df: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("seg",)) -> DataFrame:
    """Paints every pixel with the mean colour of its superpixel."""
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in channels])
    return df.join(means, list(keys))


def topn_per_segment(counts: DataFrame, quotas: DataFrame, max_samples: int, ident: str = "pix") -> DataFrame:
    """The n_samples purest pixels of each superpixel among those ever hit.

    Dropping zero counts first gives the same pixels as dropping them last.
    """
    hit = counts.filter(F.col("count") > 0)
    top = top_per_group(hit, ["seg"], [F.col("count").desc(), F.col(ident).desc()], max_samples)
    return top.join(quotas.select("seg", "n_samples"), "seg").filter(F.col("rank") <= F.col("n_samples"))


def segment_ppi_sampling(
    df: DataFrame,
    directions: np.ndarray,
    max_samples: int = 20,
    threshold: float = 0.0,
    vector: str = "spectrum",
    ident: str = "pix",
) -> DataFrame:
    """Purity sampling inside every superpixel in one job: stats, quotas, extremes, top n."""
    quotas = segment_sample_counts(segment_stats(df, vector), max_samples)
    counts = ppi(df, directions, threshold, vector, ident, ["seg"])
    return topn_per_segment(counts, quotas, max_samples, ident)


# --- SMACC --------------------------------------------------------------------------------------


def argmax_pixel(df: DataFrame, score: Column, ident: str = "pix", keys: Sequence[str] = ()) -> DataFrame:
    """The pixel with the largest score per key, the first one on ties."""
    return df.groupBy(*keys).agg(F.max_by(ident, F.struct(score.alias("s"), (-F.col(ident)).alias("t"))).alias(ident))


def smacc(
    df: DataFrame,
    endmembers: int | dict[int, int] | None = None,
    vector: str = "spectrum",
    ident: str = "pix",
    block: str | None = None,
    max_residual: float | None = float("inf"),
    cut_every: int = 8,
) -> tuple[DataFrame, DataFrame]:
    """Sequential maximum-angle endmembers: (abundances, endmembers).

    Row state (residual and abundances) stays distributed; a step finds each block's largest
    residual by aggregation and sends one vector per block to the rows. Blocks advance together.
    Returns abundances(block, ident, f, residual, is_endmember) and
    endmembers(block, step, ident, spectrum). A block is done when it has its number of
    endmembers (the rank of its vectors by default) and no residual norm above ``max_residual``
    (None: its largest norm divided by that number).
    """
    spark = df.sparkSession
    source = df.select(
        (F.col(block).cast("int") if block else F.lit(0)).alias("block"),
        F.col(ident).cast("long").alias(ident),
        F.col(vector).cast("array<double>").alias("h"),
    )
    state = cut_lineage(source.withColumn("r", F.col("h")).withColumn("f", F.array().cast("array<double>")))
    if endmembers is None:
        endmembers = vector_ranks(source)

    def wanted(b: int) -> int:
        return endmembers.get(b, 0) if isinstance(endmembers, dict) else endmembers

    limits: dict[int, float] = {}
    chosen: list[tuple[int, int, int, list[float]]] = []
    per_block: dict[int, int] = {}
    schema = state.schema
    held = []
    step = 0
    while True:
        best = state.groupBy("block").agg(
            F.max_by(F.struct(ident, "h", "r", "f", F.sqrt(sqnorm(F.col("r"))).alias("n")),
                     F.struct(sqnorm(F.col("r")).alias("s"), (-F.col(ident)).alias("t"))).alias("m")
        ).collect()
        active: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        for row in best:
            b, m = row["block"], row["m"]
            count = per_block.get(b, 0)
            if max_residual is None:
                limit = limits.setdefault(b, m["n"] / max(wanted(b), 1))
            else:
                limit = max_residual
            if count >= wanted(b) and not m["n"] > limit:
                continue
            if m["n"] == 0.0:
                continue
            active[b] = (np.array(m["r"]), np.array(m["f"], dtype=float), m[ident])
            per_block[b] = count + 1
            chosen.append((b, count, m[ident], list(m["h"])))
        if not active:
            break
        # a step is kept for the next one only; a lost block is redone from the last checkpoint
        state = state.mapInArrow(_smacc_step(active, ident, schema.names), schema).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
        step += 1
        if step % cut_every == 0:
            state = cut_lineage(state)
            while held:
                held.pop().unpersist()
        elif len(held) > 2:
            held.pop(0).unpersist()
    picks = spark.createDataFrame(chosen, f"block int, step int, {ident} long, spectrum array<double>")
    marked = picks.select("block", ident, F.col("step").alias("_step"))
    # an endmember is wholly itself: its abundances become a unit vector
    flagged = state.join(marked.groupBy("block", ident).agg(F.max("_step").alias("_step")), ["block", ident], "left")
    unit = F.transform("f", lambda x, i: F.when(F.col("_step").isNull(), x).otherwise((i == F.col("_step")).cast("double")))
    abundances = flagged.select(
        "block", ident, unit.alias("f"), F.col("r").alias("residual"), F.col("_step").isNotNull().alias("is_endmember")
    )
    return abundances, picks


def vector_ranks(source: DataFrame) -> dict[int, int]:
    """Rank of the vectors of every block, from their cross products."""
    rows: dict[int, list] = {}
    for row in moment_sums(source, "h", ["block"]).collect():
        rows.setdefault(row["block"], []).append((row["i"], row["cross"]))
    # singular values are square roots of these eigenvalues, so the cut is the square of the usual one
    ranks = {}
    for b, parts in rows.items():
        values = np.linalg.eigvalsh(np.array([c for _, c in sorted(parts)]))
        ranks[b] = int((values > values.max() * 1e-13).sum())
    return ranks


def _smacc_step(active: dict, ident: str, names: list[str]):
    """One oblique projection of every row of the active blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            blocks = batch.column("block").to_numpy()
            pix = batch.column(ident).to_numpy()
            residual = matrix_of(batch.column("r")).copy()
            abundance = batch.column("f").to_pylist()
            for b, (w, f_of_w, winner) in active.items():
                rows = np.flatnonzero(blocks == b)
                if len(rows) == 0:
                    continue
                f = np.array([abundance[i] for i in rows], dtype=float).reshape(len(rows), len(f_of_w))
                on = residual[rows] @ (w / (w @ w))
                alpha = np.ones(len(rows))
                if f.shape[1]:
                    t = on[:, None] * f_of_w
                    t[t == 0.0] = 1e-10
                    alpha = np.minimum(alpha, (f / t).min(axis=1))
                alpha[on <= 0.0] = 0.0
                alpha[pix[rows] == winner] = 1.0
                fn = np.maximum(alpha * on, 0.0)
                residual[rows] -= fn[:, None] * w
                f = np.maximum(f - f_of_w * fn[:, None], 0.0)
                for i, values in zip(rows, np.column_stack([f, fn])):
                    abundance[i] = values
            columns = {
                "r": list_array(residual),
                "f": pa.array(abundance, type=pa.list_(pa.float64())),
            }
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in names], names=names)

    return run

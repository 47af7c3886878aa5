"""Patches around pixels and their augmentation."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions import geo
from cubeloom.functions.vectors import arith_key
from cubeloom.operators.moments import DOUBLES, list_array, matrix_of, vector_slices, vector_width
from cubeloom.operators.tiles import TILE


def patch_gather(
    centres: DataFrame,
    pixels: DataFrame,
    p: int,
    ident: Sequence[str] = ("row", "col"),
    keys: Sequence[str] = ("scene_id",),
    fill: float = 0.0,
    bands: int | None = None,
) -> DataFrame:
    """Adds cube (band-major, p*p per band) and n_inside to every centre; cells without a pixel are padded.

    Pixels move once, as halo tiles that hold a centre; a patch is cut once per pixel inside its tile, and the centres meet their
    patch by pixel. Tiles are as wide as PATCH_BYTES of patches allow, so a task's group is bounded. Of repeated pixels one is taken;
    a centre without row or column has no patch.
    """
    before, after = geo.patch_radius(p)
    width = bands or vector_width(pixels, "spectrum")
    names = list(dict.fromkeys([*keys, *ident, "row", "col"]))
    place = [*keys, "row", "col"]
    tile = int(np.clip((PATCH_BYTES / (8.0 * p * p * max(1, width))) ** 0.5, 1, TILE))
    tiles = [*keys, "tile_row", "tile_col"]
    # named anew: centres are often taken from the pixels themselves
    wanted = centres.filter("row IS NOT NULL AND col IS NOT NULL").select(*[F.col(c).alias(c) for c in place]).distinct()
    for axis in ("row", "col"):
        wanted = wanted.withColumn(f"tile_{axis}", F.floor(F.col(axis) / tile).cast("int"))
    source = pixels.filter(F.col("spectrum").isNotNull()).select(*place, F.col("spectrum").cast("array<double>").alias("_s"))

    def owners(axis: str) -> Column:
        # the tiles whose centres see this pixel; centres may lie outside the scene
        low, high = F.floor((F.col(axis) - after) / tile).cast("int"), F.floor((F.col(axis) + before) / tile).cast("int")
        return F.explode(F.sequence(low, high))

    copies = source.withColumn("tile_row", owners("row")).withColumn("tile_col", owners("col"))
    copies = copies.join(wanted.select(*tiles).distinct(), tiles, "left_semi")
    cut = _cut_patches(wanted, copies, tiles, place, p, before, width, fill)
    return centres.select(*names).distinct().join(cut, place).select(*names, "n_inside", F.lit(p).alias("p"), "cube")


#: Bytes of the patches of one tile.
PATCH_BYTES = 64_000_000


def _cut_patches(wanted: DataFrame, copies: DataFrame, tiles: Sequence[str], place: Sequence[str], p: int, before: int, width: int,
                 fill: float) -> DataFrame:
    """(place, n_inside, cube) of every wanted pixel, tile by tile."""
    place = list(place)
    schema = T.StructType([wanted.schema[c] for c in place] + [T.StructField("n_inside", T.IntegerType()), T.StructField("cube", DOUBLES)])

    def cut(centres: pa.Table, pixels: pa.Table) -> pa.Table:
        r, c = (centres.column(axis).to_numpy() for axis in ("row", "col"))
        n = len(r)
        # row of each pixel's spectrum in a dense grid around the centres; the last spectrum is the filling
        low = (r.min() - before, c.min() - before) if n else (0, 0)
        grid = np.full((int(r.max() - r.min()) + p, int(c.max() - c.min()) + p) if n else (p, p), len(pixels))
        if len(pixels):
            i, j = (pixels.column(axis).to_numpy() - l for axis, l in zip(("row", "col"), low))
            held = np.flatnonzero((i >= 0) & (j >= 0) & (i < grid.shape[0]) & (j < grid.shape[1]))
            grid[i[held], j[held]] = held
            spectra = np.vstack([matrix_of(pixels.column("_s")), np.full((1, width), float(fill))])
        else:
            spectra = np.full((1, width), float(fill))
        window = np.lib.stride_tricks.sliding_window_view(grid, (p, p))[r - low[0] - before, c - low[1] - before].reshape(n, p * p)
        cube = np.empty((n, width, p * p))
        for lo in range(0, n, 1024):
            cube[lo : lo + 1024] = spectra[window[lo : lo + 1024]].transpose(0, 2, 1)
        cube = cube.reshape(n, width * p * p)
        inside = (window < len(pixels)).sum(axis=1).astype(np.int32)
        return pa.table([centres.column(name) for name in place] + [pa.array(inside), list_array(cube)], names=schema.names)

    return wanted.groupBy(*tiles).cogroup(copies.groupBy(*tiles)).applyInArrow(cut, schema)


def patch_gather_points(
    points: DataFrame,
    pixels: DataFrame,
    p: int,
    gt: geo.GeoTransform,
    rows: int,
    cols: int,
    ident: Sequence[str] = ("fid",),
    keys: Sequence[str] = ("scene_id",),
    fill: float = 0.0,
    bands: int | None = None,
) -> DataFrame:
    """Patches of a point layer; a centre outside the scene stays while its window overlaps it."""
    before, after = geo.patch_radius(p)
    located = points.withColumn("row", geo.geo_row(F.col("y"), gt)).withColumn("col", geo.geo_col(F.col("x"), gt))
    overlaps = F.col("row").between(-after, rows - 1 + before) & F.col("col").between(-after, cols - 1 + before)
    return patch_gather(located.filter(overlaps), pixels, p, ident, keys, fill, bands)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """The frame itself, or an error when it is empty (reads at most one row)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def patch_origin(df: DataFrame, p: int, gt: geo.GeoTransform) -> DataFrame:
    """Adds the map origin of each patch."""
    return df.withColumn("origin_x", geo.patch_origin_x(F.col("col"), p, gt)).withColumn(
        "origin_y", geo.patch_origin_y(F.col("row"), p, gt)
    )


def patch_center_spectrum(cube: Column, p: int) -> Column:
    """Spectrum of the patch centre."""
    c = geo.patch_radius(p)[0]
    bands = (F.size(cube) / (p * p)).cast("int")
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.get(cube, b * (p * p) + c * p + c))


# --- augmentation: pure functions of (patch id, seed, element), whole batches at a time -----------

# (patches, per-patch 64-bit hash) -> patches
CubeMap = Callable[[np.ndarray, np.ndarray], np.ndarray]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def unit_hash(*parts: Column) -> Column:
    """Uniform value in [0, 1) from the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def uniform(keys: np.ndarray, stream: int, count: int = 1) -> np.ndarray:
    """(len(keys), count) uniform values in [0, 1): a mix of key, stream and position only."""
    with np.errstate(over="ignore"):
        z = keys.astype(np.uint64)[:, None] + np.uint64(stream + 1) * _MIX[2]
        z = z + np.arange(1, count + 1, dtype=np.uint64) * _MIX[0]
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)) * (1.0 / (1 << 53))


def normal(keys: np.ndarray, stream: int, count: int) -> np.ndarray:
    """Standard normal values (Box-Muller on two streams)."""
    radius = np.sqrt(-2.0 * np.log(1.0 - uniform(keys, 2 * stream + 1000, count)))
    return radius * np.cos(2.0 * np.pi * uniform(keys, 2 * stream + 1001, count))


def map_cubes(df: DataFrame, ident: str | None, function: CubeMap, seed: int = 0, cube: str = "cube") -> DataFrame:
    """Replaces the cubes by ``function`` of them and of a hash of (ident, seed); one Arrow pass."""
    key = F.xxhash64(F.col(ident), F.lit(seed)) if ident else F.lit(0).cast("long")
    prepared = df.withColumn("_h", key)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in vector_slices(batches, cube):
            result = function(matrix_of(batch.column(cube)), batch.column("_h").to_numpy().view(np.uint64))
            columns = [list_array(result) if n == cube else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            del batch, result, columns

    schema = T.StructType([T.StructField(f.name, DOUBLES) if f.name == cube else f for f in df.schema.fields])
    return prepared.mapInArrow(run, schema)


def permute(x: np.ndarray, order: Sequence[int]) -> np.ndarray:
    """Reorders the cells of every band: output cell k takes input cell order[k]."""
    n, pp = len(x), len(order)
    return x.reshape(n, -1, pp)[:, :, np.asarray(order)].reshape(n, -1)


def flip_order(p: int, axis: str) -> list[int]:
    """Cell order of a flip along the rows or the columns."""
    if axis not in ("rows", "cols"):
        raise ValueError("axis is 'rows' or 'cols'")
    return np.flip(np.arange(p * p).reshape(p, p), 0 if axis == "rows" else 1).ravel().tolist()


def rot_order(p: int, quarter_turns: int) -> list[int]:
    """Cell order of a counter-clockwise rotation by quarter turns."""
    return np.rot90(np.arange(p * p).reshape(p, p), quarter_turns).ravel().tolist()


def augment_flip(df: DataFrame, p: int, axis: str = "cols", cube: str = "cube") -> DataFrame:
    order = flip_order(p, axis)
    return map_cubes(df, None, lambda x, _: permute(x, order), cube=cube)


def augment_rot90(df: DataFrame, p: int, quarter_turns: int = 1, cube: str = "cube") -> DataFrame:
    order = rot_order(p, quarter_turns)
    return map_cubes(df, None, lambda x, _: permute(x, order), cube=cube)


def random_flip(p: int, probability: float) -> CubeMap:
    order = flip_order(p, "cols")

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.where(uniform(h, 0) < probability, permute(x, order), x)

    return run


def noise(std: float | tuple[float, float], probability: float = 1.0) -> CubeMap:
    """Additive gaussian noise; a (low, high) pair draws one strength per patch."""

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        low, high = std if isinstance(std, tuple) else (std, std)
        strength = (low + (high - low) * uniform(h, 1)) * (uniform(h, 2) < probability)
        return x + strength * normal(h, 0, x.shape[1])

    return run


def erase(p: int, probability: float, scale: tuple[float, float], ratio: tuple[float, float], value: float = 0.0) -> CubeMap:
    """A random rectangle of some patches becomes ``value``, never the centre pixel."""
    c = geo.patch_radius(p)[0]

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        area = (scale[0] + (scale[1] - scale[0]) * uniform(h, 3)) * p * p
        aspect = ratio[0] + (ratio[1] - ratio[0]) * uniform(h, 4)
        height = np.clip(np.floor(np.sqrt(area * aspect)), 1, p)
        width = np.clip(np.floor(np.sqrt(area / aspect)), 1, p)
        top, left = np.floor(uniform(h, 5) * (p - height + 1)), np.floor(uniform(h, 6) * (p - width + 1))
        r, q = np.divmod(np.arange(p * p), p)
        hit = (r >= top) & (r < top + height) & (q >= left) & (q < left + width) & (uniform(h, 7) < probability)
        hit[:, c * p + c] = False
        return np.where(hit[:, None, :], value, x.reshape(len(x), -1, p * p)).reshape(x.shape)

    return run


def spectral_mask(mask_prob: float, keep: float) -> CubeMap:
    """Keeps each element with probability ``keep``; a patch drawn with ``mask_prob`` stays whole."""

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.where((uniform(h, 8, x.shape[1]) < keep) | (uniform(h, 9) < mask_prob), x, 0.0)

    return run


def band_dropout(p: int, drop: float, drop_prob: float, seed: int) -> CubeMap:
    """Zeroes whole bands for a share of the patches; the dropped bands are the same for a seed."""

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        bands = x.shape[1] // (p * p)
        dropped = uniform(np.array([seed]), 10, bands) <= drop
        gone = np.repeat(dropped, p * p, axis=1) & (uniform(h, 11) < drop_prob)
        return np.where(gone, 0.0, x)

    return run


def rotate_cubes(values: np.ndarray, angles: np.ndarray, p: int) -> np.ndarray:
    """Rotates (n, bands*p*p) patches about their middle, bilinear, zero outside."""
    n = len(values)
    cubes = values.reshape(n, -1, p, p)
    middle = (p - 1) / 2.0
    yy, xx = np.mgrid[0:p, 0:p] - middle
    out = np.zeros_like(cubes)
    rad = np.deg2rad(angles)[:, None, None]
    sx = np.cos(rad) * xx - np.sin(rad) * yy + middle
    sy = np.sin(rad) * xx + np.cos(rad) * yy + middle
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    which = np.arange(n)[:, None, None]
    for dy, dx in itertools.product((0, 1), (0, 1)):
        cx, cy = x0 + dx, y0 + dy
        weight = (1 - np.abs(sx - cx)) * (1 - np.abs(sy - cy))
        ok = (cx >= 0) & (cx < p) & (cy >= 0) & (cy < p)
        taken = cubes[which, :, np.clip(cy, 0, p - 1), np.clip(cx, 0, p - 1)]
        out += np.moveaxis(taken * (weight * ok)[..., None], 3, 1)
    return out.reshape(n, -1)


def random_rotation(p: int, degrees: float, probability: float) -> CubeMap:
    """Rotation of some patches by an angle in [-degrees, degrees]."""

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        turned = uniform(h, 12)[:, 0] < probability
        angles = (2.0 * uniform(h, 13)[:, 0] - 1.0) * degrees
        out = x.copy()
        if turned.any():
            out[turned] = rotate_cubes(x[turned], angles[turned], p)
        return out

    return run


def augment_rotate(df: DataFrame, ident: str, p: int, degrees: float = 90.0, probability: float = 0.5, seed: int = 0, cube: str = "cube") -> DataFrame:
    return map_cubes(df, ident, random_rotation(p, degrees, probability), seed, cube)


def augment_noise(df: DataFrame, ident: str, std: float | tuple[float, float] = 0.02, seed: int = 0, cube: str = "cube") -> DataFrame:
    return map_cubes(df, ident, noise(std), seed, cube)


def augment_erase(
    df: DataFrame, ident: str, p: int, probability: float = 0.5, scale: tuple[float, float] = (0.02, 0.33),
    ratio: tuple[float, float] = (0.3, 3.3), value: float = 0.0, seed: int = 0, cube: str = "cube",
) -> DataFrame:
    return map_cubes(df, ident, erase(p, probability, scale, ratio, value), seed, cube)


def augment_spectral_mask(df: DataFrame, ident: str, mask_prob: float = 0.5, keep: float = 0.5, seed: int = 0, cube: str = "cube") -> DataFrame:
    """With ``mask_prob`` 0 nothing is masked."""
    return df if mask_prob == 0 else map_cubes(df, ident, spectral_mask(mask_prob, keep), seed, cube)


def augment_band_dropout(df: DataFrame, ident: str, p: int, drop: float = 0.2, drop_prob: float = 0.5, seed: int = 0, cube: str = "cube") -> DataFrame:
    return map_cubes(df, ident, band_dropout(p, drop, drop_prob, seed), seed, cube)


# The options that are combined when a sample set is expanded.
EXPAND_FLIPS = ("rows", "cols", None)
EXPAND_TURNS = (1, 2, 3, None)
EXPAND_NOISE = (0.005, 0.010, 0.015, None)


def expand_combinations() -> list[tuple]:
    """Every flip x turn x noise choice except the one that changes nothing."""
    return [c for c in itertools.product(EXPAND_FLIPS, EXPAND_TURNS, EXPAND_NOISE) if any(o is not None for o in c)]


def choose_combinations(factor: int, seed: int = 0) -> list[tuple]:
    """``factor`` distinct combinations in seeded order."""
    options = expand_combinations()
    if factor > len(options):
        raise ValueError(f"at most {len(options)} distinct combinations exist")
    order = np.random.default_rng(seed).permutation(len(options))
    return [options[i] for i in order[:factor]]


def combination_order(p: int, flip: str | None, turn: int | None) -> np.ndarray:
    """Cell order of a flip followed by quarter turns."""
    grid = np.arange(p * p).reshape(p, p)
    if flip is not None:
        grid = np.flip(grid, 0 if flip == "rows" else 1)
    return (grid if turn is None else np.rot90(grid, turn)).ravel()


def augment_expand(
    df: DataFrame, ident: str, p: int, combinations: Sequence[tuple], seed: int = 0, cube: str = "cube"
) -> DataFrame:
    """Original rows (round -1) plus one transformed copy per combination (round 0, 1, ...).

    One pass: a batch of patches is read once and emits all its rounds, nothing is joined.
    """
    names = df.columns
    prepared = df.withColumn("_h", F.xxhash64(F.col(ident), F.lit(seed)))
    plans = [(combination_order(p, flip, turn), std) for flip, turn, std in combinations]
    fields = [T.StructField(f.name, DOUBLES) if f.name == cube else f for f in df.schema.fields]
    schema = T.StructType(fields + [T.StructField("round", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, h = matrix_of(batch.column(cube)), batch.column("_h").to_numpy().view(np.uint64)
            for number in range(-1, len(plans)):
                out = x
                if number >= 0:
                    order, std = plans[number]
                    out = permute(x, order)
                    if std is not None:
                        out = out + std * normal(h, 100 + number, x.shape[1])
                columns = [list_array(out) if n == cube else batch.column(n) for n in names]
                tag = pa.array(np.full(batch.num_rows, number, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(columns + [tag], names=names + ["round"])

    return prepared.mapInArrow(run, schema)


def augment_chain(
    df: DataFrame,
    ident: str,
    p: int,
    seed: int = 0,
    flip_prob: float = 0.5,
    rotate_prob: float = 0.5,
    noise_prob: float = 0.5,
    erase_prob: float = 0.5,
    noise_std: float = 0.01,
    rotate_degrees: float = 90.0,
    erase_scale: tuple[float, float] = (0.01, 0.3),
    erase_ratio: tuple[float, float] = (0.4, 2.5),
    spectral_mask_prob: float = 0.5,
    spectral_keep: float = 0.75,
    band_dropout_prob: float = 0.5,
    band_drop: float = 0.2,
    cube: str = "cube",
) -> DataFrame:
    """Random flip, rotation, noise, erasing, spectral mask and band dropout in one pass."""
    steps: list[CubeMap] = [
        random_flip(p, flip_prob),
        random_rotation(p, rotate_degrees, rotate_prob),
        noise(noise_std, noise_prob),
        erase(p, erase_prob, erase_scale, erase_ratio),
    ]
    if spectral_mask_prob > 0:
        steps.append(spectral_mask(spectral_mask_prob, spectral_keep))
    if band_dropout_prob > 0:
        steps.append(band_dropout(p, band_drop, band_dropout_prob, seed))

    def run(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        for step in steps:
            x = step(x, h)
        return x

    return map_cubes(df, ident, run, seed, cube)


def block_random_sample(
    pixels: DataFrame, p: int, epoch: int, ident: str = "pix", keys: Sequence[str] = ("scene_id",)
) -> DataFrame:
    """One seeded-random valid pixel per p x p block; blocks without valid pixels give none."""
    valid = pixels.filter("valid")
    choice = F.struct(arith_key(F.col(ident), epoch).alias("k"), F.col(ident).alias("t"))
    picked = valid.groupBy(
        *keys, geo.tile_of(F.col("row"), p).alias("block_row"), geo.tile_of(F.col("col"), p).alias("block_col")
    ).agg(F.min_by(F.struct("row", "col", ident), choice).alias("_c"))
    return picked.select(*keys, "block_row", "block_col", "_c.*")

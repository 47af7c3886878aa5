"""Neighbourhood operators as windows inside halo tiles: one shuffle, no Python.

Value-range frames skip gaps, so a missing pixel is simply not part of the neighbourhood.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.operators.quantiles import otsu_threshold
from cubeloom.operators.tiles import TILE, by_tile, halo_tiles, line_windows, tile_apply, tile_array
from cubeloom.session import cut_lineage

SOBEL_LIMIT = 255
# Deep wavelet levels need wide halos, so their tiles are larger.
SWT_TILE = 512


def edge_mask(df: DataFrame, rows: int, cols: int, top=0, bottom=0, left=0, right=0, value: str = "v") -> DataFrame:
    """Zeroes a frame; a frame that covers the image is an error."""
    if top + bottom >= rows or left + right >= cols:
        raise ValueError("the frame is larger than the image")
    kept = F.col("row").between(top, rows - bottom - 1) & F.col("col").between(left, cols - right - 1)
    return df.withColumn(value, F.when(kept, F.col(value)).otherwise(F.lit(0).cast(df.schema[value].dataType)))


def _extreme(df, value, size, iterations, keys, tile, pick) -> DataFrame:
    kernel = (size, size) if isinstance(size, int) else tuple(size)
    reach = []
    for k in kernel:
        anchor = k // 2
        reach.append((anchor * iterations, (k - 1 - anchor) * iterations))
    (rb, ra), (cb, ca) = reach
    rest = [c for c in df.columns]
    tiles = by_tile(halo_tiles(df, tile, max(rb, cb), max(ra, ca)), keys)
    along_row, along_col = line_windows(keys)
    across = tiles.withColumn("_m", pick(value).over(along_row.rangeBetween(-cb, ca)))
    both = across.withColumn("_m", pick("_m").over(along_col.rangeBetween(-rb, ra)))
    return both.filter("core").select(*[F.col("_m").alias(value) if c == value else F.col(c) for c in rest])


def erode(df: DataFrame, value: str = "v", size: int | tuple[int, int] = 5, iterations: int = 1,
          keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Rectangular minimum; n iterations are one window of n times the reach. Outside is ignored."""
    return _extreme(df, value, size, iterations, keys, tile, F.min)


def dilate(df: DataFrame, value: str = "v", size: int | tuple[int, int] = 5, iterations: int = 1,
           keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Rectangular maximum, counterpart of :func:`erode`."""
    return _extreme(df, value, size, iterations, keys, tile, F.max)


def _neighbours(df: DataFrame, value: str, keys: Sequence[str], border: str) -> DataFrame:
    """Adds _n: rows up / here / down of left / here / right values.

    border: "reflect" mirrors without the edge, "replicate" repeats it, "none" leaves nulls.
    """
    along_row, along_col = line_windows(keys)

    def bordered(first: Column, other: Column, here: Column) -> Column:
        if border == "reflect":
            return F.coalesce(first, other, here)
        if border == "replicate":
            return F.coalesce(first, here)
        return first

    def step(column: str, window, k: int) -> Column:
        return F.first(column).over(window.rangeBetween(k, k))

    here = F.col(value)
    wide = df.withColumns({"_l": step(value, along_row, -1), "_r": step(value, along_row, 1)})
    wide = wide.withColumn(
        "_h", F.array(bordered(F.col("_l"), F.col("_r"), here), here, bordered(F.col("_r"), F.col("_l"), here))
    )
    tall = wide.withColumns({"_u": step("_h", along_col, -1), "_d": step("_h", along_col, 1)})
    own = F.col("_h")
    return tall.withColumn(
        "_n", F.array(bordered(F.col("_u"), F.col("_d"), own), own, bordered(F.col("_d"), F.col("_u"), own))
    ).drop("_l", "_r", "_h", "_u", "_d")


def _gradients() -> tuple[Column, Column]:
    n = F.col("_n")

    def at(i: int, j: int) -> Column:
        return n[i][j]

    dx = at(0, 2) - at(0, 0) + 2 * (at(1, 2) - at(1, 0)) + at(2, 2) - at(2, 0)
    dy = at(2, 0) - at(0, 0) + 2 * (at(2, 1) - at(0, 1)) + at(2, 2) - at(0, 2)
    return dx, dy


def sobel_edge(df: DataFrame, value: str = "v", threshold: int = 10, binary: bool = False,
               keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """3x3 gradient of an 8-bit image: saturated |dx| and |dy| averaged, above the threshold -> 255.

    Values at or below the threshold stay as they are unless ``binary``.
    """
    tiles = by_tile(halo_tiles(df, tile, 1, 1), keys)
    dx, dy = _gradients()
    near = _neighbours(tiles, value, keys, "reflect").filter("core")
    cap = F.lit(SOBEL_LIMIT)
    blend = F.rint(0.5 * F.least(F.abs(dx), cap) + 0.5 * F.least(F.abs(dy), cap)).cast("int")
    edge = F.when(blend > threshold, SOBEL_LIMIT).otherwise(F.lit(0) if binary else blend)
    return near.withColumn("edge", edge).drop("_n", "tile_row", "tile_col", "core")


# Fixed value: tangent of 22.5 degrees, bounds the horizontal sector.
TAN_22_5 = 0.4142135623730950488


def canny_candidates(df: DataFrame, value: str = "v", low: int = 50, high: int = 100,
                     keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Local maxima of the L1 gradient above ``low``, with strong = above ``high``."""
    low, high = min(low, high), max(low, high)
    tiles = by_tile(halo_tiles(df, tile, 2, 2), keys)
    dx, dy = _gradients()
    first = _neighbours(tiles, value, keys, "replicate").withColumn("_dx", dx).withColumn("_dy", dy).drop("_n")
    first = first.withColumn("_m", F.abs("_dx") + F.abs("_dy"))
    near = _neighbours(first, "_m", keys, "none").filter("core")

    def mag(i: int, j: int) -> Column:
        return F.coalesce(F.get(F.get(F.col("_n"), F.lit(i)), F.lit(j)), F.lit(0))

    m, ax, ay = F.col("_m"), F.abs("_dx"), F.abs("_dy")
    flat = ay < ax * TAN_22_5
    steep = ay > ax * (TAN_22_5 + 2.0)
    same = (F.col("_dx") < 0) == (F.col("_dy") < 0)
    peak = (
        F.when(flat, (m > mag(1, 0)) & (m >= mag(1, 2)))
        .when(steep, (m > mag(0, 1)) & (m >= mag(2, 1)))
        .when(same, (m > mag(0, 0)) & (m > mag(2, 2)))
        .otherwise((m > mag(0, 2)) & (m > mag(2, 0)))
    )
    return near.filter(peak & (m > low)).select(*keys, "row", "col", m.alias("magnitude"), (m > high).alias("strong"))


def swt_padding(rows: int, cols: int, level: int) -> tuple[int, int, int, int]:
    """(top, bottom, left, right) zeros that make both sides multiples of 2^level."""
    unit = 2**level
    extra_r, extra_c = -rows % unit, -cols % unit
    return extra_r // 2, extra_r - extra_r // 2, extra_c // 2, extra_c - extra_c // 2


def swt_pad(df: DataFrame, rows: int, cols: int, level: int, value: str = "v", fill: float = 0.0) -> DataFrame:
    """(row, col, v) of the padded grid; only the padding cells are generated."""
    top, bottom, left, right = swt_padding(rows, cols, level)
    height, width = rows + top + bottom, cols + left + right
    moved = df.select((F.col("row") + top).alias("row"), (F.col("col") + left).alias("col"), F.col(value).cast("double").alias(value))
    frames = [(top, width, 0, 0), (bottom, width, top + rows, 0), (rows, left, top, 0), (rows, right, top, left + cols)]
    for h, w, r0, c0 in frames:
        if h * w == 0:
            continue
        cells = df.sparkSession.range(h * w)
        moved = moved.unionByName(
            cells.select(
                (F.floor(F.col("id") / w) + r0).cast("int").alias("row"),
                (F.col("id") % w + c0).cast("int").alias("col"),
                F.lit(float(fill)).alias(value),
            )
        )
    return moved


def swt_crop(df: DataFrame, rows: int, cols: int, level: int) -> DataFrame:
    """Removes the padding and restores the original coordinates."""
    top, bottom, left, right = swt_padding(rows, cols, level)
    if top + bottom >= rows + top + bottom or left + right >= cols + left + right:
        raise ValueError("the padding is larger than the image")
    kept = df.filter(F.col("row").between(top, top + rows - 1) & F.col("col").between(left, left + cols - 1))
    return kept.withColumn("row", F.col("row") - top).withColumn("col", F.col("col") - left)


# Analysis filters (low pass, high pass) of the supported wavelets.
WAVELETS = {
    "haar": ([0.7071067811865476, 0.7071067811865476], [-0.7071067811865476, 0.7071067811865476]),
    "db2": (
        [-0.12940952255126037, 0.2241438680420134, 0.8365163037378079, 0.48296291314453416],
        [-0.48296291314453416, 0.8365163037378079, -0.2241438680420134, -0.12940952255126037],
    ),
    "coif1": (
        [-0.01565572813546454, -0.0727326195128539, 0.38486484686420286, 0.8525720202122554, 0.3378976624578092, -0.0727326195128539],
        [0.0727326195128539, 0.3378976624578092, -0.8525720202122554, 0.38486484686420286, 0.0727326195128539, -0.01565572813546454],
    ),
    "bior2.2": (
        [0.0, -0.1767766952966369, 0.3535533905932738, 1.0606601717798214, 0.3535533905932738, -0.1767766952966369],
        [0.0, 0.3535533905932738, -0.7071067811865476, 0.3535533905932738, 0.0, 0.0],
    ),
}
# Other names of the same filters.
WAVELET_ALIASES = {"db1": "haar", "sym2": "db2"}


def _wrapped(df: DataFrame, height: int, width: int, before: int, after: int) -> DataFrame:
    """Adds the periodic copies within ``before`` / ``after`` cells around the grid."""

    def shifts(position: str, length: int) -> Column:
        return F.filter(
            F.array(F.lit(0), F.lit(length), F.lit(-length)),
            lambda s: (F.col(position) + s >= -before) & (F.col(position) + s < length + after),
        )

    copies = df.withColumn("_sr", F.explode(shifts("row", height))).withColumn("_sc", F.explode(shifts("col", width)))
    real = (F.col("_sr") == 0) & (F.col("_sc") == 0)
    # shifted so that coordinates stay non-negative for the tile arithmetic
    return copies.select(
        *[c for c in df.columns if c not in ("row", "col")],
        (F.col("row") + F.col("_sr") + before).alias("row"),
        (F.col("col") + F.col("_sc") + before).alias("col"),
        real.alias("_real"),
    )


def swt_details_haar(padded: DataFrame, height: int, width: int, level: int, value: str = "v", tile: int = TILE) -> DataFrame:
    """(row, col, h, v, d): coarsest Haar details as differences of forward box sums."""
    half = 2 ** (level - 1)
    reach = 2 * half - 1
    grid = _wrapped(padded.select("row", "col", F.col(value).alias("_x")), height, width, 0, reach)
    tiles = by_tile(halo_tiles(grid, tile, 0, reach))
    along_row, along_col = line_windows()

    def boxes(column: str, window) -> tuple[Column, Column]:
        near = F.sum(column).over(window.rangeBetween(0, half - 1))
        far = F.coalesce(F.sum(column).over(window.rangeBetween(half, reach)), F.lit(0.0))
        return near, far

    near, far = boxes("_x", along_row)
    across = tiles.select("row", "col", "tile_row", "tile_col", "core", "_real", (near + far).alias("_lo"), (near - far).alias("_hi"))
    lo_near, lo_far = boxes("_lo", along_col)
    hi_near, hi_far = boxes("_hi", along_col)
    scale = 2.0**-level
    details = across.select(
        "row", "col", "core", "_real",
        ((lo_near - lo_far) * scale).alias("h"),
        ((hi_near + hi_far) * scale).alias("v"),
        ((hi_near - hi_far) * scale).alias("d"),
    )
    return details.filter("core AND _real").select("row", "col", "h", "v", "d")


def _swt_tiles(padded: DataFrame, height: int, width: int, level: int, wavelet: str, value: str, tile: int,
               finish, names: str, ring: int) -> DataFrame:
    """A-trous filtering of halo tiles: one shuffle, then ``finish(h, v, d, inside)`` on each tile.

    ``ring`` extra cells around the tile keep correct details for finishes that look at neighbours;
    ``inside`` marks the cells of the grid itself (the rest are periodic copies).
    """
    name = WAVELET_ALIASES.get(wavelet, wavelet)
    if name not in WAVELETS:
        raise ValueError(f"wavelet must be one of {sorted([*WAVELETS, *WAVELET_ALIASES])}")
    low, high = (np.array(f) for f in WAVELETS[name])
    n = len(low)
    # output o of a level with spacing g takes input o + g*n/2 - g*j for tap j
    before = sum(2**j * (n - 1 - n // 2) for j in range(level)) + ring
    after = sum(2**j * (n // 2) for j in range(level)) + ring
    grid = _wrapped(padded.select("row", "col", F.col(value).alias("x")), height, width, before, after)

    def taps(a: np.ndarray, f: np.ndarray, gap: int, axis: int) -> np.ndarray:
        out = np.zeros_like(a)
        for j, weight in enumerate(f):
            out += weight * np.roll(a, -(gap * (n // 2) - gap * j), axis=axis)
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, r0, c0 = tile_array(pdf, "x", 0.0)
        for j in range(level):
            gap = 2**j
            lo_r = taps(a, low, gap, 0)
            if j == level - 1:
                hi_r = taps(a, high, gap, 0)
                h, v, d = taps(hi_r, low, gap, 1), taps(lo_r, high, gap, 1), taps(hi_r, high, gap, 1)
            a = taps(lo_r, low, gap, 1)
        rows, cols = np.arange(r0, r0 + a.shape[0]) - before, np.arange(c0, c0 + a.shape[1]) - before
        inside = ((rows >= 0) & (rows < height))[:, None] & ((cols >= 0) & (cols < width))[None, :]
        core = pdf[pdf["core"] & pdf["_real"]]
        i, k = core["row"].to_numpy() - r0, core["col"].to_numpy() - c0
        frame = {"row": core["row"] - before, "col": core["col"] - before}
        for out, array in zip(names.split(), finish(h, v, d, inside)):
            frame[out] = array[i, k]
        return pd.DataFrame(frame)

    schema = "row int, col int, " + ", ".join(f"{c} double" for c in names.split())
    return tile_apply(grid, run, schema, tile, before=before, after=after)


def swt_details(padded: DataFrame, height: int, width: int, level: int, wavelet: str = "haar", value: str = "v",
                tile: int = SWT_TILE) -> DataFrame:
    """(row, col, h, v, d) of any supported wavelet at the coarsest level."""
    return _swt_tiles(padded, height, width, level, wavelet, value, tile, lambda h, v, d, _: (h, v, d), "h v d", 0)


def octant_maxima(modulus: np.ndarray, angle: np.ndarray) -> np.ndarray:
    """Modulus where neither neighbour along the angle's octant is larger, else 0.

    Angles outside 0..2pi have no octant and keep their modulus. Cells of -inf never compete.
    """
    around = np.pad(modulus, 1, constant_values=-np.inf)
    h, w = modulus.shape

    def at(dr: int, dc: int) -> np.ndarray:
        return around[1 + dr: 1 + dr + h, 1 + dc: 1 + dc + w]

    octant = np.floor((angle + np.pi / 8) / (np.pi / 4)).astype(int) % 4
    rivals = np.select(
        [octant == 0, octant == 1, octant == 2],
        [np.maximum(at(0, -1), at(0, 1)), np.maximum(at(1, -1), at(-1, 1)), np.maximum(at(1, 0), at(-1, 0))],
        np.maximum(at(-1, -1), at(1, 1)),
    )
    free = (angle < 0) | (angle >= 2 * np.pi)
    return np.where(free | ~(rivals > modulus), modulus, 0.0)


def swt_strength(padded: DataFrame, height: int, width: int, level: int, wavelet: str, use_modulus_maxima: bool,
                 value: str = "v", tile: int = SWT_TILE) -> DataFrame:
    """(row, col, strength): detail norm, or modulus maxima of the first two details, in the same pass."""

    def norm(h, v, d, inside):
        return (np.sqrt(h * h + v * v + d * d),)

    def maxima(h, v, d, inside):
        return (octant_maxima(np.where(inside, np.sqrt(h * h + v * v), -np.inf), np.arctan2(v, h)),)

    finish = maxima if use_modulus_maxima else norm
    return _swt_tiles(padded, height, width, level, wavelet, value, tile, finish, "strength", int(use_modulus_maxima))


def modulus_maxima(df: DataFrame, modulus: str = "m", angle: str = "theta", wrap_angle: bool = False,
                   keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Keeps the modulus where it is not below its two neighbours along the angle's octant.

    Angles outside 0..2pi have no octant and are always kept, unless ``wrap_angle`` maps negative
    ones to their positive equivalent.
    """
    tiles = by_tile(halo_tiles(df, tile, 1, 1), keys)
    near = _neighbours(tiles, modulus, keys, "none").filter("core")
    pi = float(np.pi)
    a = F.col(angle)
    if wrap_angle:
        a = F.when(a < 0, a + 2 * pi).otherwise(a)
    octant = F.when((a >= 0) & (a < 2 * pi), F.floor((a + pi / 8) / (pi / 4)).cast("int") % 4)

    def at(i: int, j: int) -> Column:
        # outside the image nothing competes
        return F.coalesce(F.get(F.get(F.col("_n"), F.lit(i)), F.lit(j)), F.lit(float("-inf")))

    m = F.col(modulus)
    larger = (
        F.when(octant == 0, F.greatest(at(1, 0), at(1, 2)))
        .when(octant == 1, F.greatest(at(2, 0), at(0, 2)))
        .when(octant == 2, F.greatest(at(2, 1), at(0, 1)))
        .when(octant == 3, F.greatest(at(0, 0), at(2, 2)))
    )
    kept = F.when(larger.isNull() | (larger <= m), m).otherwise(0.0)
    return near.withColumn("maxima", kept).drop("_n", "tile_row", "tile_col", "core")


def swt_edge(df: DataFrame, rows: int, cols: int, level: int = 5, wavelet: str = "haar", use_modulus_maxima: bool = True,
             value: str = "v", tile: int = SWT_TILE) -> DataFrame:
    """(row, col, strength, edge): coarsest wavelet details, Otsu threshold, edge = 1 at or above it."""
    top, bottom, left, right = swt_padding(rows, cols, level)
    height, width = rows + top + bottom, cols + left + right
    padded = swt_pad(df, rows, cols, level, value)
    strength = swt_strength(padded, height, width, level, wavelet, use_modulus_maxima, value, tile)
    # read three times (extent, histogram, marking), so it is computed once
    cropped = cut_lineage(swt_crop(strength, rows, cols, level))
    cut = otsu_threshold(cropped, "strength").withColumn("_one", F.lit(0))
    marked = cropped.withColumn("_one", F.lit(0)).join(F.broadcast(cut), "_one")
    return marked.select("row", "col", "strength", (F.col("strength") >= F.col("threshold")).cast("int").alias("edge"))


DOWNSAMPLERS = ("NEAREST", "LINEAR", "CUBIC")
# Fixed value: sharpness of the cubic kernel.
CUBIC_A = -0.75


def axis_weights(spark: SparkSession, size: int, count: int, method: str, name: str) -> DataFrame:
    """weights(name, out_name, w_name): which source lines feed which output lines of one axis.

    Taps beyond the border fall on the border line.
    """
    scale = size / count
    lines = spark.range(count).select(F.col("id").cast("int").alias(f"out_{name}"))
    place = F.col(f"out_{name}")
    if method == "NEAREST":
        source = F.least(F.floor(place * scale), F.lit(size - 1)).cast("int")
        return lines.select(source.alias(name), f"out_{name}", F.lit(1.0).alias(f"w_{name}"))
    reach = 1 if method == "LINEAR" else 2
    centre = (place + 0.5) * scale - 0.5
    taps = lines.withColumn("_tap", F.explode(F.sequence(F.lit(1 - reach), F.lit(reach)))).withColumn(
        "_at", F.floor(centre) + F.col("_tap")
    )
    t = F.abs(centre - F.col("_at"))
    if method == "LINEAR":
        weight = 1.0 - t
    else:
        near = ((CUBIC_A + 2) * t - (CUBIC_A + 3)) * t * t + 1
        far = ((CUBIC_A * t - 5 * CUBIC_A) * t + 8 * CUBIC_A) * t - 4 * CUBIC_A
        weight = F.when(t <= 1, near).otherwise(far)
    source = F.least(F.greatest(F.col("_at"), F.lit(0)), F.lit(size - 1)).cast("int")
    return taps.select(source.alias(name), f"out_{name}", weight.alias(f"w_{name}"))


def downsample(df: DataFrame, rows: int, cols: int, factor: float, method: str = "NEAREST", value: str = "v",
               keys: Sequence[str] = ()) -> DataFrame:
    """Resizes to int(rows / factor) x int(cols / factor).

    The weights of an axis are a table of one scene side; joining it drops every source line that
    feeds nothing before the weighted sums are taken.
    """
    if method not in DOWNSAMPLERS:
        raise ValueError(f"method must be one of {DOWNSAMPLERS}")
    spark = df.sparkSession
    by_row = axis_weights(spark, rows, int(rows / factor), method, "row")
    by_col = axis_weights(spark, cols, int(cols / factor), method, "col")
    fed = df.select(*keys, "row", "col", F.col(value).cast("double").alias("_v")).join(by_row, "row").join(by_col, "col")
    if method == "NEAREST":
        return fed.select(*keys, F.col("out_row").alias("row"), F.col("out_col").alias("col"), F.col("_v").alias(value))
    return fed.groupBy(*keys, F.col("out_row").alias("row"), F.col("out_col").alias("col")).agg(
        F.sum(F.col("_v") * F.col("w_row") * F.col("w_col")).alias(value)
    )

"""Thinning, branch pruning and the main skeleton."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.operators.components import connected_components, keep_largest_components
from cubeloom.operators.tiles import TILE, tile_apply, tile_array
from cubeloom.session import cut_lineage

# Neighbour offsets clockwise from north.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def neighbour_ring(a: np.ndarray) -> list[np.ndarray]:
    """The eight shifted copies of a padded array's interior, clockwise from north."""
    h, w = a.shape[0] - 2, a.shape[1] - 2
    return [a[1 + dr: 1 + dr + h, 1 + dc: 1 + dc + w] for dr, dc in RING]


def thin_once(image: np.ndarray) -> np.ndarray:
    """One two-pass thinning iteration of a boolean array (outside is background)."""
    for first in (True, False):
        n, ne, e, se, s, sw, w, nw = neighbour_ring(np.pad(image, 1).astype(np.int8))
        ring = [n, ne, e, se, s, sw, w, nw]
        count = sum(ring)
        rises = sum((ring[i] == 0) & (ring[(i + 1) % 8] == 1) for i in range(8))
        if first:
            open_side = (n * e * s == 0) & (e * s * w == 0)
        else:
            open_side = (n * e * w == 0) & (n * s * w == 0)
        image = image & ~((count >= 2) & (count <= 6) & (rises == 1) & open_side)
    return image


def _pixel_schema(df: DataFrame, keys: Sequence[str], *extra: T.StructField) -> T.StructType:
    base = [T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType())]
    return T.StructType([df.schema[k] for k in keys] + base + list(extra))


def skeletonize(df: DataFrame, keys: Sequence[str] = (), tile: int = TILE, iterations: int = 16) -> DataFrame:
    """Thins the given foreground pixels to one-pixel lines.

    A pass runs ``iterations`` thinning steps per tile; an iteration looks two pixels far, so a
    halo of twice that many makes the tile result equal to the global one. Passes repeat until
    the pixel count stays the same.
    """
    names = list(keys)
    schema = _pixel_schema(df, keys)

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["_f"] = True
        image, r0, c0 = tile_array(pdf, "_f", False, dtype=bool)
        for _ in range(iterations):
            after = thin_once(image)
            if np.array_equal(after, image):
                break
            image = after
        kept = pdf["core"].to_numpy() & image[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0]
        return pdf.loc[kept, names + ["row", "col"]]

    current = cut_lineage(df.select(*keys, "row", "col"))
    count = current.count()
    while True:
        current = cut_lineage(tile_apply(current, thin, schema, tile, 2 * iterations, keys))
        remaining = current.count()
        if remaining == count:
            return current
        count = remaining


def neighbour_counts(skeleton: DataFrame, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Adds degree: how many of the eight neighbours belong to the skeleton."""
    names = list(keys)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["_f"] = np.int8(1)
        image, r0, c0 = tile_array(pdf, "_f", 0, pad=1)
        degrees = sum(neighbour_ring(image))
        core = pdf[pdf["core"]].copy()
        core["degree"] = degrees[core["row"].to_numpy() - r0 - 1, core["col"].to_numpy() - c0 - 1].astype(np.int32)
        return core[names + ["row", "col", "degree"]]

    schema = _pixel_schema(skeleton, keys, T.StructField("degree", T.IntegerType()))
    return tile_apply(skeleton.select(*keys, "row", "col"), count, schema, tile, 1, keys)


def prune_branches(skeleton: DataFrame, cols: int, min_length: int, keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Removes every path from an end point to its first branch point that is too short.

    Between branch points a skeleton is made of chains, so a path is one connected component of
    the non-branch pixels plus the branch pixel it runs into; that pixel goes with the path.
    """
    on = [*keys, "row", "col"]
    degrees = cut_lineage(neighbour_counts(skeleton, keys, tile))
    chains = connected_components(degrees.filter(F.col("degree") <= 2), cols, 8, keys=keys, tile=tile)
    chains = cut_lineage(chains)
    branch = degrees.filter(F.col("degree") > 2).select(*on)
    offsets = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in RING])
    reach = branch.select(*keys, F.col("row").alias("_br"), F.col("col").alias("_bc"), F.explode(offsets).alias("_o"))
    reach = reach.select(
        *keys, "_br", "_bc", (F.col("_br") + F.col("_o.dr")).alias("row"), (F.col("_bc") + F.col("_o.dc")).alias("col")
    )
    touching = chains.join(reach, on).select(*keys, "label", "_br", "_bc").distinct()
    ends = touching.groupBy(*keys, "label").agg(F.count("*").alias("_ends"))
    paths = chains.groupBy(*keys, "label").agg(
        F.count("*").alias("_size"), F.max((F.col("degree") == 1).cast("int")).alias("_open")
    )
    length = F.col("_size") + F.when(F.col("_ends") > 0, 1).otherwise(0)
    short = paths.join(ends, [*keys, "label"], "left").filter((F.col("_open") == 1) & (length < min_length))
    short = short.select(*keys, "label")
    gone = chains.join(short, [*keys, "label"], "left_semi").select(*on)
    gone_branch = touching.join(short, [*keys, "label"], "left_semi").select(
        *keys, F.col("_br").alias("row"), F.col("_bc").alias("col")
    )
    return degrees.select(*on).join(gone.unionByName(gone_branch), on, "left_anti")


def keep_main_skeleton(df: DataFrame, cols: int, min_length: int = 30, keep: int = 1, keys: Sequence[str] = (),
                       tile: int = TILE) -> DataFrame:
    """Skeleton, pruned, reduced to its largest 8-connected parts."""
    pruned = prune_branches(skeletonize(df, keys, tile), cols, min_length, keys, tile)
    labelled = connected_components(pruned, cols, 8, keys=keys, tile=tile)
    return keep_largest_components(labelled, keep, keys)

"""Connected components: labels inside tiles, then min-label contraction of the links between tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.operators.tiles import TILE, tile_apply, tile_array
from cubeloom.session import cut_lineage


def min_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (u, v)."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        live = a != b
        if not live.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[live], np.minimum(a, b)[live])
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def adjacency(index: np.ndarray, value: np.ndarray, connectivity: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring occupied cells with equal value (index -1 = empty)."""
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])
    us, vs = [], []
    height, width = index.shape
    for dr, dc in steps:
        here = (slice(0, height - dr), slice(max(0, -dc), width - max(0, dc)))
        there = (slice(dr, height), slice(max(0, dc), width + min(0, dc)))
        a, b = index[here], index[there]
        linked = (a >= 0) & (b >= 0) & (value[here] == value[there])
        us.append(a[linked])
        vs.append(b[linked])
    return np.concatenate(us), np.concatenate(vs)


def contract(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """mapping(keys..., node, root): smallest node of each connected set of links (u, v)."""
    links = edges.select(*keys, "u", "v").distinct()
    return _star_contraction(cut_lineage(links), keys)


def _star_contraction(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Alternates large-star and small-star steps until the edges form stars around the minima."""
    k = list(keys)
    edges = links
    signature = None
    while True:
        both = edges.unionByName(edges.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        down = large.select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        floor = down.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = down.join(floor, [*k, "u"]).select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(floor.select(*k, "u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))
        edges = cut_lineage(small.distinct())
        # the rounds stop when neither the number nor the sum of the links changes
        now = edges.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        if signature == tuple(now):
            break
        signature = tuple(now)
    roots = edges.select(*k, F.col("u").alias("node"), F.col("v").alias("root"))
    selves = edges.select(*k, F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(selves)


def connected_components(
    df: DataFrame,
    cols: int,
    connectivity: int = 4,
    value: str | None = None,
    keys: Sequence[str] = (),
    tile: int = TILE,
    out: str = "label",
) -> DataFrame:
    """Adds label (``out``) = smallest flat index of the component to every given (foreground) pixel.

    With ``value`` only equal neighbours connect. Each tile labels its pixels and one ring around
    it; a ring pixel carries two labels, and those pairs are the links contracted afterwards.
    """
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    names = list(keys)
    slim = df.select(*keys, "row", "col", (F.col(value) if value else F.lit(0)).cast("double").alias("_v"))
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()),
            T.StructField("local", T.LongType()), T.StructField("core", T.BooleanType()),
        ]
    )

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"], ignore_index=True)
        pdf["_i"] = np.arange(len(pdf))
        index, r0, c0 = tile_array(pdf, "_i", -1)
        values, _, _ = tile_array(pdf, "_v", np.nan)
        u, v = adjacency(index, values, connectivity)
        root = min_labels(len(pdf), u, v)
        flat = pdf["row"].to_numpy().astype(np.int64) * cols + pdf["col"].to_numpy()
        pdf["local"] = flat[root]
        r, c = pdf["row"] - pdf["tile_row"] * tile, pdf["col"] - pdf["tile_col"] * tile
        rim = (r <= 0) | (c <= 0) | (r >= tile - 1) | (c >= tile - 1)
        keep = pdf["core"] | rim
        return pdf.loc[keep, names + ["row", "col", "local", "core"]]

    local = cut_lineage(tile_apply(slim, label, schema, tile, 1, keys))
    own = local.filter("core").select(*keys, "row", "col", "local")
    other = local.filter("NOT core").select(*keys, "row", "col", F.col("local").alias("v"))
    links = own.select(*keys, "row", "col", F.col("local").alias("u")).join(other, [*keys, "row", "col"])
    links = links.filter(F.col("u") != F.col("v")).select(*keys, "u", "v")
    mapping = contract(links, keys)
    labelled = own.join(mapping.withColumnRenamed("node", "local"), [*keys, "local"], "left").select(
        *keys, "row", "col", F.coalesce("root", "local").alias(out)
    )
    return df.join(labelled, [*keys, "row", "col"])


def component_sizes(labelled: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return labelled.groupBy(*keys, "label").agg(F.count("*").alias("size"))


def remove_small_objects(df: DataFrame, cols: int, area: int, value: str = "bin", connectivity: int = 4,
                         keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Clears foreground components with fewer than ``area`` pixels of a dense 0 / 1 grid."""
    return _flip_small(df, cols, area, value, 1, connectivity, keys, tile)


def remove_small_holes(df: DataFrame, cols: int, area: int, value: str = "bin", connectivity: int = 4,
                       keys: Sequence[str] = (), tile: int = TILE) -> DataFrame:
    """Fills background components with fewer than ``area`` pixels."""
    return _flip_small(df, cols, area, value, 0, connectivity, keys, tile)


def _flip_small(df, cols, area, value, target, connectivity, keys, tile) -> DataFrame:
    side = df.filter((F.col(value) > 0) == bool(target)).select(*keys, "row", "col")
    labelled = connected_components(side, cols, connectivity, keys=keys, tile=tile)
    small = component_sizes(labelled, keys).filter(F.col("size") < area).select(*keys, "label")
    drop = labelled.join(small, [*keys, "label"]).select(*keys, "row", "col", F.lit(True).alias("_flip"))
    joined = df.join(drop, [*keys, "row", "col"], "left")
    flipped = F.when(F.col("_flip"), F.lit(1 - target).cast(df.schema[value].dataType)).otherwise(F.col(value))
    return joined.withColumn(value, flipped).drop("_flip")


def keep_largest_components(labelled: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels of the n largest components; equal sizes go by the smaller label."""
    from cubeloom.operators.ranking import top_per_group

    sizes = component_sizes(labelled, keys)
    if keys:
        top = top_per_group(sizes, keys, [F.col("size").desc(), F.col("label")], n).select(*keys, "label")
    else:
        top = sizes.orderBy(F.col("size").desc(), "label").limit(n).select("label")
    return labelled.join(top, [*keys, "label"], "left_semi")

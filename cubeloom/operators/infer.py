"""Applying a user's batch function to patches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.functions import geo
from cubeloom.operators.reduce import DOUBLES, map_vectors
from cubeloom.operators.tiles import block_cubes

BatchModel = Callable[[np.ndarray], np.ndarray]


def predict_patches(
    pixels: DataFrame, model: BatchModel, p: int, rows: int, cols: int, keys: Sequence[str] = ("scene_id",),
    tile: int = 64, batch: int = 512, vector: str = "spectrum",
) -> DataFrame:
    """class_map(keys..., row, col, label): argmax of ``model`` on the p x p patch of every valid pixel.

    The model maps (n, bands, p, p) - or (n, bands) for p = 1 - to (n, classes). Patches are cut
    from halo tiles, so a pixel travels once per tile that needs it, not once per patch.
    """
    names = list(keys)
    background = pixels.filter("NOT valid").select(*keys, "row", "col", F.lit(-1).alias("label"))
    if p == 1:
        scored = map_vectors(
            pixels.filter("valid").select(*keys, "row", "col", vector), vector, "label",
            lambda x: np.concatenate([model(x[i: i + batch]).argmax(axis=1) for i in range(0, len(x), batch)]).astype(np.int32),
            T.IntegerType(),
        )
        return scored.drop(vector).unionByName(background)
    before, after = geo.patch_radius(p)
    schema = T.StructType(
        [pixels.schema[k] for k in keys]
        + [T.StructField(c, T.IntegerType()) for c in ("row", "col", "label")]
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        core = pdf[pdf["core"] & pdf["valid"]]
        if core.empty:
            return pd.DataFrame({c: [] for c in schema.names})
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        r0, c0 = core["row"].min() - before, core["col"].min() - before
        height = core["row"].max() + after + 1 - r0
        width = core["col"].max() + after + 1 - c0
        block = np.zeros((x.shape[1], height, width))
        seen = (r >= r0) & (r < r0 + height) & (c >= c0) & (c < c0 + width)
        block[:, r[seen] - r0, c[seen] - c0] = x[seen].T
        windows = np.lib.stride_tricks.sliding_window_view(block, (p, p), axis=(1, 2))
        i, j = core["row"].to_numpy() - before - r0, core["col"].to_numpy() - before - c0
        labels = [
            model(np.ascontiguousarray(windows[:, i[s: s + batch], j[s: s + batch]].swapaxes(0, 1))).argmax(axis=1)
            for s in range(0, len(i), batch)
        ]
        out = core[names + ["row", "col"]].copy()
        out["label"] = np.concatenate(labels).astype(np.int32)
        return out

    tiles = block_cubes(pixels, tile, p, keys, rows, cols, vector)
    return tiles.groupBy(*keys, "tile_row", "tile_col").applyInPandas(run, schema).unionByName(background)


def embed_patches(patches: DataFrame, encoder: BatchModel, p: int, cube: str = "cube", out: str = "v", batch: int = 512) -> DataFrame:
    """Adds v: the encoder's vector for every patch row."""

    def encode(x: np.ndarray) -> np.ndarray:
        shaped = x if p == 1 else x.reshape(len(x), -1, p, p)
        return np.concatenate([encoder(shaped[i: i + batch]) for i in range(0, len(x), batch)])

    return map_vectors(patches, cube, out, encode, DOUBLES)


def assemble_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """Block results as one table keyed by (row, col); no dense buffer."""
    from functools import reduce

    return reduce(DataFrame.unionByName, blocks)

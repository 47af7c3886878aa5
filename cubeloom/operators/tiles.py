"""Tiles with a halo: the unit of work of every spatial operator.

A pixel is copied to each tile whose halo contains it, so one shuffle on the tile key brings a
neighbourhood together. A tile holds at most (tile + halo)^2 pixels whatever the scene's size.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from cubeloom.functions import geo

TILE = 256


def tile_assign(df: DataFrame, block: int | tuple[int, int], rows: int, cols: int) -> DataFrame:
    """Adds the block position and the block's clipped extent."""
    height, width = geo.block_shape(block)
    br, bc = geo.tile_of(F.col("row"), height), geo.tile_of(F.col("col"), width)
    return df.withColumns(
        {
            "block_row": br,
            "block_col": bc,
            "block_rows": F.least(F.lit(height), F.lit(rows) - br * height).cast("int"),
            "block_cols": F.least(F.lit(width), F.lit(cols) - bc * width).cast("int"),
        }
    )


def halo_tiles(
    df: DataFrame,
    tile: int = TILE,
    before: int = 1,
    after: int = 1,
    rows: int | None = None,
    cols: int | None = None,
) -> DataFrame:
    """Copies of each pixel in every tile whose halo contains it: adds tile_row, tile_col, core."""

    def owners(position: str, length: int | None):
        low = F.greatest(F.floor((F.col(position) - after) / tile), F.lit(0))
        high = F.floor((F.col(position) + before) / tile)
        if length is not None:
            high = F.least(high, F.lit((length - 1) // tile))
        return F.explode(F.sequence(low.cast("int"), F.greatest(low, high).cast("int")))

    copies = df.withColumn("tile_row", owners("row", rows)).withColumn("tile_col", owners("col", cols))
    core = (F.floor(F.col("row") / tile) == F.col("tile_row")) & (F.floor(F.col("col") / tile) == F.col("tile_col"))
    return copies.withColumn("core", core)


def by_tile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Hash-partitions halo tiles; the windows of :func:`line_windows` then need no further shuffle."""
    return df.repartition(*[F.col(c) for c in (*keys, "tile_row", "tile_col")])


def line_windows(keys: Sequence[str] = ()) -> tuple[WindowSpec, WindowSpec]:
    """Windows along a row and along a column inside each tile."""
    along_row = Window.partitionBy(*keys, "tile_row", "tile_col", "row").orderBy("col")
    along_col = Window.partitionBy(*keys, "tile_row", "tile_col", "col").orderBy("row")
    return along_row, along_col


def tile_apply(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    tile: int = TILE,
    halo: int = 1,
    keys: Sequence[str] = (),
    before: int | None = None,
    after: int | None = None,
    rows: int | None = None,
    cols: int | None = None,
) -> DataFrame:
    """Runs ``function`` on the pixels of each tile and its halo (bounded groups)."""
    copies = halo_tiles(df, tile, halo if before is None else before, halo if after is None else after, rows, cols)
    return copies.groupBy(*keys, "tile_row", "tile_col").applyInPandas(function, schema)


def tile_array(pdf: pd.DataFrame, column: str, fill, pad: int = 0, dtype=None) -> tuple[np.ndarray, int, int]:
    """Dense array of one column over the tile's bounding box, with ``pad`` cells around it."""
    r0, c0 = int(pdf["row"].min()) - pad, int(pdf["col"].min()) - pad
    height = int(pdf["row"].max()) - r0 + 1 + pad
    width = int(pdf["col"].max()) - c0 + 1 + pad
    values = pdf[column].to_numpy()
    out = np.full((height, width), fill, dtype=dtype or values.dtype)
    out[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = values
    return out, r0, c0


def block_cubes(
    df: DataFrame, tile: int, p: int, keys: Sequence[str], rows: int, cols: int, vector: str = "spectrum"
) -> DataFrame:
    """Block iterator as a table: halo tiles for p-wide patches (p - 1 extra pixels)."""
    before, after = geo.patch_radius(p)
    return halo_tiles(df.select(*keys, "row", "col", vector, "valid"), tile, before, after, rows, cols)

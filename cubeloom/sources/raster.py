"""Raster sinks: dense grids, palettes and point layers per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import color
from cubeloom.sources.scene import Scene, check_dtype


def dense_grid(
    sparse: DataFrame, rows: int, cols: int, nodata: float, value: str = "label", mask: DataFrame | None = None
) -> DataFrame:
    """(row, col, value) for every cell; absent cells and cells outside ``mask`` become nodata."""
    kind = sparse.schema[value].dataType
    cells = sparse.sparkSession.range(rows * cols).select(
        F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col")
    )
    grid = cells.join(sparse.select("row", "col", value), ["row", "col"], "left")
    shown = F.col(value)
    if mask is not None:
        grid = grid.join(mask.select("row", "col", F.lit(True).alias("_in")), ["row", "col"], "left")
        shown = F.when(F.col("_in"), shown)
    return grid.select("row", "col", F.coalesce(shown, F.lit(nodata).cast(kind)).alias(value))


def scaled_geotransform(gt: Sequence[float], factor: float) -> list[float]:
    """Geotransform of a grid downsampled by ``factor``."""
    out = [float(g) for g in gt]
    out[1] *= factor
    out[5] *= factor
    return out


def sink_raster(
    grid: DataFrame, path: str, scene: Scene, dtype: str, value: str = "label", factor: float | None = None,
    mode: str = "errorifexists",
) -> None:
    """Writes a grid in row order as Parquet with its header beside it."""
    check_dtype(dtype)
    gt = scaled_geotransform(scene.gt, factor) if factor else list(scene.gt)
    header = Scene(scene.scene_id, scene.rows, scene.cols, 1, gt, scene.srs, scene.nodata, dtype)
    grid.repartitionByRange("row").sortWithinPartitions("row", "col").write.mode(mode).option(
        "compression", "zstd"
    ).parquet(f"{path}/grid")
    header.table(grid.sparkSession).coalesce(1).write.mode(mode).parquet(f"{path}/header")


def sink_palette_raster(
    class_map: DataFrame, path: str, scene: Scene, colours: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    """Class map with nodata 0 and its colour table."""
    sink_raster(class_map, path, scene, "uint8", mode=mode)
    palette = color.palette_table(class_map.sparkSession, colours or color.MINERAL_PALETTE, background=False)
    palette.coalesce(1).write.mode(mode).parquet(f"{path}/palette")


def read_raster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(grid, header) of :func:`sink_raster`."""
    return spark.read.parquet(f"{path}/grid"), spark.read.parquet(f"{path}/header")


def sink_points_by_class(points: DataFrame, path: str, label: str = "class", mode: str = "errorifexists") -> None:
    """One sub-folder per class. Files follow the input partitions, so a large class stays split."""
    points.write.mode(mode).partitionBy(label).parquet(path)

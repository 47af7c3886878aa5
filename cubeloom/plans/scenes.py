"""Several scenes of one width in one pass: scenes are stacked with a gap, outlined together and told apart again.

Scene k takes the rows from k * height on, where height is that of the tallest scene and a gap that no
neighbourhood bridges. Row and column numbers, ids and coordinates of the results are those of the own scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import geo
from cubeloom.operators import vectorize

GAP = 8


def places(scenes: DataFrame, gap: int = GAP) -> tuple[DataFrame, int]:
    """(places(scene_id, place), height) of scenes(scene_id, rows): one row per scene."""
    tallest = scenes.agg(F.max("rows")).first()[0] or 0
    numbered = scenes.select("scene_id", (F.row_number().over(Window.orderBy("scene_id")) - 1).cast("long").alias("place"))
    return numbered, tallest + gap


def stack(df: DataFrame, where: DataFrame, height: int) -> DataFrame:
    """Rows moved to the scene's place; scene_id is dropped."""
    moved = (F.col("row") + F.col("place") * height).cast("int")
    return df.join(where, "scene_id").withColumn("row", moved).drop("scene_id", "place")


def _own(df: DataFrame, where: DataFrame, place: Column) -> DataFrame:
    return df.withColumn("place", place.cast("long")).join(where, "place")


def polygonize_scenes(
    classes: DataFrame, scenes: DataFrame, cols: int, gt: geo.GeoTransform, gap: int = GAP, **kw
) -> tuple[DataFrame, DataFrame]:
    """:func:`vectorize.polygonize` of classes(scene_id, row, col, label); regions and rings carry scene_id."""
    where, height = places(scenes, gap)
    regions, rings = vectorize.polygonize(stack(classes, where, height), cols, gt, **kw)
    cells = height * cols
    place = F.floor(F.col("region") / cells)
    own = F.col("region") - F.col("place") * cells
    regions = _own(regions, where, place).withColumn("region", own).drop("place")
    rings = _own(rings, where, place).withColumns(
        {
            "region": own,
            "ring": F.col("ring") - F.col("place") * cells * 4,
            "y": F.col("y") - F.col("place") * height * F.lit(float(gt[5])),
        }
    )
    return regions, rings.drop("place")


def lines_of_scenes(skeleton: DataFrame, scenes: DataFrame, cols: int, gt: geo.GeoTransform, gap: int = GAP, **kw) -> DataFrame:
    """:func:`vectorize.skeleton_to_lines` of skeleton(scene_id, row, col); lines carry scene_id."""
    where, height = places(scenes, gap)
    lines = vectorize.skeleton_to_lines(stack(skeleton, where, height), cols, gt, **kw)
    lines = _own(lines, where, F.floor(F.col("row") / height))
    return lines.withColumns(
        {
            "id": F.col("id") - F.col("place") * height * cols * 8,
            "row": (F.col("row") - F.col("place") * height).cast("int"),
            "y": F.col("y") - F.col("place") * height * F.lit(float(gt[5])),
        }
    ).drop("place")

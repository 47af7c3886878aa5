"""Clean-up chain of extracted structures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators import components, stencil
from cubeloom.session import cut_lineage

# Default area thresholds and kernel of the chain.
SMALL_AREA = 100_000
KERNEL = 5


def batch_clean(grid: DataFrame, rows: int, cols: int, top=0, bottom=0, left=0, right=0, small_object: int = SMALL_AREA,
                small_hole: int = SMALL_AREA, value: str = "bin") -> DataFrame:
    """Frame -> small objects -> small holes -> erode -> small objects -> dilate."""
    framed = stencil.edge_mask(grid, rows, cols, top, bottom, left, right, value)
    binary = framed.select("row", "col", (F.col(value) > 0).cast("int").alias(value))
    step = components.remove_small_objects(binary, cols, small_object, value)
    step = cut_lineage(components.remove_small_holes(step, cols, small_hole, value))
    step = cut_lineage(stencil.erode(step, value, KERNEL))
    step = components.remove_small_objects(step, cols, small_object, value)
    return stencil.dilate(step, value, KERNEL)


def canny_edge(grid: DataFrame, cols: int, low: int = 50, high: int = 100, value: str = "v") -> DataFrame:
    """Edge pixels: weak candidates stay when 8-connected to a strong one."""
    candidates = cut_lineage(stencil.canny_candidates(grid, value, low, high))
    labelled = components.connected_components(candidates, cols, 8)
    strong = labelled.filter("strong").select("label").distinct()
    return labelled.join(strong, "label", "left_semi").select("row", "col", F.lit(255).alias("edge"))

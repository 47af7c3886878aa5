"""Polygon layers against the pixel grid, by scan lines.

An edge is expanded to the pixel rows it crosses and the crossings of one (polygon, row) are
paired into column spans. Work is proportional to outline plus covered area; no pixel is ever
tested against a polygon that does not cover its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions import geo
from cubeloom.functions.vectors import arith_key
from cubeloom.operators.ranking import flag_first


def ring_edges(polygons: DataFrame) -> DataFrame:
    """polygons(fid, class, ring) -> edges(fid, class, x1, y1, x2, y2); open rings are closed."""
    ring = F.col("ring")
    closed = F.concat(ring, F.slice(ring, 1, 1))
    rest = [c for c in polygons.columns if c != "ring"]
    points = polygons.select(*rest, F.explode(F.arrays_zip(ring.alias("a"), F.slice(closed, F.lit(2), F.size(ring)).alias("b"))).alias("e"))
    edges = points.select(
        *rest, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")
    )
    return edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _sequence(start: Column, stop: Column) -> Column:
    return F.when(start <= stop, F.sequence(start.cast("int"), stop.cast("int")))


def interior_spans(edges: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, ident: Sequence[str] = ("fid",)) -> DataFrame:
    """spans(ident..., row, c0, c1): columns whose centre lies inside (even-odd rule)."""
    r1 = (F.col("y1") - float(gt[3])) / float(gt[5]) - 0.5
    r2 = (F.col("y2") - float(gt[3])) / float(gt[5]) - 0.5
    lo, hi = F.least(r1, r2), F.greatest(r1, r2)
    if gt[5] < 0:
        first, last = F.floor(lo) + 1, F.floor(hi)
    else:
        first, last = F.ceil(lo), F.ceil(hi) - 1
    crossed = edges.withColumn(
        "row", F.explode(_sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(rows - 1))))
    )
    yc = F.lit(float(gt[3])) + (F.col("row") + 0.5) * float(gt[5])
    x_cross = F.col("x1") + (yc - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    across = (x_cross - float(gt[0])) / float(gt[1]) - 0.5
    line = Window.partitionBy(*ident, "row").orderBy("_x")
    paired = (
        crossed.select(*ident, "row", across.alias("_x"))
        .withColumn("_rn", F.row_number().over(line))
        .withColumn("_next", F.lead("_x").over(line))
        .filter((F.col("_rn") % 2 == 1) & F.col("_next").isNotNull())
    )
    c0 = F.greatest(F.ceil("_x"), F.lit(0)).cast("int")
    c1 = F.least(F.ceil("_next") - 1, F.lit(cols - 1)).cast("int")
    return paired.select(*ident, "row", c0.alias("c0"), c1.alias("c1")).filter(F.col("c0") <= F.col("c1"))


def outline_spans(edges: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, ident: Sequence[str] = ("fid",)) -> DataFrame:
    """spans(ident..., row, c0, c1): columns whose cell an edge touches."""
    a = (F.col("y1") - float(gt[3])) / float(gt[5])
    b = (F.col("y2") - float(gt[3])) / float(gt[5])
    u = (F.col("x1") - float(gt[0])) / float(gt[1])
    v = (F.col("x2") - float(gt[0])) / float(gt[1])
    grid = edges.select(*ident, a.alias("_a"), b.alias("_b"), u.alias("_u"), v.alias("_v"))
    lo, hi = F.least("_a", "_b"), F.greatest("_a", "_b")
    cells = grid.withColumn(
        "row",
        F.explode(_sequence(F.greatest(F.floor(lo), F.lit(0)), F.least(F.floor(hi), F.lit(rows - 1)))),
    )
    # the part of the edge inside the row strip, in units of columns
    top, bottom = F.greatest(lo, F.col("row").cast("double")), F.least(hi, F.col("row") + 1.0)

    def at(y: Column) -> Column:
        return F.col("_u") + (y - F.col("_a")) * (F.col("_v") - F.col("_u")) / (F.col("_b") - F.col("_a"))

    flat = F.col("_a") == F.col("_b")
    x_top = F.when(flat, F.col("_u")).otherwise(at(top))
    x_bottom = F.when(flat, F.col("_v")).otherwise(at(bottom))
    c0 = F.greatest(F.floor(F.least(x_top, x_bottom)), F.lit(0)).cast("int")
    c1 = F.least(F.floor(F.greatest(x_top, x_bottom)), F.lit(cols - 1)).cast("int")
    return cells.select(*ident, "row", c0.alias("c0"), c1.alias("c1")).filter(F.col("c0") <= F.col("c1"))


def span_cells(spans: DataFrame) -> DataFrame:
    """Spans -> one row per covered pixel."""
    rest = [c for c in spans.columns if c not in ("c0", "c1")]
    return spans.select(*rest, F.explode(F.sequence("c0", "c1")).alias("col"))


def polygon_to_mask(
    edges: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, fill: int = 255, keys: Sequence[str] = ()
) -> DataFrame:
    """labels_grid(keys..., row, col, label): the constant inside any polygon; absent pixels are outside."""
    cells = span_cells(interior_spans(edges, gt, rows, cols, [*keys, "fid"]))
    return cells.select(*keys, "row", "col").distinct().withColumn("label", F.lit(fill))


def polygon_class_mask(
    edges: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, class_column: str = "class", keys: Sequence[str] = ()
) -> DataFrame:
    """class_map(keys..., row, col, label): class of every touched pixel, the last polygon wins; absent = -1."""
    if class_column not in edges.columns:
        raise ValueError(f"the polygon layer has no field {class_column!r}")
    if dict(edges.dtypes)[class_column] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"field {class_column!r} must be an integer")
    ident = [*keys, "fid", class_column]
    touched = interior_spans(edges, gt, rows, cols, ident).unionByName(outline_spans(edges, gt, rows, cols, ident))
    return span_cells(touched).groupBy(*keys, "row", "col").agg(F.max_by(class_column, "fid").cast("int").alias("label"))


def polygon_clip(pixels: DataFrame, mask: DataFrame, nodata: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Raw spectra inside the mask, nodata outside."""
    marked = mask.select(*keys, "row", "col", F.lit(True).alias("_in"))
    blank = F.transform("spectrum", lambda _: F.lit(nodata))
    joined = pixels.join(marked, [*keys, "row", "col"], "left")
    return joined.withColumn("spectrum", F.when(F.col("_in"), F.col("spectrum")).otherwise(blank)).withColumn(
        "inside", F.coalesce(F.col("_in"), F.lit(False))
    ).drop("_in")


def polygon_positions(mask: DataFrame, cols: int, sample_num: int | None = None, seed: int = 42) -> DataFrame:
    """Pixels of a polygon mask: all of them, or ``sample_num`` drawn by a seeded key."""
    if sample_num is None:
        return mask.withColumn("pix", geo.flat_index(F.col("row"), F.col("col"), cols))
    index = geo.flat_index(F.col("row"), F.col("col"), cols)
    flagged = flag_first(mask.withColumn("pix", index), [], arith_key(F.col("pix"), seed), F.col("pix"), sample_num)
    return flagged.filter("selected").drop("selected")

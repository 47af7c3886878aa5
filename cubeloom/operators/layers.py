"""Point layers: locating, joining with pixels, label grids, splits and merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.functions import geo
from cubeloom.functions.vectors import arith_key
from cubeloom.operators.ranking import flag_first, number_rows
from cubeloom.sources.files import modified_times


def locate_points(points: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, keep_outside: bool = False) -> DataFrame:
    """Adds row and col of each point; points outside the scene are dropped unless kept."""
    located = points.withColumn("row", geo.geo_row(F.col("y"), gt)).withColumn("col", geo.geo_col(F.col("x"), gt))
    return located if keep_outside else located.filter(geo.inside(F.col("row"), F.col("col"), rows, cols))


def points_to_spectra(located: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Spectrum under each point: an equi-join on the pixel key, no side forced to broadcast."""
    cells = pixels.select(*keys, "row", "col", "spectrum")
    return located.join(cells, [*keys, "row", "col"])


def points_to_mask(
    located: DataFrame, value: int | None = None, keys: Sequence[str] = ("scene_id",), class_column: str | None = "class"
) -> DataFrame:
    """labels_grid(keys..., row, col, label): class + 1, a fixed value, or 1; the last feature of a pixel wins."""
    if value is not None:
        label: Column = F.lit(value)
    elif class_column is not None and class_column in located.columns:
        label = F.col(class_column) + 1
    else:
        label = F.lit(1)
    return located.groupBy(*keys, "row", "col").agg(F.max_by(label, F.col("fid")).cast("int").alias("label"))


def layer_index(points: DataFrame, name: str = "layer_idx") -> DataFrame:
    """Adds the 0-based position of each layer in name order (one row per layer is numbered)."""
    layers = points.select("layer").distinct()
    numbered = layers.withColumn(name, (F.row_number().over(Window.orderBy("layer")) - 1).cast("int"))
    return points.join(numbered, "layer")


def overlap_check(located: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Pixels claimed by more than one layer (partial min / max per pixel, not a self-join)."""
    span = located.groupBy(*keys, "row", "col").agg(F.min("layer").alias("first_layer"), F.max("layer").alias("last_layer"))
    return span.filter(F.col("first_layer") != F.col("last_layer"))


def layers_to_mask(
    located: DataFrame, keys: Sequence[str] = ("scene_id",), on_overlap: str = "raise"
) -> DataFrame:
    """One label grid from many layers, label = layer index + 1.

    A pixel claimed by two layers is an error, raised when the result is computed;
    ``on_overlap="first"`` keeps the lowest label instead.
    """
    indexed = layer_index(located)
    grid = indexed.groupBy(*keys, "row", "col").agg(F.min("layer_idx").alias("_lo"), F.max("layer_idx").alias("_hi"))
    label = (F.col("_lo") + 1).cast("int")
    if on_overlap == "raise":
        clash = F.raise_error(F.lit("sample points of different layers overlap")).cast("int")
        label = F.when(F.col("_lo") == F.col("_hi"), label).otherwise(clash)
    elif on_overlap != "first":
        raise ValueError("on_overlap is 'raise' or 'first'")
    return grid.select(*keys, "row", "col", label.alias("label"))


def mask_to_training(labels: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """(row, col, spectrum, class) of every labelled pixel; stored label k + 1 becomes class k."""
    marked = labels.filter(F.col("label") != 0).select(*keys, "row", "col", (F.col("label") - 1).cast("int").alias("class"))
    return marked.join(pixels.select(*keys, "row", "col", "spectrum"), [*keys, "row", "col"])


def labels_to_points(labels: DataFrame, gt: geo.GeoTransform) -> DataFrame:
    """Points at the origin corner of every labelled pixel, carrying the class."""
    row, col = F.col("row"), F.col("col")
    return labels.filter(F.col("label") > 0).select(
        "*",
        geo.pixel_x(row, col, gt).alias("x"),
        geo.pixel_y(row, col, gt).alias("y"),
        (F.col("label") - 1).cast("int").alias("class"),
    )


def merge_class_values(df: DataFrame, values: Sequence[int], column: str = "class") -> DataFrame:
    """Recodes every listed class to the first one."""
    base, rest = values[0], list(values[1:])
    return df.withColumn(column, F.when(F.col(column).isin(rest), F.lit(base)).otherwise(F.col(column)))


def embed_index(points: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, groups: Sequence[str] = ()) -> DataFrame:
    """Adds emb_idx: 1..n for points inside the scene in feature order, 0 outside."""
    located = locate_points(points, gt, rows, cols, keep_outside=True)
    within = geo.inside(F.col("row"), F.col("col"), rows, cols)
    numbers = number_rows(located.filter(within).select(*groups, "fid"), "fid", "emb_idx", groups)
    joined = located.join(numbers, [*groups, "fid"], "left")
    return joined.withColumn("emb_idx", F.coalesce(F.col("emb_idx"), F.lit(0).cast("long")))


def embed_join(points: DataFrame, features: DataFrame) -> DataFrame:
    """Feature vector of each indexed point; both sides carry the 1-based emb_idx."""
    return points.filter(F.col("emb_idx") > 0).join(features.select("emb_idx", "v"), "emb_idx")


def valid_features(points: DataFrame, gt: geo.GeoTransform, rows: int, cols: int) -> DataFrame:
    """Points with a positive emb_idx, else those inside the closed scene box."""
    x0, x1 = float(gt[0]), float(gt[0] + gt[1] * cols)
    y1, y0 = float(gt[3]), float(gt[3] + gt[5] * rows)
    boxed = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    if "emb_idx" not in points.columns:
        return points.filter(boxed)
    return points.filter(F.coalesce(F.col("emb_idx") > 0, F.lit(False)) | boxed)


def merge_layers(layers: Sequence[tuple[int, str, DataFrame]], columns: Sequence[str]) -> DataFrame:
    """Concatenates (time, name, rows) layers, oldest first, under the oldest one's name.

    All layers need the same number of columns; values are matched by position. The inputs stay.
    """
    ordered = sorted(layers, key=lambda item: (item[0], item[1]))
    width = len(ordered[0][2].columns)
    if any(len(df.columns) != width for _, _, df in ordered):
        raise ValueError("layers to merge need the same number of fields")
    parts = [
        df.toDF(*columns).withColumn("source_layer", F.lit(name)).withColumn("layer_order", F.lit(i))
        for i, (_, name, df) in enumerate(ordered)
    ]
    return reduce(DataFrame.unionByName, parts).withColumn("merged_layer", F.lit(ordered[0][1]))


def merge_layer_files(spark: SparkSession, folders: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Merges Parquet layers given as name -> folder in the order in which they were written; equal times go by name."""
    times = modified_times(spark, folders)
    return merge_layers([(times[name], name, spark.read.parquet(path)) for name, path in folders.items()], columns)


def split_count(wanted: float, total: Column, strict: bool = True) -> Column:
    """Rows to take: a share below 1, a count otherwise; more than there are is an error."""
    if wanted < 1:
        return F.floor(total * F.lit(float(wanted)))
    if not strict:
        return F.least(F.lit(int(wanted)), total)
    too_many = F.raise_error(F.lit("more features asked for than the layer has")).cast("long")
    return F.when(total < wanted, too_many).otherwise(F.lit(int(wanted)).cast("long"))


def random_split_layer(points: DataFrame, wanted: float, seed: int = 42, groups: Sequence[str] = ("layer",)) -> DataFrame:
    """Adds selected: n or a share of each layer's points, drawn by a seeded key."""
    quota = split_count(wanted, F.col("group_rows"))
    return flag_first(points, groups, arith_key(F.col("fid"), seed), F.col("fid"), quota)


def split_complement(points: DataFrame, taken: DataFrame, on: Sequence[str] = ("fid",)) -> DataFrame:
    """The rest of a split."""
    return points.join(taken.select(*on), list(on), "left_anti")


def stratified_split(
    samples: DataFrame, ratio: float, ident: str, seed: int = 42, label: str = "label"
) -> DataFrame:
    """Adds is_train: the first int(n * ratio) rows of each class in seeded key order."""
    quota = F.floor(F.col("group_rows") * F.lit(float(ratio)))
    return flag_first(samples, [label], arith_key(F.col(ident), seed), F.col(ident), quota, flag="is_train")


def train_test_from_layers(
    train: DataFrame, test: DataFrame, pixels: DataFrame, keys: Sequence[str] = ("scene_id",), on_overlap: str = "raise"
) -> DataFrame:
    """(part, row, col, class, spectrum) of two located layer sets."""
    parts = []
    for name, located in (("train", train), ("test", test)):
        grid = layers_to_mask(located, keys, on_overlap)
        parts.append(mask_to_training(grid, pixels, keys).withColumn("part", F.lit(name)))
    return parts[0].unionByName(parts[1])

"""Sample collection chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions import geo
from cubeloom.operators import cluster, layers, patches, reduce, sampling, superpixels
from cubeloom.sources.files import sample_lines


def random_crop(pixels: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, p: int = 17, fraction: float = 0.001,
                seed: int = 42, bands: int | None = None) -> DataFrame:
    """Random pixels -> patches with their map origin, in (row, col) order."""
    mask = sampling.random_sample_mask(pixels, rows, cols, fraction, seed)
    gathered = patches.patch_gather(mask.select("scene_id", "row", "col"), pixels, p, bands=bands)
    return patches.patch_origin(gathered, p, gt)


def sample_crop(points: DataFrame, pixels: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, p: int,
                folder: str = "samples", name: str = "img", bands: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled patches of many layers and their sample list; the label is the layer's position."""
    indexed = layers.layer_index(points)
    gathered = patches.patch_gather_points(indexed, pixels, p, gt, rows, cols, ["fid", "layer_idx"], bands=bands)
    path = F.concat_ws("_", F.lit(f"{folder}/{name}"), F.col("layer_idx"), F.col("fid"))
    listed = gathered.withColumn("path", F.concat(path, F.lit(".tif"))).withColumnRenamed("layer_idx", "label")
    return listed, sample_lines(listed.select("path", "label"))


def superpixel_sampling(pixels: DataFrame, rows: int, cols: int, max_samples: int = 30, n_segments: int = 512,
                        method: str = "MNF", k: int = 12, compactness: float = 25.0, niters: int = 2000,
                        threshold: float = 0.0, seed: int = 0) -> DataFrame:
    """PCA -> superpixels -> enhancement -> purity sampling per superpixel: the chosen pixels."""
    from cubeloom.sources.scene import rgb_compose

    scores = reduce.pca(pixels.filter("valid"), max(k, 3))
    image = rgb_compose(scores, 1, 2, 3, vector="scores", order="bgr")
    colours = image.withColumn("colour", F.array("c1", "c2", "c3"))
    segments = superpixels.slic(colours.select("scene_id", "row", "col", "colour"), "colour", rows, cols, n_segments, compactness)
    enhanced = reduce.enhance(pixels, method, k).select("scene_id", "row", "col", "pix", "scores")
    joined = enhanced.join(segments.select("scene_id", "row", "col", "seg"), ["scene_id", "row", "col"])
    directions = sampling.random_directions(niters, k, seed)
    chosen = sampling.segment_ppi_sampling(joined, directions, max_samples, threshold, "scores")
    return joined.select("scene_id", "row", "col", "pix", "seg").join(chosen.select("pix", "count"), "pix")


def smacc_block_sampling(pixels: DataFrame, rows: int, cols: int, blocks: tuple[int, int] = (3, 3), k: int = 12,
                         samples: int = 4000) -> DataFrame:
    """Endmember pixels of every block of an MNF-reduced scene, shared out by block area."""
    height, width = -(-rows // blocks[0]), -(-cols // blocks[1])
    number = F.floor(F.col("row") / height) * blocks[1] + F.floor(F.col("col") / width)
    shares = {
        i * blocks[1] + j: int(samples * min(height, rows - i * height) * min(width, cols - j * width) / (rows * cols))
        for i in range(-(-rows // height))
        for j in range(-(-cols // width))
    }
    numbered = pixels.select("pix", "row", "col", "spectrum", number.cast("int").alias("block"))
    reduced = reduce.mnf_by_block(numbered, "block", k)
    _, chosen = sampling.smacc(reduced, shares, "scores", block="block")
    return chosen


def cluster_points(features: DataFrame, points: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, k: int,
                   seeds=(42,)) -> DataFrame:
    """Valid points with the cluster of their features."""
    labelled = cluster.gmm_cluster(features, k, seeds=seeds).select("emb_idx", "label")
    return layers.valid_features(points, gt, rows, cols).join(labelled, "emb_idx")


def reduce_points(points: DataFrame, pixels: DataFrame, gt: geo.GeoTransform, rows: int, cols: int, method: str = "PCA",
                  k: int = 24) -> DataFrame:
    """features(emb_idx, v): enhanced spectra of the indexed points."""
    indexed = layers.embed_index(points, gt, rows, cols).filter("emb_idx > 0")
    scores = reduce.enhance(pixels, method, k).select("scene_id", "row", "col", F.col("scores").alias("v"))
    return indexed.join(scores, ["scene_id", "row", "col"]).select("emb_idx", "fid", "v")

"""Augmentation, iterative sampling, clustering, outliers, classifiers and inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6, with_views
from catalog.relational import checks, located, patch_sql
from cubeloom.functions.vectors import vsum
from cubeloom.operators import classify, cluster, components, infer, layers, margins, outlier, patches, reduce, sampling, search, superpixels
from cubeloom.plans import sampling as plans

P = 5


def cubes(spark, d):
    """Patches around the labelled pixels, identified by their flat index."""
    gathered = patches.patch_gather(V.lab(spark, d), V.px(spark, d), P, bands=V.BANDS)
    return gathered.withColumn("id", F.col("row").cast("long") * V.COLS + F.col("col"))


def moved(order: list[int]) -> str:
    """patch_gather SQL whose cells are weighted by their new place."""
    place = {source: k for k, source in enumerate(order)}
    case = "CASE k " + " ".join(f"WHEN {s} THEN {t}" for s, t in sorted(place.items())) + " END"
    return patch_sql("SELECT row, col FROM lab", "row, col", P, "lab").replace("s * (k + 1)", f"s * ({case} + 1)")


@query("augment_flip", moved(patches.flip_order(P, "cols")))
def augment_flip(spark, d):
    return checks(patches.augment_flip(cubes(spark, d), P, "cols"), P, "row", "col")


@query("augment_flip_rows", moved(patches.flip_order(P, "rows")))
def augment_flip_rows(spark, d):
    return checks(patches.augment_flip(cubes(spark, d), P, "rows"), P, "row", "col")


@query("augment_rot90", moved([c * P + (P - 1 - r) for r in range(P) for c in range(P)]))
def augment_rot90(spark, d):
    return checks(patches.augment_rot90(cubes(spark, d), P, 1), P, "row", "col")


def totals(df):
    return checks(df, P, "row", "col")


@query("augment_rotate")
def augment_rotate(spark, d):
    return totals(patches.augment_rotate(cubes(spark, d), "id", P))


@query("augment_noise")
def augment_noise(spark, d):
    return totals(patches.augment_noise(cubes(spark, d), "id", (0.006, 0.012)))


@query("augment_erase")
def augment_erase(spark, d):
    return totals(patches.augment_erase(cubes(spark, d), "id", P))


@query("augment_spectral_mask")
def augment_spectral_mask(spark, d):
    return totals(patches.augment_spectral_mask(cubes(spark, d), "id"))


@query("augment_band_dropout")
def augment_band_dropout(spark, d):
    return totals(patches.augment_band_dropout(cubes(spark, d), "id", P))


@query("augment_chain")
def augment_chain(spark, d):
    return totals(patches.augment_chain(cubes(spark, d), "id", P))


@query("augment_expand", with_views("SELECT CAST(r AS INT) AS round, count(*) AS n, CAST(sum(q.c) AS BIGINT) AS cells FROM range(-1, 47) t(r), (SELECT 25 * 64 AS c FROM lab) q GROUP BY r", "lab"))
def augment_expand(spark, d):
    expanded = patches.augment_expand(cubes(spark, d), "id", P, patches.expand_combinations())
    return expanded.groupBy("round").agg(F.count("*").alias("n"), F.sum(F.size("cube").cast("long")).alias("cells"))


_turns = [c for c in patches.expand_combinations() if c[2] is None]


def _expand_sql() -> str:
    orders = [list(range(P * P))]
    for flip, turn, _ in _turns:
        grid = np.arange(P * P).reshape(P, P)
        grid = grid if flip is None else np.flip(grid, 0 if flip == "rows" else 1)
        orders.append((grid if turn is None else np.rot90(grid, turn)).ravel().tolist())
    rows = ", ".join(f"({i - 1}, {s}, {t})" for i, o in enumerate(orders) for t, s in enumerate(o))
    base = patch_sql("SELECT row, col FROM lab", "round, row, col", P, "lab").replace("s * (k + 1)", "s * (t + 1)")
    return base.replace("LEFT JOIN (SELECT pix", f"JOIN (VALUES {rows}) m(round, src, t) ON m.src = c.k LEFT JOIN (SELECT pix")


@query("augment_expand_turns", _expand_sql())
def augment_expand_turns(spark, d):
    return checks(patches.augment_expand(cubes(spark, d), "id", P, _turns), P, "round", "row", "col")


# --- iterative sampling ---

@query("smacc")
def smacc(spark, d):
    data = V.px(spark, d).filter("valid").select("pix", "spectrum")
    shifted = data.withColumn("spectrum", F.transform("spectrum", lambda x: x + 1.0))
    abundances, _ = sampling.smacc(shifted, 6)
    return abundances.select("pix", "is_endmember", F.posexplode("f").alias("k", "_f")).select("pix", "is_endmember", "k", r6("_f").alias("f"))


@query("smacc_block_sampling")
def smacc_block_sampling(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return plans.smacc_block_sampling(p, rows, cols, (2, 2), 4, 16).select("block", "step", "pix")


@query("slic")
def slic(spark, d):
    p = V.px(spark, d).filter("valid")
    rows, cols = V.dims(p)
    image = reduce.pca(p.select("pix", "row", "col", "spectrum"), 3, out="colour").select("pix", "row", "col", "colour")
    return superpixels.slic(image, "colour", rows, cols, 20, 10.0).select("pix", "seg")


@query("slic_connected", with_views(
    "SELECT count(*) AS n_pixels, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_without FROM px WHERE valid", "px"))
def slic_connected(spark, d):
    """Every valid pixel has a segment and no segment has two pieces."""
    p = V.px(spark, d).filter("valid")
    rows, cols = V.dims(p)
    found = superpixels.slic(p.select("pix", "row", "col", "spectrum"), "spectrum", rows, cols)
    pieces = components.connected_components(found, cols, 4, value="seg", out="piece")
    kinds = pieces.groupBy("seg").agg(F.count("*").alias("n"), F.countDistinct("piece").alias("k"))
    total = kinds.agg(F.sum("n").alias("n_pixels"), F.sum((F.col("k") > 1).cast("long")).alias("n_split"), F.sum(F.col("seg").isNull().cast("long")).alias("n_without"))
    return total


@query("pipeline_superpixel_sampling")
def pipeline_superpixel_sampling(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return plans.superpixel_sampling(p, rows, cols, 5, 16, k=6, niters=100).select("pix", "seg", "count")


# --- clustering and outliers ---

def features(spark, d):
    return V.px(spark, d).select((F.col("pix") + 1).alias("emb_idx"), F.col("spectrum").alias("v"))


@query("gmm_cluster")
def gmm_cluster(spark, d):
    # the chain clusters reduced features: scores of all bands
    scores = reduce.pca(features(spark, d), 8, vector="v")
    return cluster.gmm_cluster(scores.select("emb_idx", F.col("scores").alias("v")), 24, seeds=range(10)).select("emb_idx", "label")


@query("pipeline_cluster")
def pipeline_cluster(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    points = layers.embed_index(V.pts(spark, d), V.GT, rows, cols)
    return plans.cluster_points(features(spark, d), points, V.GT, rows, cols, 3).select("fid", "emb_idx", "label")


def layered(spark, d):
    p = V.px(spark, d).filter("valid")
    return p.select(F.col("pix").alias("fid"), F.concat(F.lit("class_"), F.col("label") % 3).alias("layer"), "spectrum")


@query("isolation_forest")
def isolation_forest(spark, d):
    return outlier.isolation_forest(layered(spark, d), 0.2).select("layer", "fid", r6("score").alias("score"), "flag")


@query("mc_isolation")
def mc_isolation(spark, d):
    return outlier.mc_isolation(layered(spark, d)).select("layer", "fid", r6("score").alias("score"))


@query("clean_samples")
def clean_samples(spark, d):
    return outlier.clean_samples(layered(spark, d), "LF", 0.2).select("layer", "fid", r6("score").alias("score"))


# --- classifiers ---

def training(spark, d):
    p = V.px(spark, d).filter("valid")
    return p.select("pix", (F.col("label") % 3).cast("int").alias("label"), "spectrum")


@query("random_forest")
def random_forest(spark, d):
    data = training(spark, d)
    model = classify.random_forest(data.filter("pix % 4 <> 0"))
    return model.transform(classify.with_features(data)).select("pix", F.col("prediction").cast("int").alias("label"))


@query("svm_classifier")
def svm_classifier(spark, d):
    data = training(spark, d)
    model = classify.svm_classifier(data.filter("pix % 4 <> 0"))
    return model.transform(data).select("pix", F.col("prediction").cast("int").alias("label"))


@query("grid_search")
def grid_search(spark, d):
    """Mean accuracy of every combination of the forest grid and the split sizes."""
    return search.forest_search(training(spark, d), "pix").withColumn("accuracy", r6("accuracy"))


@query("svm_grid_search")
def svm_grid_search(spark, d):
    """Mean accuracy of every combination of the reduced margin grid."""
    found = margins.margin_search(training(spark, d), "pix", grid=classify.SVM_GRID_SMALL)
    return found.withColumn("accuracy", r6("accuracy"))


@query("predict_map")
def predict_map(spark, d):
    model = classify.random_forest(training(spark, d))
    p = V.px(spark, d)
    return classify.predict_map(model, p.drop("label")).select("pix", "row", "col", "label")


# --- user models ---

def band_sums(x: np.ndarray) -> np.ndarray:
    """Example batch model: one score per band, its sum over the patch."""
    return x.sum(axis=(2, 3)) if x.ndim == 4 else x


_argmax = """SELECT row, col, CAST(CASE WHEN valid THEN list_position(t, list_max(t)) - 1 ELSE -1 END AS INT) AS label FROM
 (SELECT a.row, a.col, any_value(a.valid) AS valid, [{sums}] AS t FROM px a JOIN px b ON b.row BETWEEN a.row - {r} AND a.row + {r} AND b.col BETWEEN a.col - {r} AND a.col + {r} GROUP BY a.row, a.col)"""


def _predict(p: int):
    sums = ", ".join(f"sum(b.spectrum[{i}])" for i in range(1, 65))

    @query("predict_patches" if p > 1 else "predict_pixels", with_views(_argmax.format(sums=sums, r=p // 2), "px"))
    def run(spark, d):
        x = V.px(spark, d)
        rows, cols = V.dims(x)
        return infer.predict_patches(x, band_sums, p, rows, cols, tile=16).select("row", "col", "label")


_predict(3)
_predict(1)


@query("embed_patches", with_views(
    "SELECT row, col, CAST(i - 1 AS INT) AS k, round(CASE i WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END, 6) + 0.0 AS v FROM (SELECT c.row, c.col, sum(q.spectrum[1]) AS s1, sum(q.spectrum[2]) AS s2, sum(q.spectrum[3]) AS s3 FROM lab c JOIN px q ON q.row BETWEEN c.row - 2 AND c.row + 2 AND q.col BETWEEN c.col - 2 AND c.col + 2 GROUP BY 1, 2), range(1, 4) t(i)", "lab", "px"))
def embed_patches(spark, d):
    encoded = infer.embed_patches(cubes(spark, d), lambda x: x[:, :3].sum(axis=(2, 3)), P)
    return encoded.select("row", "col", F.posexplode("v").alias("k", "_v")).select("row", "col", "k", r6("_v").alias("v"))


@query("reduce_points")
def reduce_points(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    reduced = plans.reduce_points(V.pts(spark, d), p, V.GT, rows, cols, "PCA", 4)
    return reduced.select("emb_idx", "fid", r6(vsum(F.col("v"))).alias("total"))


@query("clean_points")
def clean_points(spark, d):
    """Outlier removal on the spectra under the points of every layer."""
    spectra = layers.points_to_spectra(located(spark, d), V.px(spark, d))
    return outlier.clean_samples(spectra.select("fid", "layer", "spectrum"), "Mccv_LF", 0.2).select("layer", "fid", r6("score").alias("score"))

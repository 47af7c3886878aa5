"""Joins, splits, set operations, ranking and patches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6, with_views
from cubeloom.functions.vectors import vsum
from cubeloom.operators import infer, layers, patches, polygons, ranking, reduce, sampling, tiles
from cubeloom.operators.cluster import standardize_labels
from cubeloom.operators.quantiles import threshold_flag
from cubeloom.plans import sampling as plans
from cubeloom.session import output_folder


def located(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return layers.locate_points(V.pts(spark, d), V.GT, rows, cols)


@query("points_to_spectra", with_views("SELECT fid, row, col, round(list_sum(spectrum), 6) + 0.0 AS total FROM loc JOIN px USING (row, col)", "loc", "px"))
def points_to_spectra(spark, d):
    joined = layers.points_to_spectra(located(spark, d), V.px(spark, d))
    return joined.select("fid", "row", "col", r6(vsum(F.col("spectrum"))).alias("total"))


@query("mask_to_training", with_views("SELECT row, col, CAST(lab.label - 1 AS INT) AS class, round(list_sum(spectrum), 6) + 0.0 AS total FROM lab JOIN px USING (row, col) WHERE lab.label <> 0", "lab", "px"))
def mask_to_training(spark, d):
    rows = layers.mask_to_training(V.lab(spark, d), V.px(spark, d))
    return rows.select("row", "col", "class", r6(vsum(F.col("spectrum"))).alias("total"))


@query("points_to_mask", with_views("SELECT row, col, CAST(arg_max(class + 1, fid) AS INT) AS label FROM loc GROUP BY row, col", "loc"))
def points_to_mask(spark, d):
    return layers.points_to_mask(located(spark, d)).select("row", "col", "label")


@query("layers_to_mask", with_views("SELECT row, col, CAST(min(i) + 1 AS INT) AS label FROM loc JOIN (SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS i FROM (SELECT DISTINCT layer FROM loc)) USING (layer) GROUP BY row, col", "loc"))
def layers_to_mask(spark, d):
    return layers.layers_to_mask(located(spark, d), on_overlap="first").select("row", "col", "label")


@query("overlap_check", with_views("SELECT row, col, min(layer) AS first_layer, max(layer) AS last_layer FROM loc GROUP BY row, col HAVING count(DISTINCT layer) > 1", "loc"))
def overlap_check(spark, d):
    return layers.overlap_check(located(spark, d)).select("row", "col", "first_layer", "last_layer")


@query("polygon_to_mask", with_views("SELECT DISTINCT row, col, 255 AS label FROM inpoly", "inpoly"))
def polygon_to_mask(spark, d):
    rows, cols = V.grid_dims(V.gridv(spark, d))
    return polygons.polygon_to_mask(polygons.ring_edges(V.polys(spark, d)), V.GT, rows, cols)


_touch = """SELECT g.row, g.col, e.fid, e.class FROM gridv g JOIN edg e ON
 500000 + 30::DOUBLE * g.col <= greatest(x1, x2) AND 500000 + 30::DOUBLE * (g.col + 1) >= least(x1, x2)
 AND 4000000 - 30::DOUBLE * (g.row + 1) <= greatest(y1, y2) AND 4000000 - 30::DOUBLE * g.row >= least(y1, y2)
 WHERE greatest(0, least((500000 + 30::DOUBLE * g.col - x1) / (x2 - x1), (500000 + 30::DOUBLE * (g.col + 1) - x1) / (x2 - x1)),
                least((4000000 - 30::DOUBLE * (g.row + 1) - y1) / (y2 - y1), (4000000 - 30::DOUBLE * g.row - y1) / (y2 - y1)))
    <= least(1, greatest((500000 + 30::DOUBLE * g.col - x1) / (x2 - x1), (500000 + 30::DOUBLE * (g.col + 1) - x1) / (x2 - x1)),
             greatest((4000000 - 30::DOUBLE * (g.row + 1) - y1) / (y2 - y1), (4000000 - 30::DOUBLE * g.row - y1) / (y2 - y1)))"""


@query("polygon_class_mask", with_views(f"SELECT row, col, CAST(arg_max(class, fid) AS INT) AS label FROM (SELECT * FROM inpoly UNION ALL {_touch}) GROUP BY row, col", "inpoly", "edg", "gridv"))
def polygon_class_mask(spark, d):
    rows, cols = V.grid_dims(V.gridv(spark, d))
    return polygons.polygon_class_mask(polygons.ring_edges(V.polys(spark, d)), V.GT, rows, cols)


@query("polygon_clip", with_views("SELECT row, col, m.row IS NOT NULL AS inside, CASE WHEN m.row IS NULL THEN -9999.0 ELSE v END AS v FROM gridv LEFT JOIN (SELECT DISTINCT row, col FROM inpoly) m USING (row, col)".replace("m.row IS", "m.hit IS").replace("DISTINCT row, col FROM", "DISTINCT row, col, 1 AS hit FROM"), "gridv", "inpoly"))
def polygon_clip(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    mask = polygons.polygon_to_mask(polygons.ring_edges(V.polys(spark, d)), V.GT, rows, cols, 1)
    clipped = polygons.polygon_clip(g.select("row", "col", F.array("v").alias("spectrum")), mask, -9999.0)
    return clipped.select("row", "col", "inside", F.col("spectrum")[0].alias("v"))


@query("polygon_positions", with_views(f"SELECT row, col FROM (SELECT DISTINCT row, col, row::BIGINT * 100 + col AS pix FROM inpoly) ORDER BY {V.key_sql('pix', 42)}, pix LIMIT 40", "inpoly"))
def polygon_positions(spark, d):
    rows, cols = V.grid_dims(V.gridv(spark, d))
    mask = polygons.polygon_to_mask(polygons.ring_edges(V.polys(spark, d)), V.GT, rows, cols, 1)
    return polygons.polygon_positions(mask, cols, 40).select("row", "col")


def checks(df, p, *names):
    """Checksums of every patch; the weighted one depends on each cell's and band's place."""

    def sums(x: np.ndarray) -> np.ndarray:
        i = np.arange(x.shape[1])
        return np.column_stack([x.sum(axis=1), x @ (i % (p * p) + 1 + (i // (p * p)) * 0.01)])

    summed = reduce.map_vectors(df.select(*names, "n_inside", "cube"), "cube", "_s", sums, reduce.DOUBLES)
    return summed.select(*names, "n_inside", r6(F.col("_s")[0]).alias("total"), F.round(F.col("_s")[1], 4).alias("weighted"))


def patch_sql(centres: str, names: str, p: int, *views: str) -> str:
    before = p // 2 - 1 if p % 2 == 0 else p // 2
    return with_views(
        f"""SELECT {names}, CAST(count(q.pix) AS INT) AS n_inside, round(coalesce(sum(s), 0), 6) + 0.0 AS total, round(coalesce(sum(s * (k + 1) + w * 0.01::DOUBLE), 0), 4) AS weighted
 FROM (SELECT *, unnest(range(0, {p * p})) AS k FROM ({centres})) c
 LEFT JOIN (SELECT pix, row AS r, col AS cc, list_sum(spectrum) AS s, list_sum([spectrum[b] * (b - 1) FOR b IN range(1, 65)]) AS w FROM px) q
 ON q.r = c.row + k // {p} - {before} AND q.cc = c.col + k % {p} - {before} GROUP BY {names}""",
        "px", *views,
    )


@query("patch_gather", patch_sql("SELECT row, col FROM lab", "row, col", 5, "lab"))
def patch_gather(spark, d):
    return checks(patches.patch_gather(V.lab(spark, d), V.px(spark, d), 5, bands=V.BANDS), 5, "row", "col")


@query("patch_gather_even", patch_sql("SELECT row, col FROM lab", "row, col", 4, "lab"))
def patch_gather_even(spark, d):
    return checks(patches.patch_gather(V.lab(spark, d), V.px(spark, d), 4, bands=V.BANDS), 4, "row", "col")


_centres = """SELECT fid, row, col FROM (SELECT fid, CAST(trunc((y - 4000000) / -30) AS INT) AS row, CAST(trunc((x - 500000) / 30) AS INT) AS col FROM pts), dim
 WHERE row BETWEEN -1 AND nrows AND col BETWEEN -1 AND ncols"""


@query("patch_gather_points", patch_sql(_centres, "fid, row, col", 3, "pts", "dim"))
def patch_gather_points(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return checks(patches.patch_gather_points(V.pts(spark, d), p, 3, V.GT, rows, cols, bands=V.BANDS), 3, "fid", "row", "col")


@query("patch_center_spectrum", with_views("SELECT row, col, i - 1 AS band, round(spectrum[i], 6) + 0.0 AS v FROM (SELECT row, col, spectrum, CAST(unnest(range(1, 65)) AS INT) AS i FROM lab JOIN px USING (row, col))", "lab", "px"))
def patch_center_spectrum(spark, d):
    gathered = patches.patch_gather(V.lab(spark, d), V.px(spark, d), 4, bands=V.BANDS)
    centre = gathered.select("row", "col", F.posexplode(patches.patch_center_spectrum(F.col("cube"), 4)).alias("band", "_v"))
    return centre.select("row", "col", "band", r6("_v").alias("v"))


@query("halo_tiles", with_views("""SELECT CAST(tr AS INT) AS tile_row, CAST(tc AS INT) AS tile_col, count(*) AS n, sum(CAST(row // 8 = tr AND col // 8 = tc AS BIGINT)) AS n_core
 FROM px, dim, range(0, 100) a(tr), range(0, 4) b(tc) WHERE row BETWEEN tr * 8 - 2 AND tr * 8 + 7 + 2 AND col BETWEEN tc * 8 - 2 AND tc * 8 + 7 + 2 AND tr * 8 < nrows GROUP BY 1, 2""".replace("sum(CAST(row // 8 = tr AND col // 8 = tc AS BIGINT))", "CAST(sum(CAST(row // 8 = tr AND col // 8 = tc AS BIGINT)) AS BIGINT)"), "px", "dim"))
def halo_tiles(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    copies = tiles.halo_tiles(p.select("row", "col"), 8, 2, 2, rows, cols)
    return copies.groupBy("tile_row", "tile_col").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("long")).alias("n_core"))


_emb = """SELECT fid, layer, class, x, y, row, col, CASE WHEN ok THEN row_number() OVER (PARTITION BY ok ORDER BY fid) ELSE 0 END AS emb_idx FROM
 (SELECT *, row BETWEEN 0 AND nrows - 1 AND col BETWEEN 0 AND ncols - 1 AS ok FROM
  (SELECT pts.*, CAST(trunc((y - 4000000) / -30) AS INT) AS row, CAST(trunc((x - 500000) / 30) AS INT) AS col FROM pts), dim)"""


@query("embed_index", with_views(f"SELECT fid, emb_idx FROM ({_emb})", "pts", "dim"))
def embed_index(spark, d):
    rows, cols = V.dims(V.px(spark, d))
    return layers.embed_index(V.pts(spark, d), V.GT, rows, cols).select("fid", "emb_idx")


@query("embed_join", with_views(f"SELECT fid, emb_idx, round(spectrum[1], 6) + 0.0 AS first FROM ({_emb}) e JOIN px ON px.pix + 1 = e.emb_idx", "pts", "dim", "px"))
def embed_join(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    features = p.select((F.col("pix") + 1).alias("emb_idx"), F.col("spectrum").alias("v"))
    joined = layers.embed_join(layers.embed_index(V.pts(spark, d), V.GT, rows, cols), features)
    return joined.select("fid", "emb_idx", r6(F.col("v")[0]).alias("first"))


@query("valid_features", with_views(f"SELECT fid FROM ({_emb}), (SELECT nrows AS h, ncols AS w FROM dim) WHERE emb_idx > 0 OR (x BETWEEN 500000 AND 500000 + 30 * w AND y BETWEEN 4000000 - 30 * h AND 4000000)", "pts", "dim"))
def valid_features(spark, d):
    rows, cols = V.dims(V.px(spark, d))
    indexed = layers.embed_index(V.pts(spark, d), V.GT, rows, cols)
    return layers.valid_features(indexed, V.GT, rows, cols).select("fid")


@query("cube_at_mask", with_views("SELECT row, col, lab.label AS label, round(spectrum[2] * 2, 6) + 0.0 AS s2 FROM lab JOIN px USING (row, col) WHERE lab.label > 0", "lab", "px"))
def cube_at_mask(spark, d):
    scores = V.px(spark, d).select("scene_id", "row", "col", F.transform("spectrum", lambda x: x * 2).alias("scores"))
    return reduce.cube_at_mask(scores, V.lab(spark, d)).select("row", "col", "label", r6(F.col("scores")[1]).alias("s2"))


# --- ranking and splits ---

@query("stratified_split", with_views(f"SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {V.key_sql('doc_id', 42)}, doc_id) <= floor(count(*) OVER (PARTITION BY label) * 0.7::DOUBLE) AS is_train FROM (SELECT doc_id, CAST(doc_id % 5 AS INT) AS label FROM samples_txt)", "samples_txt"))
def stratified_split(spark, d):
    samples = V.samples_txt(spark, d).select("doc_id", (F.col("doc_id") % 5).cast("int").alias("label"))
    return layers.stratified_split(samples, 0.7, "doc_id").select("doc_id", "label", "is_train")


@query("random_split_layer", with_views(f"SELECT fid, layer, row_number() OVER (PARTITION BY layer ORDER BY {V.key_sql('fid', 42)}, fid) <= floor(count(*) OVER (PARTITION BY layer) * 0.3::DOUBLE) AS selected FROM pts", "pts"))
def random_split_layer(spark, d):
    return layers.random_split_layer(V.pts(spark, d), 0.3).select("fid", "layer", "selected")


@query("random_split_layer_count", with_views(f"SELECT fid, layer, row_number() OVER (PARTITION BY layer ORDER BY {V.key_sql('fid', 42)}, fid) <= 50 AS selected FROM pts", "pts"))
def random_split_layer_count(spark, d):
    return layers.random_split_layer(V.pts(spark, d), 50).select("fid", "layer", "selected")


@query("split_complement", with_views(f"SELECT fid, layer FROM (SELECT fid, layer, row_number() OVER (PARTITION BY layer ORDER BY {V.key_sql('fid', 42)}, fid) AS rn FROM pts) WHERE rn > 50", "pts"))
def split_complement(spark, d):
    flagged = layers.random_split_layer(V.pts(spark, d), 50)
    return layers.split_complement(V.pts(spark, d), flagged.filter("selected")).select("fid", "layer")


@query("standardize_labels", with_views("SELECT pix, CAST(n AS INT) AS label FROM px JOIN (SELECT label, row_number() OVER (ORDER BY m, label) - 1 AS n FROM (SELECT label, avg(list_avg(spectrum)) AS m FROM px GROUP BY label)) USING (label)", "px"))
def standardize_labels_query(spark, d):
    p = V.px(spark, d)
    means = p.groupBy("label").agg(*[F.avg(F.col("spectrum")[i]).alias(f"m{i}") for i in range(V.BANDS)])
    centroids = means.select("label", F.array(*[f"m{i}" for i in range(V.BANDS)]).alias("v"))
    return standardize_labels(p.select("pix", "label"), centroids).select("pix", "label")


@query("sample_order", with_views("SELECT row, col, row_number() OVER (ORDER BY row, col) AS n FROM lab", "lab"))
def sample_order(spark, d):
    marked = V.lab(spark, d).withColumn("place", F.col("row").cast("long") * V.COLS + F.col("col"))
    return ranking.number_rows(ranking.sample_order(marked), "place", "n").select("row", "col", "n")


@query("threshold_flag", "SELECT event_id, CAST(CASE WHEN value > cut THEN -1 ELSE 1 END AS INT) AS flag FROM events, (SELECT quantile_cont(value, 0.8) AS cut FROM events)")
def threshold_flag_query(spark, d):
    return threshold_flag(V.table(spark, d, "events"), "value", 0.2).select("event_id", "flag")


@query("threshold_flag_by_layer", "SELECT event_id, event_type, CAST(CASE WHEN value > quantile_cont(value, 0.8) OVER (PARTITION BY event_type) THEN -1 ELSE 1 END AS INT) AS flag FROM events")
def threshold_flag_by_layer(spark, d):
    return threshold_flag(V.table(spark, d, "events"), "value", 0.2, ["event_type"]).select("event_id", "event_type", "flag")


@query("argmax_pixel", with_views("SELECT label, arg_max(pix, {'a': n, 'b': -pix}) AS pix FROM (SELECT pix, label, round(sqrt(list_sum([x * x FOR x IN spectrum])), 9) AS n FROM px) GROUP BY label", "px"))
def argmax_pixel(spark, d):
    norms = V.px(spark, d).withColumn("n", F.round(F.sqrt(F.aggregate("spectrum", F.lit(0.0), lambda s, x: s + x * x)), 9))
    return sampling.argmax_pixel(norms, F.col("n"), keys=["label"]).select("label", "pix")


# --- set operations ---

@query("merge_layers", with_views("SELECT fid, class, layer AS source_layer, CAST(row_number() OVER () * 0 + i AS INT) AS layer_order, 'class_1' AS merged_layer FROM pts JOIN (SELECT layer, dense_rank() OVER (ORDER BY layer) - 1 AS i FROM (SELECT DISTINCT layer FROM pts)) USING (layer)", "pts"))
def merge_layers(spark, d):
    p = V.pts(spark, d)
    folder = output_folder(spark, "layers")
    names = [f"class_{i}" for i in range(1, 6)]
    for name in names:  # written one after the other
        p.filter(F.col("layer") == name).select("fid", "class").write.parquet(f"{folder}/{name}")
    return layers.merge_layer_files(spark, {name: f"{folder}/{name}" for name in reversed(names)}, ["fid", "class"])


@query("assemble_blocks", with_views("SELECT row, col, CAST(label * 2 AS INT) AS label FROM px WHERE valid", "px"))
def assemble_blocks(spark, d):
    p = V.px(spark, d).filter("valid").withColumn("label", (F.col("label") * 2).cast("int")).select("row", "col", "label")
    rows = [p.filter(F.col("row") % 3 == i) for i in range(3)]
    return infer.assemble_blocks(rows)


@query("train_test_from_layers", with_views("""SELECT part, row, col, CAST(min(i) AS INT) AS class, round(any_value(t), 6) + 0.0 AS total FROM
 (SELECT CASE WHEN fid % 3 = 0 THEN 'test' ELSE 'train' END AS part, row, col, i, list_sum(spectrum) AS t FROM loc
  JOIN (SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS i FROM (SELECT DISTINCT layer FROM loc)) USING (layer) JOIN px USING (row, col)) GROUP BY part, row, col""", "loc", "px"))
def train_test_from_layers(spark, d):
    points = located(spark, d)
    train, test = points.filter("fid % 3 <> 0"), points.filter("fid % 3 = 0")
    both = layers.train_test_from_layers(train, test, V.px(spark, d), on_overlap="first")
    return both.select("part", "row", "col", "class", r6(vsum(F.col("spectrum"))).alias("total"))


# --- sampling with plain keys ---

_mask = f"SELECT * FROM px, dim WHERE true QUALIFY row_number() OVER (ORDER BY {V.key_sql('pix', 42)}, pix) <= CAST(floor(nrows * ncols * 0.1::DOUBLE) AS INT)"


@query("random_sample_mask", with_views(f"SELECT row, col, pix FROM ({_mask}) WHERE valid", "px", "dim"))
def random_sample_mask(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return sampling.random_sample_mask(p, rows, cols, 0.1).select("row", "col", "pix")


@query("block_random_sample", with_views(f"SELECT row // 4 AS block_row, col // 4 AS block_col, arg_min(pix, {{'a': {V.key_sql('pix', 3)}, 'b': pix}}) AS pix FROM px WHERE valid GROUP BY 1, 2", "px"))
def block_random_sample(spark, d):
    return patches.block_random_sample(V.px(spark, d), 4, 3).select("block_row", "block_col", "pix")


_draw = "SELECT {e} AS epoch, row // 4 AS block_row, col // 4 AS block_col, arg_min(pix, {{'a': {k}, 'b': pix}}) AS pix FROM px WHERE valid GROUP BY 2, 3"


@query("block_random_sample_epochs", with_views(" UNION ALL ".join(_draw.format(e=e, k=V.key_sql("pix", e)) for e in (0, 1)), "px"))
def block_random_sample_epochs(spark, d):
    """The draws of two epochs: a block's pixel changes from one to the next."""
    draws = [patches.block_random_sample(V.px(spark, d), 4, e).select(F.lit(e).alias("epoch"), "block_row", "block_col", "pix") for e in (0, 1)]
    return draws[0].unionByName(draws[1])


@query("pipeline_random_crop", patch_sql(f"SELECT row, col, 500000 + 30::DOUBLE * (col - 2) AS origin_x, 4000000 - 30::DOUBLE * (row - 2) AS origin_y FROM ({_mask}) WHERE valid", "row, col, origin_x, origin_y", 5, "dim"))
def pipeline_random_crop(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    cropped = plans.random_crop(p, V.GT, rows, cols, 5, 0.1, bands=V.BANDS)
    return checks(cropped, 5, "row", "col", "origin_x", "origin_y")


_lines = """SELECT concat('samples/img_', i, '_', fid, '.tif ', i) AS line FROM (SELECT fid, layer, CAST(trunc((y - 4000000) / -30) AS INT) AS row, CAST(trunc((x - 500000) / 30) AS INT) AS col FROM pts), dim
 JOIN (SELECT layer, row_number() OVER (ORDER BY layer) - 1 AS i FROM (SELECT DISTINCT layer FROM pts)) l USING (layer) WHERE row BETWEEN -1 AND nrows AND col BETWEEN -1 AND ncols"""


@query("pipeline_sample_crop", with_views(_lines.replace("FROM (SELECT fid, layer, CAST", "FROM dim, (SELECT fid, layer, CAST").replace(" FROM pts), dim\n", " FROM pts) q\n"), "pts", "dim"))
def pipeline_sample_crop(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    _, lines = plans.sample_crop(V.pts(spark, d), p, V.GT, rows, cols, 3, bands=V.BANDS)
    return lines

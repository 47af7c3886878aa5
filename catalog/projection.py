"""Sources, sinks and row-local functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views as V
from catalog.registry import query, r6, with_views
from cubeloom.functions import bands as B
from cubeloom.functions import color, geo, text
from cubeloom.functions.vectors import vsum
from cubeloom.operators import layers, patches, stencil, tiles
from cubeloom.plans import minerals
from cubeloom.session import output_folder
from cubeloom.sources import files, raster
from cubeloom.sources import scene as scenes

BAND = B.array_bands("spectrum", wrap=V.BANDS)


def sql_band(n: int) -> str:
    return f"spectrum[{(n - 1) % V.BANDS + 1}]"


def sql_terms(rule: B.BandRule) -> str:
    return "(" + " + ".join(f"CAST({sql_band(h)} - {sql_band(l)} > 0 AS INT)" for h, l in rule.terms) + ")"


# --- sources ---

@query("scan_scene_meta", with_views("SELECT CAST(max(row) + 1 AS INT) AS rows, CAST(max(col) + 1 AS INT) AS cols, CAST(max(len(spectrum)) AS INT) AS bands FROM px", "px"))
def scan_scene_meta(spark, d):
    return scenes.scene_meta(V.px(spark, d)).select("rows", "cols", "bands")


@query("scan_pixels", with_views("SELECT row, col, valid, band, round(v, 6) + 0.0 AS v FROM lng", "lng"))
def scan_pixels(spark, d):
    p = V.px(spark, d)
    return p.select("row", "col", "valid", F.posexplode("spectrum").alias("band", "_v")).select("row", "col", "valid", "band", r6("_v").alias("v"))


@query("scan_band", with_views("SELECT row, col, round(spectrum[5], 6) + 0.0 AS value FROM px", "px"))
def scan_band(spark, d):
    return scenes.scan_band(V.px(spark, d), 5).select("row", "col", r6("value").alias("value"))


@query("scan_window", with_views("SELECT row, col, pix FROM px WHERE row BETWEEN 3 AND 10 AND col BETWEEN 5 AND 14", "px"))
def scan_window(spark, d):
    return scenes.scan_window(V.px(spark, d), 5, 3, 10, 8).select("row", "col", "pix")


@query("scan_files", "SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source")
def scan_files(spark, d):
    """Texts are stored as one folder of files per source; the listing gives their sizes."""
    path = output_folder(spark, "texts")
    V.table(spark, d, "documents").select("source", "text").write.partitionBy("source").text(path)
    found = files.scan_files(spark, path, (".txt",)).select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "length")
    return found.groupBy("source").agg(F.sum("length").alias("bytes"))


@query("scan_sample_list", with_views("SELECT concat('/lists/img_', doc_id, '.tif') AS path, CAST(doc_id % 5 AS INT) AS label FROM samples_txt", "samples_txt"))
def scan_sample_list(spark, d):
    return files.parse_samples(V.samples_txt(spark, d), folder="/lists")


@query("scan_labelled_spectra", with_views("SELECT concat('/p/', pix, '.tif') AS path, label, round(list_sum(spectrum), 6) + 0.0 AS total, round(spectrum[64], 6) + 0.0 AS last FROM px WHERE valid", "px"))
def scan_labelled_spectra(spark, d):
    p = V.px(spark, d)
    path = F.concat(F.lit("/p/"), "pix", F.lit(".tif"))
    samples = p.select(path.alias("path"), "label")
    cubes = p.filter("valid").select(path.alias("path"), F.col("spectrum").alias("cube"))
    found = files.labelled_spectra(samples, cubes)
    return found.select("path", "label", r6(vsum(F.col("spectrum"))).alias("total"), r6(F.col("spectrum")[63]).alias("last"))


@query("scan_matrix", with_views("SELECT pix + 1 AS emb_idx, band, round(CAST(round(v, 4) AS FLOAT)::DOUBLE, 6) + 0.0 AS v FROM lng", "lng"))
def scan_matrix(spark, d):
    digits = F.transform("spectrum", lambda x: F.round(x, 4).cast("string"))
    lines = V.px(spark, d).select(F.concat_ws(",", (F.col("pix") + 1).cast("string"), F.concat_ws(",", digits)).alias("line"))
    read = files.parse_matrix(lines)
    return read.select("emb_idx", F.posexplode("v").alias("band", "_v")).select("emb_idx", "band", r6(F.col("_v").cast("double")).alias("v"))


@query("scan_points", with_views("SELECT fid, layer, class, x, y FROM pts", "pts"))
def scan_points(spark, d):
    return files.scan_points(V.pts(spark, d)).select("fid", "layer", "class", "x", "y")


@query("scan_training_log", with_views("SELECT CASE WHEN line LIKE 'Test%' THEN 'test' ELSE 'train' END AS phase, count(*) AS n, round(sum(CAST(regexp_extract(line, 'Accuracy: ([0-9.]+)', 1) AS DOUBLE)), 4) AS total FROM log_txt GROUP BY 1", "log_txt"))
def scan_training_log(spark, d):
    parsed = files.parse_log(V.log_txt(spark, d))
    return parsed.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# --- sinks ---

@query("sink_raster", with_views("SELECT px.row, px.col, CAST(CASE WHEN valid THEN coalesce(lab.label, 0) ELSE 0 END AS INT) AS label FROM px LEFT JOIN lab USING (row, col)", "px", "lab"))
def sink_raster(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    grid = raster.dense_grid(V.lab(spark, d), rows, cols, 0, mask=p.filter("valid"))
    path = output_folder(spark, "raster")
    raster.sink_raster(grid, path, V.scene(p), "uint8")
    return raster.read_raster(spark, path)[0].select("row", "col", "label")


@query("sink_palette_raster", with_views(
    f"""SELECT row, col, label, CAST(CASE label WHEN 0 THEN 255 WHEN 1 THEN 255 ELSE 0 END AS INT) AS r,
 CAST(CASE label WHEN 0 THEN 255 WHEN 1 THEN 208 ELSE 200 END AS INT) AS g, CAST(CASE label WHEN 0 THEN 255 WHEN 1 THEN 0 ELSE 255 END AS INT) AS b
 FROM (SELECT row, col, CASE WHEN {sql_terms(B.CALCITE)} = 7 THEN 1 WHEN {sql_terms(B.DOLOMITE)} = 12 THEN 2 ELSE 0 END AS label FROM px)""", "px"))
def sink_palette_raster(spark, d):
    p = V.px(spark, d)
    path = output_folder(spark, "palette-raster")
    colours = [color.MINERAL_PALETTE[i] for i in (0, 2, 3)]
    raster.sink_palette_raster(minerals.carbonate_map(p, BAND).select("row", "col", "label"), path, V.scene(p), colours)
    grid, _ = raster.read_raster(spark, path)
    return color.label_to_rgb(grid, spark.read.parquet(f"{path}/palette")).select("row", "col", "label", "r", "g", "b")


@query("sink_points", with_views("SELECT row, col, 500000 + 30::DOUBLE * col AS x, 4000000 - 30::DOUBLE * row AS y, CAST(label - 1 AS INT) AS class FROM lab", "lab"))
def sink_points(spark, d):
    path = output_folder(spark, "points")
    layers.labels_to_points(V.lab(spark, d), V.GT).write.parquet(path)
    return files.scan_points(spark.read.parquet(path)).select("row", "col", "x", "y", "class")


@query("sink_points_by_class", with_views("SELECT CAST(label - 1 AS INT) AS class, count(*) AS n, sum(500000 + 30::DOUBLE * col) AS x_total FROM lab GROUP BY 1", "lab"))
def sink_points_by_class(spark, d):
    path = output_folder(spark, "points-by-class")
    raster.sink_points_by_class(layers.labels_to_points(V.lab(spark, d), V.GT), path)
    return spark.read.parquet(path).groupBy("class").agg(F.count("*").alias("n"), F.sum("x").alias("x_total"))


@query("sink_sample_list", with_views("SELECT concat(split_part(line, ' ', 1), ' ', doc_id % 5) AS line FROM samples_txt", "samples_txt"))
def sink_sample_list(spark, d):
    path = output_folder(spark, "sample-list")
    files.sink_sample_list(files.parse_samples(V.samples_txt(spark, d)), path)
    return files.sample_lines(files.scan_sample_list(spark, path))


@query("sink_matrix", with_views("SELECT pix + 1 AS emb_idx, " + ", ".join(f"CAST(spectrum[{i + 1}] > 0 AS INT) AS c{i}" for i in range(64)) + " FROM px", "px"))
def sink_matrix(spark, d):
    flags = V.px(spark, d).select((F.col("pix") + 1).alias("emb_idx"), F.transform("spectrum", lambda x: x > 0).alias("v"))
    path = output_folder(spark, "matrix")
    files.sink_matrix(flags, path, V.BANDS)
    read = files.scan_matrix(spark, path)
    return read.select("emb_idx", *[F.get("v", F.lit(i)).cast("int").alias(f"c{i}") for i in range(V.BANDS)])


@query("pack_samples", with_views("SELECT concat('/p/', pix, '.tif') AS path, label, CAST(len(spectrum) AS INT) AS width FROM px", "px"))
def pack_samples(spark, d):
    p = V.px(spark, d)
    path = F.concat(F.lit("/p/"), "pix", F.lit(".tif"))
    samples = p.select(path.alias("path"), "label")
    cubes = p.select(path.alias("path"), F.col("spectrum").alias("cube"))
    store = output_folder(spark, "packed-samples")
    files.pack_samples(samples, cubes, store)
    return spark.read.parquet(store).select("path", "label", F.size("cube").alias("width"))


# --- row-local functions ---

@query("scale_reflectance", with_views("SELECT pix, band, round(CAST(trunc(v * 10000) AS SMALLINT) * 0.0001::DOUBLE, 6) + 0.0 AS v FROM lng", "lng"))
def scale_reflectance(spark, d):
    stored = V.px(spark, d).withColumn("spectrum", F.transform("spectrum", lambda x: (x * 10000).cast("smallint")))
    scaled = stored.select("pix", F.posexplode(B.scale_reflectance(F.col("spectrum"), "int16")).alias("band", "_v"))
    return scaled.select("pix", "band", r6("_v").alias("v"))


@query("valid_mask", with_views("SELECT pix, list_bool_or([x <> 0 FOR x IN spectrum]) AS valid FROM px", "px"))
def valid_mask(spark, d):
    return V.px(spark, d).select("pix", B.is_valid(F.col("spectrum"), 0.0).alias("valid"))


def _rule(rule: B.BandRule):
    n = len(rule.terms)
    sql = with_views(f"SELECT pix, CAST({sql_terms(rule)} = {n} AS INT) AS hit, {sql_terms(rule)} AS n_terms FROM px", "px")

    @query(f"mineral_{rule.name}", sql)
    def run(spark, d):
        return minerals.rule_map(V.px(spark, d), rule, BAND).select("pix", "hit", "n_terms")


for _r in B.MINERAL_RULES:
    _rule(_r)


@query("mineral_carbonate", with_views(f"SELECT pix, CASE WHEN {sql_terms(B.CALCITE)} = 7 THEN 1 WHEN {sql_terms(B.DOLOMITE)} = 12 THEN 2 ELSE 0 END AS label, {sql_terms(B.CALCITE)} AS calcite_terms, {sql_terms(B.DOLOMITE)} AS dolomite_terms FROM px", "px"))
def mineral_carbonate(spark, d):
    return minerals.carbonate_map(V.px(spark, d), BAND).select(
        "pix", "label", B.CALCITE.satisfied(BAND).alias("calcite_terms"), B.DOLOMITE.satisfied(BAND).alias("dolomite_terms")
    )


@query("mineral_hematite", with_views(f"SELECT pix, CAST({sql_band(36)} / ({sql_band(20)} + 0.0001::DOUBLE) > 1.8::DOUBLE AS INT) AS hit, round({sql_band(36)} / ({sql_band(20)} + 0.0001::DOUBLE), 4) + 0.0 AS ratio FROM px", "px"))
def mineral_hematite(spark, d):
    return minerals.hematite_map(V.px(spark, d), BAND).select("pix", "hit", (F.round("ratio", 4) + 0.0).alias("ratio"))


@query("band_rule_engine", with_views(" UNION ALL ".join(
    f"SELECT '{r.name}' AS rule, CAST(sum(CAST({sql_terms(r)} = {len(r.terms)} AS INT)) AS BIGINT) AS n_hit, count(*) AS n_pixels FROM px" for r in B.MINERAL_RULES), "px"))
def band_rule_engine(spark, d):
    return minerals.rule_counts(V.px(spark, d), B.MINERAL_RULES, BAND)


@query("band_rule_hits", with_views(" UNION ALL ".join(
    f"SELECT pix, '{r.name}' AS rule, {sql_terms(r)} AS n_terms, CAST({sql_terms(r)} = {len(r.terms)} AS INT) AS hit FROM px" for r in B.MINERAL_RULES), "px"))
def band_rule_hits(spark, d):
    return minerals.rule_hits(V.px(spark, d), B.MINERAL_RULES, BAND)


@query("pixel_to_geo", with_views("SELECT pix, 500000 + 30::DOUBLE * col AS x, 4000000 - 30::DOUBLE * row AS y FROM px", "px"))
def pixel_to_geo(spark, d):
    row, col = F.col("row"), F.col("col")
    return V.px(spark, d).select("pix", geo.pixel_x(row, col, V.GT).alias("x"), geo.pixel_y(row, col, V.GT).alias("y"))


@query("geo_to_pixel", with_views("SELECT fid, row, col FROM loc", "loc"))
def geo_to_pixel(spark, d):
    rows, cols = V.dims(V.px(spark, d))
    return layers.locate_points(V.pts(spark, d), V.GT, rows, cols).select("fid", "row", "col")


@query("patch_origin", with_views("SELECT pix, 500000 + 30::DOUBLE * (col - 7) AS origin_x, 4000000 - 30::DOUBLE * (row - 7) AS origin_y, 500000 + 30::DOUBLE * (col - 8) AS odd_x FROM px", "px"))
def patch_origin(spark, d):
    even = patches.patch_origin(V.px(spark, d), 16, V.GT)
    return even.select("pix", "origin_x", "origin_y", geo.patch_origin_x(F.col("col"), 17, V.GT).alias("odd_x"))


@query("flat_index", with_views("SELECT pix, CAST(row * 25 + col AS BIGINT) AS idx, CAST(pix // 25 AS INT) AS r, CAST(pix % 25 AS INT) AS c FROM px", "px"))
def flat_index(spark, d):
    return V.px(spark, d).select(
        "pix", geo.flat_index(F.col("row"), F.col("col"), V.COLS).alias("idx"), geo.row_of(F.col("pix"), V.COLS).alias("r"),
        geo.col_of(F.col("pix"), V.COLS).alias("c"),
    )


@query("tile_assign", with_views("SELECT pix, row // 7 AS block_row, col // 9 AS block_col, CAST(least(7, nrows - row // 7 * 7) AS INT) AS block_rows, CAST(least(9, ncols - col // 9 * 9) AS INT) AS block_cols FROM px, dim", "px", "dim"))
def tile_assign(spark, d):
    p = V.px(spark, d)
    rows, cols = V.dims(p)
    return tiles.tile_assign(p, (7, 9), rows, cols).select("pix", "block_row", "block_col", "block_rows", "block_cols")


@query("band_subset", with_views("SELECT pix, band - 10 AS band, round(v, 6) + 0.0 AS v FROM lng WHERE row >= 2 AND row < 9 AND col = 4 AND band >= 10 AND band < 20", "lng"))
def band_subset(spark, d):
    kept = scenes.band_subset(V.px(spark, d), (2, 9), 4, (10, 20))
    return kept.select("pix", F.posexplode("spectrum").alias("band", "_v")).select("pix", "band", r6("_v").alias("v"))


@query("merge_class_values", with_views("SELECT fid, CASE WHEN class IN (2, 4) THEN 1 ELSE class END AS class FROM pts", "pts"))
def merge_class_values(spark, d):
    return layers.merge_class_values(V.pts(spark, d), [1, 2, 4]).select("fid", "class")


@query("label_shift", with_views("SELECT row, col, CAST(label - 1 AS INT) AS class, CAST(label AS INT) AS stored FROM lab", "lab"))
def label_shift(spark, d):
    shifted = V.lab(spark, d).withColumn("class", (F.col("label") - 1).cast("int"))
    return shifted.select("row", "col", "class", (F.col("class") + 1).cast("int").alias("stored"))


_pal = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {int(h[1:3], 16)}, {int(h[3:5], 16)}, {int(h[5:7], 16)})" for i, h in enumerate(color.CLASS_PALETTE)
) + ", (-1, 255, 255, 255)) AS t(label, r, g, b)"


@query("label_to_rgb", with_views(f"SELECT pix, CAST(c AS INT) AS label, CAST(r AS INT) AS r, CAST(g AS INT) AS g, CAST(b AS INT) AS b FROM (SELECT pix, CASE WHEN valid THEN label ELSE -1 END AS c FROM px) JOIN ({_pal}) pal ON pal.label = c", "px"))
def label_to_rgb(spark, d):
    labelled = V.px(spark, d).select("pix", F.when(F.col("valid"), F.col("label")).otherwise(-1).alias("label"))
    return color.label_to_rgb(labelled, color.palette_table(spark)).select("pix", "label", "r", "g", "b")


_rgb = """SELECT px.row, px.col, {cols} FROM px, (SELECT {lims} FROM px WHERE valid)"""


def _rgb_sql() -> str:
    bands = (30, 20, 10)
    lims = ", ".join(f"quantile_cont(spectrum[{n}], 0.02) AS lo{i}, quantile_cont(spectrum[{n}], 0.98) AS hi{i}" for i, n in enumerate(bands))
    cols = ", ".join(
        f"round(CASE WHEN NOT valid THEN 1.0::DOUBLE ELSE greatest(0, least(1, (spectrum[{n}] - lo{i}) / (hi{i} - lo{i}))) END, 6) + 0.0 AS c{i + 1}"
        for i, n in enumerate(bands)
    )
    return with_views(_rgb.format(cols=cols, lims=lims), "px")


@query("rgb_compose", _rgb_sql())
def rgb_compose(spark, d):
    image = scenes.rgb_compose(V.px(spark, d), 30, 20, 10)
    return image.select("row", "col", *[r6(c).alias(c) for c in ("c1", "c2", "c3")])


@query("to_gray_u8", with_views(
    """SELECT row, col, r, g, b, CAST(round_even(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b, 0) AS INT) AS gray FROM (
 SELECT row, col, CAST(trunc(abs(spectrum[3]) * 255) AS INT) AS r, CAST(trunc(abs(spectrum[2]) * 255) AS INT) AS g, CAST(trunc(abs(spectrum[1]) * 255) AS INT) AS b FROM px)""", "px"))
def to_gray_u8(spark, d):
    image = V.px(spark, d).select("row", "col", *[color.to_u8(F.abs(F.col("spectrum")[i])).alias(c) for c, i in (("r", 2), ("g", 1), ("b", 0))])
    return image.withColumn("gray", color.gray(F.col("r"), F.col("g"), F.col("b")))


def _highpass_sql() -> str:
    taps = B.gaussian_taps(1.0)
    # mirrored position of band + k - 4 in 0..63
    terms = " + ".join(
        f"{w!r}::DOUBLE * spectrum[CASE WHEN band + {k - 4} < 0 THEN -(band + {k - 4}) ELSE least(band + {k - 4} + 1, 2 * 64 - band - {k - 4}) END]"
        for k, w in enumerate(taps)
    )
    return with_views(f"SELECT pix, band, round(spectrum[band + 1] - ({terms}), 6) + 0.0 AS noise FROM (SELECT pix, spectrum, CAST(unnest(range(0, 64)) AS INT) AS band FROM px)", "px")


@query("spectral_highpass", _highpass_sql())
def spectral_highpass(spark, d):
    noise = V.px(spark, d).select("pix", F.posexplode(B.spectral_highpass(F.col("spectrum"), 1.0)).alias("band", "_v"))
    return noise.select("pix", "band", r6("_v").alias("noise"))


@query("format_percent", """SELECT l_orderkey AS k, l_linenumber AS n, l_discount AS d, l_tax / 7 AS t,
 CASE WHEN l_discount * 100 = 0 THEN '0.0' WHEN abs(l_discount * 100 - round(l_discount * 100)) < 0.00000000005 THEN CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) ELSE printf('%.2f', l_discount * 100) END AS discount,
 CASE WHEN l_tax = 0 THEN '0.0' WHEN abs(l_tax / 7 * 100 - round(l_tax / 7 * 100)) < 0.00000000005 THEN CAST(CAST(round(l_tax / 7 * 100) AS INT) AS VARCHAR) ELSE printf('%.2f', l_tax / 7 * 100) END AS tax FROM lineitem""")
def format_percent(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_discount").alias("d"), (F.col("l_tax") / 7).alias("t"),
        text.percent_text(F.col("l_discount")).alias("discount"), text.percent_text(F.col("l_tax") / 7).alias("tax"),
    )


@query("edge_mask", with_views("SELECT row, col, CASE WHEN row BETWEEN 1 AND nrows - 3 AND col BETWEEN 3 AND ncols - 5 THEN v ELSE 0 END AS v FROM gridv, gdim", "gridv", "gdim"))
def edge_mask(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.edge_mask(g, rows, cols, 1, 2, 3, 4).select("row", "col", "v")


@query("swt_pad", with_views("SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, coalesce(v, 0) AS v FROM (SELECT nrows, (8 - nrows % 8) % 8 AS er, (8 - ncols % 8) % 8 AS ec, ncols FROM gdim), range(0, 2000) t(r), range(0, 104) u(c) LEFT JOIN gridv g ON g.row = r - er // 2 AND g.col = c - ec // 2 WHERE r < nrows + er", "gridv", "gdim"))
def swt_pad(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.swt_pad(g, rows, cols, 3)


@query("swt_crop", with_views("SELECT row, col, v FROM gridv", "gridv"))
def swt_crop(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.swt_crop(stencil.swt_pad(g, rows, cols, 3), rows, cols, 3)


@query("downsample_nearest", with_views("SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, v FROM gdim, range(0, 2000) t(r), range(0, 33) u(c) JOIN gridv g ON g.row = CAST(floor(r * (nrows / CAST(nrows // 3 AS DOUBLE))) AS INT) AND g.col = CAST(floor(c * (100 / 33::DOUBLE)) AS INT) WHERE r < nrows // 3", "gridv", "gdim"))
def downsample_nearest(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.downsample(g, rows, cols, 3, "NEAREST")


_lin = """SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(sum(v * wr * wc), 6) + 0.0 AS v FROM
 (SELECT r, k AS dr, CASE WHEN k = 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END AS wr, CAST(greatest(0, least(nrows - 1, floor(sy) + k)) AS INT) AS src
  FROM (SELECT r, nrows, (r + 0.5::DOUBLE) * (nrows / CAST(nrows * 2 // 5 AS DOUBLE)) - 0.5::DOUBLE AS sy FROM gdim, range(0, 2000) t(r) WHERE r < nrows * 2 // 5), (VALUES (0), (1)) kk(k)) a,
 (SELECT c, k AS dc, CASE WHEN k = 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END AS wc, CAST(greatest(0, least(99, floor(sx) + k)) AS INT) AS srcc
  FROM (SELECT c, (c + 0.5::DOUBLE) * 2.5::DOUBLE - 0.5::DOUBLE AS sx FROM range(0, 40) u(c)), (VALUES (0), (1)) kk(k)) b
 JOIN gridv g ON g.row = a.src AND g.col = b.srcc GROUP BY 1, 2"""


@query("downsample_linear", with_views(_lin, "gridv", "gdim"))
def downsample_linear(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.downsample(g, rows, cols, 2.5, "LINEAR").select("row", "col", r6("v").alias("v"))


def _cubic_axis(position: str, scale: str, count: str, size: str, name: str) -> str:
    """Four taps of one axis with their kernel weights."""
    return f"""(SELECT {position}, CAST(greatest(0, least({size} - 1, floor(s) + k)) AS INT) AS src_{name},
 CASE WHEN abs(s - floor(s) - k) <= 1 THEN (1.25::DOUBLE * abs(s - floor(s) - k) - 2.25::DOUBLE) * abs(s - floor(s) - k) ** 2 + 1
  ELSE -0.75::DOUBLE * (abs(s - floor(s) - k) ** 3 - 5 * abs(s - floor(s) - k) ** 2 + 8 * abs(s - floor(s) - k) - 4) END AS w_{name}
 FROM (SELECT {position}, nrows, ({position} + 0.5::DOUBLE) * {scale} - 0.5::DOUBLE AS s FROM gdim, range(0, 2000) t({position}) WHERE {position} < {count}), (VALUES (-1), (0), (1), (2)) kk(k))"""


_cub = f"""SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(sum(v * w_r * w_c), 6) + 0.0 AS v FROM
 {_cubic_axis("r", "(nrows / CAST(nrows * 2 // 5 AS DOUBLE))", "nrows * 2 // 5", "nrows", "r")} a,
 {_cubic_axis("c", "2.5::DOUBLE", "40", "100", "c")} b JOIN gridv g ON g.row = a.src_r AND g.col = b.src_c GROUP BY 1, 2"""


@query("downsample_cubic", with_views(_cub, "gridv", "gdim"))
def downsample_cubic(spark, d):
    g = V.gridv(spark, d)
    rows, cols = V.grid_dims(g)
    return stencil.downsample(g, rows, cols, 2.5, "CUBIC").select("row", "col", r6("v").alias("v"))

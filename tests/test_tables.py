import hashlib
import os

import numpy as np
import pytest
from helpers import cube_df
from pyspark.sql import functions as F

from cubeloom.functions import bands, color, geo, text
from cubeloom.functions.vectors import arith_key
from cubeloom.operators import evaluate, layers, moments, polygons, quantiles, ranking, reduce
from cubeloom.plans import minerals
from cubeloom.session import ensure_checkpoint_dir
from cubeloom.sources import scene as scenes

GT = (100.0, 10.0, 0.0, 200.0, 0.0, -10.0)


def test_checkpoint_folder_comes_from_the_session(spark):
    assert ensure_checkpoint_dir(spark) == ensure_checkpoint_dir(spark)


def test_first_rows_per_group_exactly(spark):
    rows = [(int(i), "hot" if i % 3 else f"g{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(7)
    key = arith_key(F.col("id"), 9)
    for quota in (1, 17, 10_000):
        got = ranking.flag_first(df, ["g"], key, F.col("id"), quota).collect()
        want = {}
        for i, g in rows:
            digest = hashlib.md5(f"9:{i}".encode()).hexdigest()
            want.setdefault(g, []).append((int(digest[:8], 16) % 2147483648, i))
        chosen = {i for members in want.values() for _, i in sorted(members)[:quota]}
        assert {r["id"] for r in got if r["selected"]} == chosen
        assert len(got) == 3000


def test_quota_of_zero_and_shares(spark):
    df = spark.range(10).withColumn("g", F.lit("a"))
    none = ranking.flag_first(df, ["g"], arith_key(F.col("id"), 1), F.col("id"), 0)
    assert none.filter("selected").count() == 0
    assert layers.random_split_layer(df.select(F.col("id").alias("fid"), F.col("g").alias("layer")), 0.35).filter("selected").count() == 3


def test_more_than_there_are_is_an_error(spark):
    points = spark.range(5).select(F.col("id").alias("fid"), F.lit("a").alias("layer"))
    with pytest.raises(Exception, match="more features"):
        layers.random_split_layer(points, 6).collect()


def test_split_and_complement_are_the_whole(spark):
    points = spark.range(100).select(F.col("id").alias("fid"), (F.col("id") % 3).cast("string").alias("layer"))
    taken = layers.random_split_layer(points, 0.4).filter("selected")
    rest = layers.split_complement(points, taken)
    assert taken.count() == 39 and rest.count() == 61
    assert taken.select("fid").union(rest.select("fid")).distinct().count() == 100


def test_numbering_over_many_ranges(spark):
    values = np.random.default_rng(1).permutation(500) ** 2
    df = spark.createDataFrame([(int(v), int(v) % 2) for v in values], "v long, g long").repartition(6)
    spread = ranking.ranged(df, "v").groupBy("_b").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert all(x["hi"] < y["lo"] for x, y in zip(spread, spread[1:]))
    got = {r["v"]: r["n"] for r in ranking.number_rows(df, "v", "n").collect()}
    assert [got[v] for v in sorted(got)] == list(range(1, 501))
    grouped = ranking.number_rows(df, "v", "n", ["g"]).filter("g = 1").orderBy("v").collect()
    assert [r["n"] for r in grouped] == list(range(1, len(grouped) + 1))


def test_running_mean_over_many_ranges(spark):
    df = spark.range(200).select("id", (F.col("id") % 7).cast("double").alias("v"), (F.col("id") % 3 + 1).alias("w")).repartition(5)
    got = evaluate.weighted_running_mean(df, "id", "v", "w").orderBy("id").collect()
    i = np.arange(200)
    want = np.cumsum((i % 7) * (i % 3 + 1)) / np.cumsum(i % 3 + 1)
    assert np.allclose([r["avg"] for r in got], want)


@pytest.mark.parametrize("n", [1, 2, 470, 30_000])
def test_exact_quantiles(spark, n):
    x = np.round(np.random.default_rng(n).normal(size=n), 3)
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    q = [0.0, 0.02, 0.333, 0.5, 0.98, 1.0]
    got = {r["q"]: r["value"] for r in quantiles.exact_quantiles(df, [], "v", q).collect()}
    assert np.allclose([got[p] for p in q], np.percentile(x, [100 * p for p in q]), atol=1e-12)


def test_quantiles_with_one_heavy_value(spark):
    x = np.concatenate([np.zeros(25_000), np.arange(1.0, 5_001.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = {r["q"]: r["value"] for r in quantiles.exact_quantiles(df, [], "v", [0.5, 0.9]).collect()}
    assert got[0.5] == 0.0 and np.isclose(got[0.9], np.percentile(x, 90))


def test_degenerate_stretch_is_zero_and_masks_hold(spark):
    df = spark.createDataFrame([("a", 3.0, True), ("a", 3.0, True), ("b", 1.0, True), ("b", 9.0, False), ("c", 2.0, False)],
                               "scene_id string, v double, valid boolean")
    for stretch in (quantiles.stretch_percent, quantiles.stretch_minmax):
        got = [(r["scene_id"], r["v"], r["stretched"]) for r in stretch(df, "v", valid="valid").collect()]
        assert sorted(got, key=str) == sorted(
            [("a", 3.0, 0.0), ("a", 3.0, 0.0), ("b", 1.0, 0.0), ("b", 9.0, None), ("c", 2.0, 0.0)], key=str)


def test_moments_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(2).normal(3, 2, (200, 5))
    df = spark.createDataFrame([([float(v) for v in r],) for r in x], "spectrum array<double>")
    for parts in (1, 6):
        m = moments.collect_moments(df.repartition(parts))
        assert m.n == 200 and np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.cov, np.cov(x, rowvar=False))
    with pytest.raises(ValueError):
        moments.collect_moments(df.limit(0))


@pytest.mark.parametrize("direction", moments.NOISE_DIRECTIONS)
def test_noise_directions(spark, direction):
    rng = np.random.default_rng(3)
    cube, valid = rng.random((6, 7, 3)), rng.random((6, 7)) > 0.2
    pair = {
        "lowerright": ((slice(None, -1), slice(None, -1)), (slice(1, None), slice(1, None))),
        "lowerleft": ((slice(None, -1), slice(1, None)), (slice(1, None), slice(None, -1))),
        "right": ((slice(None), slice(None, -1)), (slice(None), slice(1, None))),
        "lower": ((slice(None, -1), slice(None)), (slice(1, None), slice(None))),
    }[direction]
    both = valid[pair[0]] & valid[pair[1]]
    delta = (cube[pair[0]] - cube[pair[1]])[both]
    m = moments.noise_moments(cube_df(spark, cube, valid), direction)
    assert m.n == len(delta) and np.allclose(m.cov, np.cov(delta, rowvar=False) / 2)


def test_bad_direction_raises(spark):
    with pytest.raises(ValueError):
        moments.noise_differences(cube_df(spark, np.zeros((2, 2, 1))), "up")


def test_pca_matches_the_eigenvectors(spark):
    x = np.random.default_rng(4).normal(size=(10, 12, 4)) * [5, 3, 2, 1]
    scores = np.array([r["scores"] for r in reduce.pca(cube_df(spark, x), 2).orderBy("pix").collect()])
    flat = x.reshape(-1, 4)
    values, vectors = np.linalg.eigh(np.cov(flat, rowvar=False))
    want = flat @ reduce.canonical_sign(vectors[:, ::-1][:, :2])
    assert np.allclose(scores, want)


def test_mnf_whitens_the_noise(spark):
    rng = np.random.default_rng(5)
    smooth = np.add.outer(np.arange(20.0), np.arange(20.0))[..., None] * [1.0, -0.5, 2.0]
    cube = smooth + rng.normal(size=(20, 20, 3)) * [0.5, 1.0, 2.0]
    df = cube_df(spark, cube)
    scored = reduce.mnf(df, 3).select("scene_id", "row", "col", "valid", F.col("scores").alias("spectrum"))
    noise = moments.noise_moments(scored)
    assert np.allclose(noise.cov, np.eye(3), atol=1e-6)
    signal = moments.collect_moments(scored)
    variances = np.diag(signal.cov)
    assert np.all(np.diff(variances) < 0) and np.allclose(signal.cov, np.diag(variances), atol=1e-6)
    with pytest.raises(ValueError):
        reduce.enhance(df, "ICA")


def test_mnf_by_block_equals_each_block(spark):
    cube = np.random.default_rng(6).normal(size=(8, 8, 3))
    df = cube_df(spark, cube).withColumn("block", F.floor(F.col("row") / 4).cast("int"))
    both = {r["pix"]: r["scores"] for r in reduce.mnf_by_block(df, "block", 2).collect()}
    for b in (0, 1):
        alone = reduce.mnf(df.filter(F.col("block") == b), 2, valid=None)
        for r in alone.collect():
            assert np.allclose(both[r["pix"]], r["scores"], atol=1e-6)


def test_standardize_and_distances(spark):
    cube = np.random.default_rng(7).normal(size=(5, 6, 3))
    cube[..., 2] = 4.0
    df, x = cube_df(spark, cube), cube.reshape(-1, 3)
    sd = x.std(axis=0)
    sd[2] = 1.0
    got = np.array([r["scaled"] for r in reduce.standardize(df).orderBy("pix").collect()])
    assert np.allclose(got, (x - x.mean(axis=0)) / sd, atol=1e-7)
    d = np.array([r["distance"] for r in reduce.dist_mahalanobis(df).orderBy("pix").collect()])
    diff = x - x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", diff, np.linalg.pinv(np.cov(x, rowvar=False)), diff))
    assert np.allclose(d, want, atol=1e-6)
    corr = np.linalg.eigvalsh(np.corrcoef(x[:, :2], rowvar=False))
    assert np.isclose(reduce.spectral_complexity(df), 1 - corr[-1] / 2, atol=1e-6)


def test_geo_truncates_toward_zero(spark):
    points = spark.createDataFrame([(1, 95.0, 195.0), (2, 89.0, 195.0), (3, 105.0, 205.0), (4, 139.9, 161.0), (5, 140.1, 161.0)],
                                   "fid long, x double, y double")
    got = {r["fid"]: (r["row"], r["col"]) for r in layers.locate_points(points, GT, 4, 4).collect()}
    assert got == {1: (0, 0), 3: (0, 0), 4: (3, 3)}
    back = points.limit(1).select(geo.pixel_x(F.lit(2), F.lit(3), GT).alias("x"), geo.pixel_y(F.lit(2), F.lit(3), GT).alias("y")).first()
    assert tuple(back) == (130.0, 180.0)
    assert geo.patch_radius(4) == (1, 2) and geo.patch_radius(5) == (2, 2) and geo.patch_radius(1) == (0, 0)


def located(spark, rows):
    return spark.createDataFrame(rows, "scene_id string, layer string, fid long, row int, col int, class int")


def test_overlapping_layers_raise(spark):
    df = located(spark, [("s", "b", 1, 0, 0, 5), ("s", "a", 2, 1, 1, 6), ("s", "a", 3, 0, 0, 7)])
    with pytest.raises(Exception, match="overlap"):
        layers.layers_to_mask(df).collect()
    assert layers.overlap_check(df).count() == 1
    clean = layers.layers_to_mask(df.filter("fid < 3"))
    assert {(r["row"], r["label"]) for r in clean.collect()} == {(0, 2), (1, 1)}


def test_last_feature_wins_and_labels_round_trip(spark):
    df = located(spark, [("s", "a", 1, 0, 0, 5), ("s", "a", 9, 0, 0, 2), ("s", "a", 3, 1, 2, 0)])
    mask = layers.points_to_mask(df)
    assert {(r["row"], r["label"]) for r in mask.collect()} == {(0, 3), (1, 1)}
    assert {r["label"] for r in layers.points_to_mask(df, value=7).collect()} == {7}
    points = layers.labels_to_points(mask, GT).orderBy("row").collect()
    assert [(p["x"], p["y"], p["class"]) for p in points] == [(100.0, 200.0, 2), (120.0, 190.0, 0)]


def test_merge_needs_equal_widths_and_orders_by_time(spark):
    a = spark.createDataFrame([(1, 2)], "fid long, class long")
    b = spark.createDataFrame([(3, 4)], "id long, kind long")
    merged = layers.merge_layers([(20, "new", b), (10, "old", a)], ["fid", "class"]).orderBy("layer_order").collect()
    assert [(r["fid"], r["source_layer"], r["merged_layer"]) for r in merged] == [(1, "old", "old"), (3, "new", "old")]
    with pytest.raises(ValueError):
        layers.merge_layers([(1, "a", a), (2, "c", b.select("id"))], ["fid", "class"])


def test_written_layers_merge_by_their_age(spark, tmp_path):
    folders = {name: str(tmp_path / name) for name in ("a", "b", "c")}
    for i, name in enumerate(("b", "c", "a")):
        spark.createDataFrame([(i, 7)], f"{name}1 long, {name}2 long").write.parquet(folders[name])
        files = [os.path.join(folders[name], f) for f in os.listdir(folders[name])]
        for f in files:
            os.utime(f, (1_000_000 + i, 1_000_000 + i))
    merged = layers.merge_layer_files(spark, folders, ["fid", "class"]).orderBy("layer_order").collect()
    assert [(r["fid"], r["source_layer"], r["merged_layer"]) for r in merged] == [(0, "b", "b"), (1, "c", "b"), (2, "a", "b")]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        layers.merge_layer_files(spark, folders | {"empty": str(tmp_path / "empty")}, ["fid", "class"])


def test_valid_features_box_is_closed(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 4), (2, 140.0, 160.0, 0), (3, 140.1, 160.0, None)], "fid long, x double, y double, emb_idx long")
    assert {r["fid"] for r in layers.valid_features(points, GT, 4, 4).collect()} == {1, 2}
    assert {r["fid"] for r in layers.valid_features(points.drop("emb_idx"), GT, 4, 4).collect()} == {2}


def ring_table(spark, rings):
    rows = [(i, c, [{"x": x, "y": y} for x, y in ring]) for i, (c, ring) in enumerate(rings)]
    return spark.createDataFrame(rows, "fid long, class int, ring array<struct<x:double,y:double>>")


def test_polygon_with_a_notch(spark):
    ring = [(101.0, 199.0), (149.0, 199.0), (149.0, 151.0), (125.0, 180.0), (101.0, 151.0)]
    edges = polygons.ring_edges(ring_table(spark, [(3, ring)]))
    got = {(r["row"], r["col"]) for r in polygons.polygon_to_mask(edges, GT, 5, 5).collect()}

    def inside(x, y):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
        return odd

    assert got == {(r, c) for r in range(5) for c in range(5) if inside(105.0 + 10 * c, 195.0 - 10 * r)}
    touched = polygons.polygon_class_mask(edges, GT, 5, 5).collect()
    assert {(r["row"], r["col"]) for r in touched} >= got and {r["label"] for r in touched} == {3}


def test_polygon_beyond_the_scene_and_field_checks(spark):
    big = [(0.0, 300.0), (300.0, 300.0), (300.0, 0.0), (0.0, 0.0)]
    edges = polygons.ring_edges(ring_table(spark, [(1, big), (2, big)]))
    mask = polygons.polygon_class_mask(edges, GT, 3, 4).collect()
    assert len(mask) == 12 and {r["label"] for r in mask} == {2}
    with pytest.raises(ValueError):
        polygons.polygon_class_mask(edges, GT, 3, 4, "kind")
    with pytest.raises(ValueError):
        polygons.polygon_class_mask(edges.withColumn("class", F.lit("x")), GT, 3, 4)
    clipped = polygons.polygon_clip(cube_df(spark, np.ones((3, 5, 2))), polygons.polygon_to_mask(edges, GT, 3, 4), -1.0)
    assert clipped.filter("spectrum[0] = -1").count() == 3


def test_validity_and_scaling(spark):
    df = spark.createDataFrame([([0, 0],), ([0, 5],), ([-7, -7],)], "s array<smallint>")
    got = df.select(bands.is_valid(F.col("s")).alias("a"), bands.is_valid(F.col("s"), -7).alias("b"), bands.is_valid(F.col("s"), float("nan")).alias("c"),
                    bands.scale_reflectance(F.col("s"), "int16").alias("d"), bands.scale_reflectance(F.col("s"), "int16", 1).alias("e")).collect()
    assert [r["a"] for r in got] == [False, True, True] and [r["b"] for r in got] == [True, True, False] and all(r["c"] for r in got)
    assert np.isclose(got[1]["d"][1], 5e-4) and got[1]["e"] == [0, 5]


def test_rules_on_wide_layout_read_only_their_bands(spark, tmp_path):
    cube = np.random.default_rng(8).random((4, 5, 165))
    df = cube_df(spark, cube)
    arrays = minerals.rule_map(df, bands.CHLORITE, bands.array_bands()).orderBy("pix").select("hit", "n_terms").collect()
    scenes.to_wide(df, 165).write.parquet(str(tmp_path / "wide"))
    wide = spark.read.parquet(str(tmp_path / "wide"))
    mapped = minerals.rule_map(wide, bands.CHLORITE, bands.wide_bands()).select("pix", "hit", "n_terms")
    assert [tuple(r)[1:] for r in mapped.orderBy("pix").collect()] == [tuple(r) for r in arrays]
    schema = mapped._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert "b084" in schema and "b001" not in schema
    x = cube.reshape(-1, 165)
    want = sum((x[:, h - 1] > x[:, l - 1]).astype(int) for h, l in bands.CHLORITE.terms)
    assert [r["n_terms"] for r in arrays] == want.tolist()


def test_carbonates_prefer_calcite(spark):
    s = np.zeros(165)
    for hi, lo in ((138, 136), (142, 145), (146, 145), (147, 156), (159, 156), (157, 155), (155, 156)):
        s[hi - 1] += 1.0
    s[156 - 1], s[145 - 1], s[136 - 1] = -9, -9, -9
    s[155 - 1], s[157 - 1] = 0.5, 1.5
    df = cube_df(spark, np.stack([s, np.zeros(165)])[None])
    assert [r["label"] for r in minerals.carbonate_map(df, bands.array_bands()).orderBy("pix").collect()] == [1, 0]


def test_row_local_operators_run_on_a_stream(spark, tmp_path):
    cube = np.random.default_rng(9).random((3, 4, 165))
    df = cube_df(spark, cube)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    mapped = minerals.rule_map(stream, bands.HYDROMICA, bands.array_bands()).select("pix", "n_terms")
    q = mapped.writeStream.format("memory").queryName("terms").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = minerals.rule_map(df, bands.HYDROMICA, bands.array_bands()).select("pix", "n_terms")
    assert sorted(map(tuple, spark.table("terms").collect())) == sorted(map(tuple, batch.collect()))


def test_highpass_matches_mirrored_convolution(spark):
    x = np.random.default_rng(10).random(12)
    taps = np.array(bands.gaussian_taps(1.5))
    radius = len(taps) // 2
    padded = np.pad(x, radius, mode="symmetric")
    want = x - np.convolve(padded, taps, mode="valid")
    df = spark.createDataFrame([([float(v) for v in x],)], "s array<double>")
    assert np.allclose(df.select(bands.spectral_highpass(F.col("s"), 1.5)).first()[0], want)


def test_two_seeds_share_about_the_chance_number_of_rows(spark):
    ids = spark.range(20_000)
    picked = [{r["id"] for r in ids.orderBy(arith_key(F.col("id"), seed), "id").limit(2_000).collect()} for seed in (42, 43)]
    assert 130 < len(picked[0] & picked[1]) < 280  # 200 by chance


def test_percent_text(spark):
    cases = {0.0: "0.0", 0.5: "50", 1.0: "100", 0.125: "12.5", 0.0625: "6.2", 0.33333: "33.33", 0.061234: "6.12", 0.02675: "2.67", 0.145: "14.5", 1e-13: "0", -0.5: "-50"}
    df = spark.createDataFrame([(k,) for k in cases], "v double")
    got = {r["v"]: r["t"] for r in df.select("v", text.percent_text(F.col("v")).alias("t")).collect()}
    assert got == cases


def test_log_values(spark):
    lines = ["Test-Loss: 0.5, Accuracy: 91.25%, Lr: 1", "Epoch Accuracy: 7", "Accuracy: n/a", "nothing", "  Test Accuracy: 3.5 , x"]
    df = spark.createDataFrame([(l,) for l in lines], "line string")
    from cubeloom.sources.files import parse_log

    assert sorted(map(tuple, parse_log(df).collect())) == [("test", 3.5), ("test", 91.25), ("train", 7.0)]
    assert sorted(map(tuple, parse_log(df, "Loss: ").collect())) == [("test", 0.5)]
    with pytest.raises(ValueError):
        text.log_value(F.col("line"), "F1: ")


def test_palette_and_gray(spark):
    table = {r["label"]: (r["r"], r["g"], r["b"]) for r in color.palette_table(spark).collect()}
    assert len(table) == 17 and table[-1] == (255, 255, 255) and table[0] == (0xD5, 0xE5, 0xC9)
    df = spark.createDataFrame([(0.5, float("nan"), None)], "a double, b double, c double")
    assert tuple(df.select(color.to_u8(F.col("a")), color.to_u8(F.col("b")), color.to_u8(F.col("c"))).first()) == (127, 0, 0)


def test_band_and_window_readers(spark):
    df = cube_df(spark, np.arange(24.0).reshape(2, 4, 3))
    assert [r["value"] for r in scenes.scan_band(df, 2).orderBy("row", "col").collect()][:2] == [1.0, 4.0]
    with pytest.raises(ValueError):
        scenes.scan_band(df, 0)
    assert scenes.scan_window(df, 1, 0, 2, 5).count() == 4
    with pytest.raises(ValueError):
        scenes.Scene("s", 1, 1, 1, GT, dtype="complex64")
    meta = scenes.scene_meta(df).first()
    assert (meta["rows"], meta["cols"], meta["bands"]) == (2, 4, 3)
    sub = scenes.band_subset(df, rows=1, cols=(0, 2), bands=2).orderBy("col").collect()
    assert [r["spectrum"] for r in sub] == [[14.0], [17.0]]


def test_rgb_orders(spark):
    df = cube_df(spark, np.random.default_rng(11).random((4, 4, 3)), np.eye(4) == 0)
    rgb = {(r["row"], r["col"]): tuple(r)[3:] for r in scenes.rgb_compose(df, 1, 2, 3).collect()}
    bgr = {(r["row"], r["col"]): tuple(r)[3:] for r in scenes.rgb_compose(df, 1, 2, 3, order="bgr").collect()}
    assert all(bgr[k] == v[::-1] for k, v in rgb.items()) and rgb[(0, 0)] == (1.0, 1.0, 1.0)
    plain = {(r["row"], r["col"]): tuple(r)[3:] for r in scenes.rgb_compose(df, 1, 2, 3, stretch=False).collect()}
    assert plain[(0, 0)] == (1.0, 1.0, 1.0) and 0 < plain[(0, 1)][0] < 1


def test_confusion_sums_and_perfect_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 0)], "truth int, pred int")
    cm = evaluate.confusion_matrix(df)
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == 5
    perfect = evaluate.accuracy_kappa(evaluate.confusion_matrix(df.select("truth", F.col("truth").alias("pred")))).first()
    assert perfect["accuracy"] == 1.0 and perfect["kappa"] == 1.0
    with pytest.raises(ValueError):
        evaluate.confusion_percent(cm, "f1")


def test_sample_matrix_accuracy(spark):
    # a published 8-class demo matrix has trace 512 of 540; any matrix with that trace scores 94.8 %
    rows = [(i % 8, i % 8) for i in range(512)] + [(i % 8, (i + 1) % 8) for i in range(28)]
    df = spark.createDataFrame(rows, "truth int, pred int")
    assert round(evaluate.accuracy_kappa(evaluate.confusion_matrix(df)).first()["accuracy"], 3) == 0.948

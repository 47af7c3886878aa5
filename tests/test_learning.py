import inspect
import os

import numpy as np
import pytest
from helpers import cube_df
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cubeloom.operators import classify, cluster, evaluate, forests, infer, outlier, patches, reduce, rowmasks, sampling, search, superpixels
from cubeloom.plans import sampling as plans
from cubeloom.session import cut_lineage

FOLDER = "/root/testdata/sf0.001"
GT = (100.0, 10.0, 0.0, 200.0, 0.0, -10.0)


@pytest.mark.parametrize("p", [1, 2, 3, 4, 7])
def test_patches_are_padded_windows(spark, p):
    cube = np.random.default_rng(p).random((6, 5, 3))
    before, after = (p // 2 - 1, p // 2) if p % 2 == 0 else (p // 2, p // 2)
    padded = np.pad(cube, ((before, after), (before, after), (0, 0)), constant_values=-1.0)
    centres = spark.createDataFrame([("s1", 0, 0), ("s1", 5, 4), ("s1", 2, 3)], "scene_id string, row int, col int")
    for r in patches.patch_gather(centres, cube_df(spark, cube), p, fill=-1.0).collect():
        want = padded[r["row"]: r["row"] + p, r["col"]: r["col"] + p].transpose(2, 0, 1)
        assert np.array_equal(np.array(r["cube"]).reshape(3, p, p), want)
        assert r["n_inside"] == (want[0] != -1).sum()


def test_windows_overlapping_the_scene_keep_outside_centres(spark):
    cube = np.ones((4, 4, 2))
    points = spark.createDataFrame([(1, "s1", 85.0, 195.0), (2, "s1", 79.0, 195.0), (3, "s1", 155.0, 195.0), (4, "s1", 165.0, 195.0)],
                                   "fid long, scene_id string, x double, y double")
    got = {r["fid"]: r["n_inside"] for r in patches.patch_gather_points(points, cube_df(spark, cube), 3, GT, 4, 4).collect()}
    # columns -1, -2, 5, 6 of a 4-column scene with a reach of one: only -1 touches it
    assert got == {1: 2}
    got = {r["fid"]: r["n_inside"] for r in patches.patch_gather_points(points, cube_df(spark, cube), 5, GT, 4, 4).collect()}
    assert got == {1: 6, 2: 3, 3: 3}
    with pytest.raises(ValueError):
        patches.require_rows(points.filter("fid > 9"), "no position inside")


def test_centre_spectrum_of_even_and_odd_patches(spark):
    cube = np.random.default_rng(1).random((5, 5, 4))
    centres = spark.createDataFrame([("s1", 2, 2)], "scene_id string, row int, col int")
    for p in (3, 4):
        got = patches.patch_gather(centres, cube_df(spark, cube), p)
        assert np.allclose(got.select(patches.patch_center_spectrum(F.col("cube"), p)).first()[0], cube[2, 2])


def stack(spark, n=40, bands=3, p=4, seed=0):
    x = np.random.default_rng(seed).random((n, bands, p, p)) + 1.0
    rows = [(i, [float(v) for v in x[i].ravel()]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, cube array<double>").repartition(3), x


def cubes_of(df, shape):
    return np.array([r["cube"] for r in df.orderBy("id").collect()]).reshape(shape)


def test_flip_and_turns(spark):
    df, x = stack(spark)
    assert np.array_equal(cubes_of(patches.augment_flip(df, 4, "rows"), x.shape), np.flip(x, 2))
    assert np.array_equal(cubes_of(patches.augment_flip(df, 4, "cols"), x.shape), np.flip(x, 3))
    for k in (1, 2, 3):
        assert np.array_equal(cubes_of(patches.augment_rot90(df, 4, k), x.shape), np.rot90(x, k, (2, 3)))
    with pytest.raises(ValueError):
        patches.flip_order(4, "bands")


def test_noise_has_its_strength_and_repeats(spark):
    df, x = stack(spark, 200)
    a = cubes_of(patches.augment_noise(df, "id", 0.05, seed=3), x.shape)
    b = cubes_of(patches.augment_noise(df.repartition(7), "id", 0.05, seed=3), x.shape)
    assert np.array_equal(a, b)
    z = (a - x) / 0.05
    assert abs(z.mean()) < 0.05 and abs(z.std() - 1) < 0.05
    assert abs(np.corrcoef(z[:-1].ravel(), z[1:].ravel())[0, 1]) < 0.05


def test_erasing_spares_the_centre(spark):
    df, x = stack(spark, 100, 2, 5)
    a = cubes_of(patches.augment_erase(df, "id", 5, 0.5), x.shape)
    erased = (a == 0).any(axis=(1, 2, 3))
    assert 25 < erased.sum() < 75 and (a[:, :, 2, 2] == x[:, :, 2, 2]).all()
    assert np.array_equal((a == 0)[:, 0], (a == 0)[:, 1])


def test_spectral_mask_and_band_dropout_shares(spark):
    df, x = stack(spark, 200, 20, 2)
    a = cubes_of(patches.augment_spectral_mask(df, "id", 0.5, 0.75), x.shape)
    whole = (a != 0).all(axis=(1, 2, 3))
    assert 70 < whole.sum() < 130 and abs((a[~whole] != 0).mean() - 0.75) < 0.03
    b = cubes_of(patches.augment_band_dropout(df, "id", 2, 0.3, 0.5, seed=5), x.shape)
    gone = (b == 0).all(axis=(2, 3))
    assert 70 < gone.any(axis=1).sum() < 130 and len(np.unique(gone[gone.any(axis=1)], axis=0)) == 1


def test_rotation_by_quarter_turns_is_exact(spark):
    x = np.random.default_rng(2).random((3, 2, 5, 5))
    turned = patches.rotate_cubes(x.reshape(3, -1), np.full(3, 90.0), 5).reshape(x.shape)
    assert np.allclose(turned, np.rot90(x, 1, (2, 3))) or np.allclose(turned, np.rot90(x, -1, (2, 3)))
    assert np.allclose(patches.rotate_cubes(x.reshape(3, -1), np.zeros(3), 5).reshape(x.shape), x)


def test_expansion_rounds(spark):
    df, x = stack(spark, 6)
    combos = patches.expand_combinations()
    assert len(combos) == 47 and len(set(patches.choose_combinations(10, 4))) == 10
    with pytest.raises(ValueError):
        patches.choose_combinations(48)
    got = patches.augment_expand(df, "id", 4, [("rows", 1, None), (None, None, 0.01)])
    assert np.array_equal(cubes_of(got.filter("round = -1"), x.shape), x)
    assert np.array_equal(cubes_of(got.filter("round = 0"), x.shape), np.rot90(np.flip(x, 2), 1, (2, 3)))
    assert abs((cubes_of(got.filter("round = 1"), x.shape) - x).std() - 0.01) < 0.002


def test_chain_keeps_shape_and_repeats(spark):
    df, x = stack(spark, 30)
    a = cubes_of(patches.augment_chain(df, "id", 4, 1), x.shape)
    assert np.array_equal(a, cubes_of(patches.augment_chain(df.repartition(5), "id", 4, 1), x.shape))
    assert not np.array_equal(a, x)


def test_purity_counts(spark):
    x = np.random.default_rng(3).normal(size=(8, 9, 4))
    df, flat = cube_df(spark, x), x.reshape(-1, 4)
    directions = sampling.random_directions(50, 4, 1)
    assert np.allclose((directions**2).sum(axis=1), 1)
    s = (flat - flat.mean(axis=0)) @ directions.T
    want = np.bincount(s.argmax(axis=0), minlength=72) + np.bincount(s.argmin(axis=0), minlength=72)
    got = {r["pix"]: r["count"] for r in sampling.ppi(df, directions).collect()}
    assert got == {i: int(n) for i, n in enumerate(want) if n} and sum(got.values()) == 100
    near = ((s >= s.max(axis=0) - 0.2).sum(axis=1) + (s <= s.min(axis=0) + 0.2).sum(axis=1))
    got = {r["pix"]: r["count"] for r in sampling.ppi(df, directions, 0.2).collect()}
    assert got == {i: int(n) for i, n in enumerate(near) if n}


@pytest.mark.parametrize("block", [7, 20_000])
def test_purity_near_the_extremes_of_every_group(spark, monkeypatch, block):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", block)
    x = np.random.default_rng(4).normal(size=(8, 9, 4))
    flat, seg = x.reshape(-1, 4), np.arange(72) % 20 // 15  # 54 pixels or so against 18
    df = cube_df(spark, x).withColumn("seg", F.floor(F.col("pix") % 20 / 15).cast("int"))
    directions = sampling.random_directions(50, 4, 1)
    want = {}
    for g in (0, 1):
        pix = np.flatnonzero(seg == g)
        s = flat[pix] @ directions.T
        near = (s >= s.max(axis=0) - 0.2).sum(axis=1) + (s <= s.min(axis=0) + 0.2).sum(axis=1)
        want |= {(g, int(p)): int(n) for p, n in zip(pix, near) if n}
    found = sampling.ppi(df, directions, 0.2, keys=["seg"])
    assert {(r["seg"], r["pix"]): r["count"] for r in found.collect()} == want
    assert sampling.ppi(df.limit(0), directions, 0.2, keys=["seg"]).count() == 0
    assert sampling.ppi(df.limit(0), directions, 0.2).count() == 0


def brute_smacc(h, n):
    r, q, fs = h.copy(), [], []
    norms = np.sqrt((h * h).sum(axis=1))
    while len(q) < n:
        i = int(norms.argmax())
        q.append(i)
        w = r[i]
        o = r @ (w / (w @ w))
        alpha = np.ones(len(h))
        for f in fs:
            t = o * f[i]
            t[t == 0] = 1e-10
            alpha = np.minimum(f / t, alpha)
        alpha[o <= 0] = 0
        alpha[i] = 1
        fn = np.maximum(alpha * o, 0)
        r = r - np.outer(fn, w)
        fs = [np.maximum(f - f[i] * fn, 0) for f in fs] + [fn]
        norms = np.sqrt((r * r).sum(axis=1))
    f = np.array(fs).T
    for k, i in enumerate(q):
        f[q, k] = 0
        f[i, k] = 1
    return q, f, r


def test_smacc_matches_brute_force_per_block(spark):
    x = np.random.default_rng(4).random((6, 10, 5))
    df = cube_df(spark, x).withColumn("block", F.floor(F.col("col") / 5).cast("int"))
    abundances, chosen = sampling.smacc(df, {0: 4, 1: 3}, block="block", cut_every=2)
    picks = chosen.orderBy("block", "step").collect()
    for b, n in ((0, 4), (1, 3)):
        h = x[:, 5 * b: 5 * b + 5].reshape(-1, 5)
        pix = np.array([[r * 10 + 5 * b + c for c in range(5)] for r in range(6)]).ravel()
        q, f, r = brute_smacc(h, n)
        assert [p["pix"] for p in picks if p["block"] == b] == pix[q].tolist()
        rows = abundances.filter(F.col("block") == b).orderBy("pix").collect()
        assert np.allclose([row["f"] for row in rows], f) and np.allclose([row["residual"] for row in rows], r)
        assert [row["pix"] for row in rows if row["is_endmember"]] == sorted(pix[q].tolist())


def test_smacc_stops_at_the_rank_or_the_residual(spark):
    basis = np.random.default_rng(5).random((2, 4))
    mix = np.random.default_rng(6).random((30, 2))
    df = cube_df(spark, (mix @ basis).reshape(5, 6, 4))
    _, chosen = sampling.smacc(df)
    assert chosen.count() == 2
    _, more = sampling.smacc(df, 1, max_residual=1e-6)
    assert more.count() >= 2


def test_superpixels_partition_two_halves(spark):
    cube = np.zeros((12, 20, 1))
    cube[:, 10:] = 1.0
    seg = superpixels.slic(cube_df(spark, cube), "spectrum", 12, 20, 8, 0.1)
    labels = {}
    for r in seg.collect():
        labels.setdefault(r["seg"], set()).add(r["spectrum"][0])
    assert all(len(v) == 1 for v in labels.values()) and min(labels) >= 1 and 4 <= len(labels) <= 10
    with pytest.raises(ValueError):
        superpixels.slic(cube_df(spark, cube), "spectrum", 12, 20, 0)


def test_equal_segments_score_alike(spark):
    stats = spark.createDataFrame([(1, 5, 2.0), (2, 5, 2.0)], "seg int, area long, var_sum double")
    got = sampling.segment_sample_counts(stats, 20).collect()
    assert {r["score"] for r in got} == {0.5} and {r["n_samples"] for r in got} == {10}


def test_superpixel_plan_picks_pixels_of_every_segment(spark):
    cube = np.random.default_rng(7).random((10, 12, 5))
    chosen = plans.superpixel_sampling(cube_df(spark, cube), 10, 12, 3, 6, k=3, niters=40).collect()
    assert 0 < len(chosen) <= 3 * 12 and len({r["pix"] for r in chosen}) == len(chosen)


def blobs(spark, k=3, n=40, width=4, corners=False):
    rng = np.random.default_rng(8)
    # on a line, or one per axis (separable by planes one against the rest)
    centres = np.eye(k, width) * 5.0 if corners else np.arange(k)[:, None] * 5.0 + np.zeros(width)
    rows = [(int(i), int(i % k), [float(v) for v in centres[i % k] + rng.normal(0, 0.3, width)]) for i in range(k * n)]
    return spark.createDataFrame(rows, "emb_idx long, label int, v array<double>").repartition(3)


def test_mixture_labels_follow_the_means(spark):
    df = blobs(spark)
    got = cluster.gmm_cluster(df.withColumnRenamed("label", "kind"), 3, seeds=(1, 2)).collect()
    assert all(r["label"] == r["kind"] for r in got)


def mixture_by_hand(x, means, steps, floor=1e-6):
    """Plain mixture steps on the whole matrix; mean log-likelihoods."""
    k, d = means.shape
    weights, covs = np.full(k, 1 / k), [np.diag(x.var(axis=0)) + floor * np.eye(d)] * k
    out = []
    for _ in range(steps):
        logs = np.stack([
            np.log(w) - 0.5 * (np.linalg.slogdet(2 * np.pi * c)[1] + np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m))
            for w, m, c in zip(weights, means, covs)
        ], axis=1)
        whole = np.log(np.exp(logs).sum(axis=1))
        out.append(whole.mean())
        shares = np.exp(logs - whole[:, None])
        size = shares.sum(axis=0)
        means = (shares.T @ x) / size[:, None]
        covs = [((s[:, None] * (x - m)).T @ (x - m)) / n + floor * np.eye(d) for s, m, n in zip(shares.T, means, size)]
        weights = size / len(x)
    return out


def test_mixture_steps_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 1 + m / 5, (60, 3)) for m in (0, 4, 9)])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4)
    _, _, _, gains = cluster.mixture_fit(df, 3, (1, 2), max_iter=6, tol=-1.0)
    for seed, found in zip((1, 2), gains):
        want = mixture_by_hand(x, cluster.start_means(df, 3, (seed,))[0], 6)
        assert np.allclose(found, want, atol=1e-9) and all(b >= a - 1e-9 for a, b in zip(found, found[1:]))


def test_mixture_of_repeated_and_rank_deficient_rows(spark):
    rng = np.random.default_rng(6)
    flat = rng.normal(size=(80, 2)) @ rng.normal(size=(2, 6)) * 1e4  # rank 2 of 6, large values
    x = np.concatenate([flat, np.zeros((30, 6)), np.ones((20, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "emb_idx long, v array<double>").repartition(3)
    got = {r["emb_idx"]: r["label"] for r in cluster.gmm_cluster(df, 5, seeds=(1, 2, 3), max_iter=30).collect()}
    assert len(got) == len(x) and len({got[i] for i in range(80, 110)}) == 1 and set(got.values()) <= set(range(5))
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0])], "emb_idx long, v array<double>")
    assert cluster.gmm_cluster(two, 3).count() == 2 and cluster.gmm_cluster(two.limit(0), 3).count() == 0


def test_isolation_flags_the_planted_outliers(spark):
    rng = np.random.default_rng(9)
    rows = []
    for layer in ("a", "b"):
        for i in range(95):
            rows.append((len(rows), layer, [float(v) for v in rng.normal(0, 1, 3)]))
        for i in range(5):
            rows.append((len(rows), layer, [float(v) for v in rng.normal(12, 1, 3)]))
    df = spark.createDataFrame(rows, "fid long, layer string, spectrum array<double>").repartition(4)
    flags = outlier.isolation_forest(df, 0.05, trees=50).collect()
    out = {r["fid"] for r in flags if r["flag"] == -1}
    assert out == {i for i in range(200) if i % 100 >= 95}
    kept = outlier.clean_samples(df, "Mccv_LF", 0.05, n_splits=3, trees=20)
    assert {r["fid"] for r in kept.collect()} == set(range(200)) - out
    with pytest.raises(ValueError):
        outlier.clean_samples(df, "LOF")


def grow_by_hand(x, rows, key, tree):
    """Depths of a tree's leaves by recursion, one row at a time: the twin of the arrays."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))

    def grow(rows, depth, place):
        varied = [f for f in range(x.shape[1]) if len({x[r, f] for r in rows}) > 1]
        if depth >= limit or len(rows) < 2 or not varied:
            return depth + float(outlier.average_path(len(rows)))
        f = int(outlier.unit(key, tree, place, 1) * x.shape[1])
        if f not in varied:
            f = varied[int(outlier.unit(key, tree, place, 2) * len(varied))]
        low, high = min(x[r, f] for r in rows), max(x[r, f] for r in rows)
        cut = low + float(outlier.unit(key, tree, place, 3)) * (high - low)
        below = [r for r in rows if x[r, f] <= cut]
        return f, cut, grow(below, depth + 1, 2 * place), grow([r for r in rows if x[r, f] > cut], depth + 1, 2 * place + 1)

    return grow(list(rows), 0, 1)


def depth_by_hand(node, v):
    while isinstance(node, tuple):
        node = node[2] if v[node[0]] <= node[1] else node[3]
    return node


def test_permutations_are_permutations():
    for n in (1, 2, 3, 7, 100, 1000):
        got = outlier.permuted(np.arange(n), n, 5)
        assert sorted(got.tolist()) == list(range(n)) and outlier.permuted(got, n, 5, back=True).tolist() == list(range(n))
    assert outlier.permuted(np.arange(1000), 1000, 5).tolist() != outlier.permuted(np.arange(1000), 1000, 6).tolist()


@pytest.mark.parametrize("rows", [1, 64, 700, 1100])
def test_rows_walk_forests_as_bits_like_one_by_one(monkeypatch, rows):
    monkeypatch.setattr(outlier, "STRETCH", 1024)
    rng = np.random.default_rng(rows)
    x = rng.normal(size=(rows, 5)).round(1)
    x[::7, 2], x[::11, 3], x[::13] = np.nan, np.inf, x[0]
    trained = rng.normal(size=(900, 5)).round(1)
    drawn = [outlier.tree_rows(900, 3, s, 9, 0.2) for s in range(3)]
    forests = [outlier.grow_forest(trained, d, 50 + s) for s, d in enumerate(drawn)]
    forests.append(outlier.grow_forest(np.zeros((900, 5)), drawn[0], 1))  # leaves alone

    def depth(forest, v, at):
        while forest["feature"][at] >= 0:
            at = forest["left"][at] + (v[forest["feature"][at]] > forest["cut"][at])
        return forest["cut"][at]

    masks = outlier.row_masks(x)
    assert [size for m in masks for size in m.sizes] == [512] * (rows // 512) + [rows % 512]
    scale = float(outlier.average_path(256))
    walks = [rowmasks.Walk(*(forest[name] for name, _ in outlier.FIELDS), 9) for forest in forests]
    walks = [rowmasks.Walk.unpacked(walk.packed()) for walk in walks]
    for forest, got in zip(forests, outlier.forest_values(masks, walks, 720), strict=True):
        want = -np.exp2(-np.array([[depth(forest, v, t) for t in range(9)] for v in x]).mean(axis=1) / scale)
        assert np.array_equal(got, want)


def test_a_block_of_rows_may_span_batches(spark, monkeypatch):
    """A block reads the forests once, however small Arrow's batches are."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "ab"[i % 2], rng.normal(size=3).tolist()) for i in range(600)], "fid long, layer string, spectrum array<double>")
    want = sorted(outlier.mc_isolation(df, 4, 0.2, trees=5).collect())
    monkeypatch.setattr(outlier, "MASK_BYTES", 1)
    small = sorted(outlier.mc_isolation(df, 4, 0.2, trees=5).collect())
    monkeypatch.undo()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert sorted(outlier.mc_isolation(df, 4, 0.2, trees=5).collect()) == want == small
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("lot, block", [(25, 50_000), (2, 90)])
def test_monte_carlo_scores_equal_brute_force(spark, monkeypatch, lot, block):
    monkeypatch.setattr(outlier, "LOT", lot)
    monkeypatch.setattr(outlier, "BLOCK_ROWS", block)
    rng = np.random.default_rng(10)
    layers = {"a": rng.normal(size=(30, 3)).round(1), "b": np.repeat(rng.normal(size=(4, 3)), 5, axis=0), "c": np.zeros((3, 3)), "d": np.zeros((1, 3))}
    layers["a"][:, 1] = 4.0  # a feature that never varies
    layers["e"] = rng.normal(size=(400, 2))  # more training rows than a tree takes
    rows, want, splits, trees, test, seed = [], {}, 5, 3, 0.2, 42
    for layer, x in layers.items():
        first, n, key = len(rows), len(x), outlier.layer_key(layer, seed)
        rows += [(first + i, layer, v.tolist()) for i, v in enumerate(x)]
        scores, offsets = np.zeros((splits, n)), []
        for s in range(splits):
            drawn = outlier.tree_rows(n, key, s, trees, test)
            grown = [grow_by_hand(x, drawn[t], int(outlier.mixed(key, s, 11)), t) for t in range(trees)]
            depth = np.array([np.mean([depth_by_hand(g, v) for g in grown]) for v in x])
            m = drawn.shape[1]
            scores[s] = -(2.0 ** (-depth / float(outlier.average_path(m)))) if m > 1 else -1.0
            trained = outlier.in_train(np.arange(n), n, key, s, test)
            offsets.append(np.quantile(scores[s][trained], 0.1))
            assert trained.sum() == outlier.train_size(n, test) and set(drawn.ravel()) <= set(np.flatnonzero(trained))
        want |= {first + i: scores[:, i].mean() - np.mean(offsets) for i in range(n)}
    df = spark.createDataFrame(rows, "fid long, layer string, spectrum array<double>").repartition(4)
    got = {r["fid"]: r["score"] for r in outlier.mc_isolation(df, splits, test, trees=trees, seed=seed).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k], atol=1e-12) for k in got)


def test_blocks_without_neighbours_take_the_noise_of_all(spark):
    rng = np.random.default_rng(2)
    rows = [(r, c, 0 if r < 5 else 1 + (r + c) % 3, rng.normal(size=4).tolist()) for r in range(6) for c in range(5) if r < 5 or c in (0, 2)]
    df = spark.createDataFrame(rows, "row int, col int, block int, spectrum array<double>")
    got = reduce.mnf_by_block(df, "block", 2).collect()
    assert len(got) == len(rows) and all(np.isfinite(r["scores"]).all() for r in got)


def test_average_path():
    assert outlier.average_path(1) == 0 and outlier.average_path(2) == 1
    assert np.isclose(outlier.average_path(256), 2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_classifiers_and_map(spark):
    df = blobs(spark, n=20, corners=True).withColumnRenamed("v", "spectrum").coalesce(1).cache()
    forest = classify.random_forest(df, trees=20, depth=5)
    pixels = df.withColumn("valid", F.col("emb_idx") != 7).select("emb_idx", "spectrum", "valid")
    got = {r["emb_idx"]: r["label"] for r in classify.predict_map(forest, pixels).collect()}
    assert got.pop(7) == -1 and np.mean([v == k % 3 for k, v in got.items()]) > 0.95
    for kernel in classify.KERNELS:
        model = classify.svm_classifier(df, kernel=kernel, size=80, max_iter=6, class_weight="balanced")
        scored = model.transform(df).select("label", F.col("prediction").cast("int").alias("pred"))
        assert evaluate.accuracy_kappa(evaluate.confusion_matrix(scored, "label", "pred"), "label", "pred").first()["accuracy"] > 0.9
    with pytest.raises(ValueError):
        classify.svm_classifier(df, kernel="sigmoid")


def test_grid_search_on_stratified_folds(spark):
    df = blobs(spark, corners=True).withColumnRenamed("v", "spectrum").coalesce(1).cache()
    folds = classify.stratified_folds(df, "emb_idx").groupBy("label", "fold").count().collect()
    assert len(folds) == 9 and {r["count"] for r in folds} <= {13, 14}
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", seed=1)
    found = classify.grid_search(df, forest, {"numTrees": [3], "maxDepth": [1, 4]}, "emb_idx")
    results = classify.grid_results(found)
    assert len(results) == 2 and results[0][1] >= results[1][1]
    best = classify.svm_grid_search(df, "emb_idx", grid={"C": [1], "gamma": ["scale"], "kernel": ["linear"]}, folds=2, max_iter=6)
    assert best[0][1] > 0.9


@pytest.mark.parametrize("p", [1, 2, 3])
def test_patch_models_for_any_tile(spark, p):
    rng = np.random.default_rng(p)
    cube, valid = rng.random((9, 11, 4)), rng.random((9, 11)) > 0.2
    before, after = (p // 2 - 1, p // 2) if p % 2 == 0 else (p // 2, p // 2)
    padded = np.pad(cube, ((before, after), (before, after), (0, 0)))
    weights = rng.normal(size=(3, 4, p, p))

    def model(x):
        return np.einsum("nbij,kbij->nk", x.reshape(len(x), 4, p, p), weights)

    want = np.full(valid.shape, -1)
    for r, c in zip(*np.nonzero(valid)):
        window = padded[r: r + p, c: c + p].transpose(2, 0, 1)
        want[r, c] = model(window[None]).argmax()
    for tile in (4, 64):
        got = infer.predict_patches(cube_df(spark, cube, valid), model, p, 9, 11, tile=tile, batch=7).collect()
        assert len(got) == 99
        for r in got:
            assert r["label"] == want[r["row"], r["col"]]


def test_contrastive_score_by_hand(spark):
    x = np.array([[1.0, 0.0], [0.8, 0.6], [0.0, 1.0], [0.6, 0.8]])
    df = spark.createDataFrame([(i // 2, i % 2, [float(v) for v in x[i]]) for i in range(4)], "pair_id long, view int, v array<double>")
    cos = x @ x.T
    got = {(r["pair_id"], r["view"]): r["loss"] for r in evaluate.masked_infonce(df, 10, temperature=0.5, threshold=0.7).collect()}
    for i in range(4):
        pos = i ^ 1
        used = [j for j in range(4) if j != i and (j == pos or not cos[i, j] > 0.7)]
        want = -np.log(np.exp(cos[i, pos] / 0.5) / sum(np.exp(cos[i, j] / 0.5) for j in used))
        assert np.isclose(got[(i // 2, i % 2)], want)
    with pytest.raises(Exception, match="twice"):
        evaluate.masked_infonce(df.union(df), 1).collect()


def test_reduced_points_carry_their_key(spark):
    cube = np.random.default_rng(11).random((5, 6, 4))
    points = spark.createDataFrame([(5, "s1", 105.0, 195.0), (2, "s1", 95000.0, 0.0), (9, "s1", 115.0, 185.0)],
                                   "fid long, scene_id string, x double, y double")
    got = plans.reduce_points(points, cube_df(spark, cube), GT, 5, 6, "PCA", 2).orderBy("emb_idx").collect()
    assert [(r["emb_idx"], r["fid"]) for r in got] == [(1, 5), (2, 9)]
    scores = {r["pix"]: r["scores"] for r in reduce.pca(cube_df(spark, cube), 2).collect()}
    assert np.allclose(got[1]["v"], scores[7])


def forest_rows(spark):
    """Labelled rows with noise, so that every setting gives another forest."""
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 150)
    x = rng.normal(size=(150, 5)) + y[:, None] * 0.8
    return spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "pix long, label int, spectrum array<double>").coalesce(1)


def test_nested_forests_equal_forests_of_their_own(spark):
    df = forest_rows(spark)
    data = search.folded_rows(df, "pix", "spectrum", "label", 2)

    def own(**setting):
        """Mean accuracy of forests that are fitted at one setting only."""
        forest = RandomForestClassifier(featuresCol="features", labelCol="_y", seed=42, **setting)
        ready, scores = search.fit_rows(data, 150), []
        for k in range(2):
            held = forest.fit(ready.filter(F.col("_fold") != k)).transform(ready.filter(F.col("_fold") == k))
            scores.append(held.agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0])
        return pytest.approx(np.mean(scores))

    grid = {"numTrees": [3, 7], "maxDepth": [30, 2], "minInstancesPerNode": [2], "featureSubsetStrategy": ["sqrt"]}
    table = search.forest_search(df, "pix", grid, (2, 20), folds=2).cache()
    got = {(r["numTrees"], r["maxDepth"], r["minSplit"]): r["accuracy"] for r in table.collect()}
    assert len(got) == 8
    # the largest setting is a forest of Spark's own
    assert got[7, 30, 2] == own(numTrees=7, maxDepth=30, minInstancesPerNode=2, featureSubsetStrategy="sqrt")
    # one tree on all features: a cut tree decides as the tree that stopped there
    grid = {"numTrees": [1], "maxDepth": [30, 1, 3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}
    for r in search.forest_search(df, "pix", grid, (2,), folds=2).collect():
        assert r["accuracy"] == own(numTrees=1, maxDepth=r["maxDepth"], featureSubsetStrategy="all")
    best = search.best_setting(table)
    assert got[best["numTrees"], best["maxDepth"], 2] == max(v for k, v in got.items() if k[2] == 2)
    assert search.best_forest(df, table).getNumTrees == best["numTrees"]


def test_nested_forests_against_a_walk_row_by_row(spark, tmp_path):
    df = classify.with_features(forest_rows(spark))
    RandomForestClassifier(featuresCol="features", labelCol="label", seed=1, maxDepth=9, numTrees=6).fit(df).write().save(str(tmp_path / "f"))
    table = search.forest_nodes(spark, str(tmp_path / "f")).orderBy("tree").toArrow()
    rows = df.collect()
    x, y = np.array([r["spectrum"] for r in rows]), np.array([r["label"] for r in rows])
    trees, depths, splits = [1, 4, 6], [2, 9], [2, 30]
    got = search.Forest(table.column("nodes")).hits(x, y, trees, depths, splits)

    def votes(nodes, row, d, s):
        at, depth = nodes[0], 0
        while at["feature"] >= 0 and depth < d and at["rows"] >= s:
            at, depth = nodes[at["left"] if row[at["feature"]] <= at["cut"] else at["right"]], depth + 1
        return np.array(at["stats"]) / sum(at["stats"])

    nodes = table.column("nodes").to_pylist()
    for t in trees:
        for d in depths:
            for s in splits:
                want = sum(int(np.argmax(sum(votes(n, row, d, s) for n in nodes[:t])) == c) for row, c in zip(x, y))
                assert got[t, d, s] == want


def in_order(nodes, at=0):
    """(feature, cut, stats) of a tree's nodes, left before right; nodes are (feature, cut, left, right, stats)."""
    feature, cut, left, right, stats = nodes[at]
    below = [] if feature < 0 else in_order(nodes, left) + in_order(nodes, right)
    return [(feature, cut if feature >= 0 else None, [float(n) for n in stats]), *below]


@pytest.mark.parametrize("leaf, depth, decimals", [(1, 30, 9), (3, 30, 1), (1, 3, 0)])
def test_trees_grown_in_tasks_are_trees_of_spark(spark, tmp_path, monkeypatch, leaf, depth, decimals):
    monkeypatch.setattr(forests, "FIRST_FEATURES", 2)
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 400)
    x = (rng.normal(size=(400, 6)) + 0.5 * y[:, None]).round(decimals)  # few decimals: ties, fewer values than bins
    x[:, 4] = 1.5
    df = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x)], "label int, spectrum array<double>").coalesce(1)
    fit = RandomForestClassifier(labelCol="label", numTrees=1, bootstrap=False, featureSubsetStrategy="all", maxDepth=depth, minInstancesPerNode=leaf, seed=1)
    fit.fit(classify.with_features(df)).write().save(str(tmp_path / "f"))
    spark_nodes = search.forest_nodes(spark, str(tmp_path / "f")).first()["nodes"]
    want = in_order([(n["feature"], n["cut"], n["left"], n["right"], n["stats"]) for n in spark_nodes])
    cuts = [forests.thresholds(*np.unique(x[:, j], return_counts=True)) for j in range(6)]
    bins = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(6)]).astype(np.uint8)
    for values in (1 << 17, 500):
        monkeypatch.setattr(forests, "SORT_VALUES", values)
        tree = forests.grow_tree(bins, y, np.ones(400, np.int64), 3, 6, leaf, depth)
        nodes = [(int(f), float(cuts[f][c]) if f >= 0 else None, int(left), int(left) + 1, n) for f, c, left, n in zip(*(tree[p] for p in search.PARTS))]
        assert in_order(nodes) == want and len(want) > 5


def test_draws_of_grown_trees():
    seen = np.concatenate([forests.repeats(np.arange(4000), t, 42) for t in range(5)])
    assert abs(seen.mean() - 1) < 0.03 and abs(seen.var() - 1) < 0.06 and abs((seen == 0).mean() - np.exp(-1)) < 0.02
    assert [forests.share_size(s, 64, 200) for s in ("sqrt", "log2", "all", "auto", "onethird", "0.5")] == [8, 6, 64, 8, 22, None]
    level = forests.Level(np.arange(900), np.ones(900, int), np.ones((2, 900), int), np.arange(1, 901, dtype=np.uint64))
    chosen = forests.node_features(level, 20, 5, 0, 42)
    assert chosen.shape == (900, 5) and all(len(set(row)) == 5 for row in chosen.tolist())
    shares = np.bincount(chosen.ravel(), minlength=20) / 900
    assert np.all(abs(shares - 0.25) < 0.07) and not np.array_equal(chosen, forests.node_features(level, 20, 5, 1, 42))


def test_search_in_tasks_equals_a_walk_row_by_row(spark, monkeypatch):
    """Forests of more rows are grown in tasks: no fit of Spark's, the same table however the rows lie."""
    df = forest_rows(spark)
    grid = {"numTrees": [3, 7], "maxDepth": [30, 2], "minInstancesPerNode": [1, 3], "featureSubsetStrategy": ["sqrt", "all"]}
    of_spark = {tuple(r)[:5]: r["accuracy"] for r in search.forest_search(df, "pix", grid, (2, 12), folds=2).collect()}
    monkeypatch.setattr(search, "SPARK_ROWS", 100)
    monkeypatch.setattr(search, "RandomForestClassifier", None)
    got = {tuple(r)[:5]: r["accuracy"] for r in search.forest_search(df, "pix", grid, (2, 12), folds=2).collect()}
    monkeypatch.setattr(search, "LOT_TREES", 2)
    monkeypatch.setattr(search, "BLOCK_ROWS", 20)
    assert got == {tuple(r)[:5]: pytest.approx(r["accuracy"]) for r in search.forest_search(df.repartition(5), "pix", grid, (2, 12), folds=2).collect()}
    assert got.keys() == of_spark.keys() and len(got) == 32
    assert abs(np.mean(list(got.values())) - np.mean(list(of_spark.values()))) < 0.05
    rows = [r.asDict() for r in search.folded_rows(df, "pix", "spectrum", "label", 2).collect()]

    def right(size, leaf, depth, trees, least):
        """Mean accuracy by walking one row at a time down trees grown on each fold's rows."""
        scores = []
        for fold in range(2):
            train, held = [[r for r in rows if (r["_fold"] == fold) == mine] for mine in (False, True)]
            x, y = np.array([r["_x"] for r in train]), np.array([r["_y"] for r in train])
            cuts = [forests.thresholds(*np.unique(x[:, j], return_counts=True)) for j in range(5)]
            bins = np.stack([np.searchsorted(cuts[j], x[:, j]) for j in range(5)]).astype(np.uint8)
            draws = outlier.mixed([r["_fold"] for r in train], [r["_i"] for r in train]).view(np.int64)
            grown = [forests.grow_tree(bins, y, forests.repeats(draws, t, 42), 3, size, leaf, 30, t, 42) for t in range(trees)]
            good = 0
            for r in held:
                votes = np.zeros(3)
                for tree in grown:
                    at = level = 0
                    while tree["feature"][at] >= 0 and level < depth and tree["stats"][at].sum() >= least:
                        f = tree["feature"][at]
                        at, level = tree["left"][at] + (r["_x"][f] > cuts[f][tree["cut"][at]]), level + 1
                    votes += tree["stats"][at] / tree["stats"][at].sum()
                good += int(votes.argmax() == r["_y"])
            scores.append(good / len(held))
        return pytest.approx(np.mean(scores))

    assert got[7, 30, 1, "sqrt", 2] == right(3, 1, 30, 7, 2)
    assert got[3, 2, 3, "all", 12] == right(5, 3, 2, 3, 12)
    assert got[7, 30, 3, "sqrt", 12] == right(3, 3, 30, 7, 12)


def test_nested_search_on_odd_tables(spark):
    df = forest_rows(spark)
    grid = {"numTrees": [2], "maxDepth": [2], "minInstancesPerNode": [1], "featureSubsetStrategy": ["all"]}
    assert search.forest_search(df.limit(0), "pix", grid).count() == 0
    odd = df.unionByName(spark.createDataFrame([(900, None, [0.0] * 5), (901, 1, None)], df.schema)).withColumn("_fold", F.lit(1))
    assert sorted(search.forest_search(odd, "pix", grid).collect()) == sorted(search.forest_search(df, "pix", grid).collect())
    with pytest.raises(ValueError):
        search.best_forest(df, search.forest_search(df.limit(0), "pix", grid))


def test_nodes_kept_beside_the_rows_give_the_same_search(spark, monkeypatch):
    df, asked = forest_rows(spark), []
    grid = {"numTrees": [2, 5], "maxDepth": [30, 3], "minInstancesPerNode": [1], "featureSubsetStrategy": ["sqrt", "all"]}

    def noted(**setting):
        asked.append(setting)
        return RandomForestClassifier(**setting)

    def carried(**setting):
        return RandomForestClassifier(**setting | {"cacheNodeIds": False})

    monkeypatch.setattr(search, "RandomForestClassifier", noted)
    kept = sorted(search.forest_search(df, "pix", grid, (2, 10), folds=2).collect())
    # tasks do not carry the trees, whose size would be added to every step
    assert len(asked) == 4 and all(setting["cacheNodeIds"] for setting in asked)
    monkeypatch.setattr(search, "RandomForestClassifier", carried)
    assert kept == sorted(search.forest_search(df, "pix", grid, (2, 10), folds=2).collect()) and len(kept) == 16


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_the_registered_search_asks_for_the_whole_grid(spark, monkeypatch):
    asked = []
    sizes = inspect.signature(search.forest_search)

    def note(*args, **named):
        full = sizes.bind(*args, **named)
        full.apply_defaults()
        asked.append(full.arguments)
        return spark.createDataFrame([(0.5,)], "accuracy double")

    monkeypatch.setattr(search, "forest_search", note)
    entry.queries()["grid_search"](spark, FOLDER)
    assert asked[0]["grid"] == classify.FOREST_GRID and asked[0]["folds"] == 3 and tuple(asked[0]["splits"]) == (2, 5, 10)


def test_bracketed_offsets_equal_exact_ones_and_no_row_is_copied_per_lot(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows = [(i, "a" if i < 700 else "b", np.round(rng.normal(size=3), 1).tolist()) for i in range(900)]
    df = spark.createDataFrame(rows, "fid long, layer string, spectrum array<double>").repartition(3)
    kept = []

    def counted(frame):
        kept.append(cut_lineage(frame))
        return kept[-1]

    exact = {r["fid"]: r["score"] for r in outlier.mc_isolation(df, 30, 0.2, trees=5).collect()}
    monkeypatch.setattr(outlier, "PILOT_ROWS", 300)
    monkeypatch.setattr(outlier, "LOT", 2)
    monkeypatch.setattr(outlier, "cut_lineage", counted)
    got = {r["fid"]: r["score"] for r in outlier.mc_isolation(df, 30, 0.2, trees=5).collect()}
    assert got.keys() == exact.keys() and all(np.isclose(got[k], exact[k], atol=1e-12) for k in got)
    # 15 lots of splits: rows leave once, with a few rows per split
    assert all(frame.count() <= 900 + 30 * 2 * 4 for frame in kept)


def test_quantile_of_distinct_values():
    values = np.sort(np.random.default_rng(3).integers(0, 40, 301) / 7.0)
    for share in (0.0, 0.1, 0.37, 1.0):
        low, high = outlier.bracket(values, share)
        held, counts = np.unique(values[(values >= low) & (values <= high)], return_counts=True)
        assert np.isclose(outlier.quantile_of(held, counts, int((values < low).sum()), 301, share), np.quantile(values, share))
    assert outlier.quantile_of(values[:3], np.ones(3, int), 0, 301, 0.5) is None

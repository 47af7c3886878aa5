import numpy as np
import pytest
from helpers import flood, grid_df, points_df, to_grid, to_mask
from pyspark.sql import functions as F

from cubeloom.operators import components, skeleton, stencil, tiles, vectorize
from cubeloom.plans import structure

GT = (100.0, 2.0, 0.0, 50.0, 0.0, -2.0)


def box(a, pick, before, after):
    out = np.empty_like(a)
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            out[r, c] = pick(a[max(0, r - before): r + after + 1, max(0, c - before): c + after + 1])
    return out


@pytest.mark.parametrize("tile", [4, 64])
def test_erode_dilate_match_brute_force(spark, tile):
    a = np.random.default_rng(1).integers(0, 2, (13, 11)).astype(float)
    df = grid_df(spark, a)
    assert np.array_equal(to_grid(stencil.erode(df, "v", 3, tile=tile), "v", a.shape), box(a, np.min, 1, 1))
    assert np.array_equal(to_grid(stencil.dilate(df, "v", 3, 2, tile=tile), "v", a.shape), box(a, np.max, 2, 2))
    # an even kernel reaches one pixel further back than forward
    assert np.array_equal(to_grid(stencil.dilate(df, "v", 4, tile=tile), "v", a.shape), box(a, np.max, 2, 1))


def test_erosion_is_dilation_of_the_complement(spark):
    a = np.random.default_rng(2).integers(0, 2, (9, 9)).astype(float)
    eroded = to_grid(stencil.erode(grid_df(spark, a), "v", 3), "v", a.shape)
    grown = to_grid(stencil.dilate(grid_df(spark, 1 - a), "v", 3), "v", a.shape)
    assert np.array_equal(eroded, 1 - grown)


def test_stencils_need_one_shuffle(spark):
    df = grid_df(spark, np.zeros((4, 4)))
    df.write.format("noop").mode("overwrite").save()
    plan = stencil.erode(spark.range(100).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), F.lit(1.0).alias("v")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "CartesianProduct" not in plan


def test_sobel_reflects_the_border(spark):
    a = np.random.default_rng(3).integers(0, 256, (6, 7)).astype(int)
    p = np.pad(a, 1, mode="reflect").astype(int)
    dx = np.zeros(a.shape, int)
    dy = np.zeros(a.shape, int)
    for i in range(3):
        for j in range(3):
            w = p[i: i + 6, j: j + 7]
            dx += w * (j - 1) * (2 if i == 1 else 1)
            dy += w * (i - 1) * (2 if j == 1 else 1)
    want = np.rint(0.5 * np.minimum(abs(dx), 255) + 0.5 * np.minimum(abs(dy), 255))
    want[want > 120] = 255
    got = to_grid(stencil.sobel_edge(grid_df(spark, a, kind="int"), "v", 120, tile=4), "edge", a.shape)
    assert np.array_equal(got, want)


def swt(a, low, high, level):
    """Periodic a-trous transform: output o takes input o + g*n/2 - g*j for tap j."""
    n = len(low)

    def taps(x, f, g, axis):
        return sum(w * np.roll(x, -(g * (n // 2) - g * j), axis) for j, w in enumerate(f))

    for j in range(level):
        g = 2**j
        lo, hi = taps(a, low, g, 0), taps(a, high, g, 0)
        h, v, d = taps(hi, low, g, 1), taps(lo, high, g, 1), taps(hi, high, g, 1)
        a = taps(lo, low, g, 1)
    return h, v, d


@pytest.mark.parametrize("wavelet", ["haar", "db2", "coif1", "bior2.2"])
def test_wavelet_details(spark, wavelet):
    a = np.random.default_rng(4).random((16, 24))
    want = swt(a, *stencil.WAVELETS[wavelet], 2)
    df = stencil.swt_details(grid_df(spark, a), 16, 24, 2, wavelet, tile=8)
    for name, w in zip("hvd", want):
        assert np.allclose(to_grid(df, name, a.shape), w, atol=1e-9)
    if wavelet == "haar":
        boxes = stencil.swt_details_haar(grid_df(spark, a), 16, 24, 2, tile=8)
        for name, w in zip("hvd", want):
            assert np.allclose(to_grid(boxes, name, a.shape), w, atol=1e-9)


def test_haar_alignment_by_hand(spark):
    # one level: (x[i] - x[i+1]) / sqrt(2) along each axis, periodic
    a = np.array([[1.0, 2.0], [4.0, 8.0]])
    df = stencil.swt_details_haar(grid_df(spark, a), 2, 2, 1)
    assert np.allclose(to_grid(df, "h", (2, 2)), [[-4.5, -4.5], [4.5, 4.5]])
    assert np.allclose(to_grid(df, "v", (2, 2)), [[-2.5, 2.5], [-2.5, 2.5]])
    assert np.allclose(to_grid(df, "d", (2, 2)), [[1.5, -1.5], [-1.5, 1.5]])


def test_wavelet_name_and_padding_errors(spark):
    with pytest.raises(ValueError):
        stencil.swt_details(grid_df(spark, np.zeros((4, 4))), 4, 4, 1, "nope")
    with pytest.raises(ValueError):
        stencil.edge_mask(grid_df(spark, np.zeros((4, 4))), 4, 4, top=2, bottom=2)
    with pytest.raises(ValueError):
        stencil.downsample(grid_df(spark, np.zeros((4, 4))), 4, 4, 2, "LANCZOS")


def test_negative_angles_are_kept_unless_wrapped(spark):
    rows = [(0, 0, 5.0, 0.0), (0, 1, 3.0, -0.1), (0, 2, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "row int, col int, m double, theta double")
    kept = {r["col"]: r["maxima"] for r in stencil.modulus_maxima(df).collect()}
    assert kept == {0: 5.0, 1: 3.0, 2: 0.0}
    wrapped = {r["col"]: r["maxima"] for r in stencil.modulus_maxima(df, wrap_angle=True).collect()}
    assert wrapped[1] == 0.0


def test_downsample_cubic_of_a_plane(spark):
    a = np.add.outer(np.arange(16.0), 2 * np.arange(12.0))
    got = to_grid(stencil.downsample(grid_df(spark, a), 16, 12, 2, "CUBIC"), "v", (8, 6))
    centre = np.add.outer(2 * np.arange(8) + 0.5, 2 * (2 * np.arange(6) + 0.5))
    assert np.allclose(got[1:-1, 1:-1], centre[1:-1, 1:-1])
    assert np.array_equal(to_grid(stencil.downsample(grid_df(spark, a), 16, 12, 4), "v", (4, 3)), a[::4, ::4])


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_match_flood_fill(spark, connectivity):
    mask = np.random.default_rng(5).random((20, 23)) < 0.5
    got = components.connected_components(points_df(spark, mask), 23, connectivity, tile=6)
    assert np.array_equal(to_grid(got, "label", mask.shape, -1), flood(mask, connectivity))


def test_components_of_a_spiral_across_tiles(spark):
    mask = np.zeros((15, 15), bool)
    top, left, bottom, right = 0, 0, 14, 14
    r = c = 0
    for ring in range(0, 7, 2):
        mask[ring, ring: 15 - ring] = True
        mask[ring: 15 - ring, 14 - ring] = True
        mask[14 - ring, ring: 15 - ring] = True
        mask[ring + 2: 15 - ring, ring] = True
        mask[ring + 2, ring: ring + 3] = True
    got = components.connected_components(points_df(spark, mask), 15, 4, tile=4)
    assert np.array_equal(to_grid(got, "label", mask.shape, -1), flood(mask, 4))


def test_equal_value_components(spark):
    v = np.random.default_rng(6).integers(1, 3, (12, 12))
    got = components.connected_components(grid_df(spark, v, kind="int"), 12, 4, "v", tile=5)
    assert np.array_equal(to_grid(got, "label", v.shape), flood(np.ones_like(v, bool), 4, v))


def test_small_objects_and_holes(spark):
    a = np.zeros((7, 7), int)
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    a[0, 6] = 1
    df = grid_df(spark, a, "bin", "int")
    assert to_grid(components.remove_small_objects(df, 7, 2), "bin", a.shape)[0, 6] == 0
    filled = to_grid(components.remove_small_holes(df, 7, 2), "bin", a.shape)
    assert filled[3, 3] == 1 and filled.sum() == a.sum() + 1
    with pytest.raises(ValueError):
        components.connected_components(df, 7, 6)


def thin(image):
    while True:
        after = skeleton.thin_once(image)
        if np.array_equal(after, image):
            return image
        image = after


def test_skeleton_is_the_same_for_any_tile(spark):
    rng = np.random.default_rng(7)
    mask = box((rng.random((30, 34)) < 0.08).astype(float), np.max, 2, 2) > 0
    want = thin(mask)
    for tile, iterations in ((64, 16), (8, 2)):
        got = to_mask(skeleton.skeletonize(points_df(spark, mask), tile=tile, iterations=iterations), mask.shape)
        assert np.array_equal(got, want)


def test_skeleton_of_a_bar(spark):
    mask = np.zeros((7, 15), bool)
    mask[2:5, 2:13] = True
    got = to_mask(skeleton.skeletonize(points_df(spark, mask)), mask.shape)
    assert set(np.nonzero(got)[0]) == {3} and got.sum() >= 8


def test_prune_takes_the_branch_pixel(spark):
    # a T: long bar, stem of two pixels below its middle
    mask = np.zeros((7, 15), bool)
    mask[2, 1:14] = True
    mask[3:5, 7] = True
    assert to_grid(skeleton.neighbour_counts(points_df(spark, mask)), "degree", mask.shape)[2, 1] == 1
    pruned = to_mask(skeleton.prune_branches(points_df(spark, mask), 15, 4, tile=5), mask.shape)
    assert not pruned[3:5, 7].any()
    # the walk stops at the first pixel with more than two neighbours, which goes too
    assert not pruned[3, 7] and pruned[2, 1] and pruned[2, 13]
    assert np.array_equal(to_mask(skeleton.prune_branches(points_df(spark, mask), 15, 1), mask.shape), mask)


def test_isolated_short_line_is_removed_and_dot_stays(spark):
    mask = np.zeros((6, 9), bool)
    mask[1, 1:4] = True
    mask[4, 7] = True
    pruned = to_mask(skeleton.prune_branches(points_df(spark, mask), 9, 5), mask.shape)
    assert pruned.sum() == 1 and pruned[4, 7]


def test_walks_are_ordered_across_groups(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    numbers = rng.permutation(400)
    cycles, at = [], 0
    for size in (1, 2, 3, 57, 120):
        cycles.append(numbers[at: at + size].tolist())
        at += size
    walk = [(a, c[(i + 1) % len(c)], int(g)) for c in cycles for i, (a, g) in enumerate(zip(c, rng.integers(0, 4, len(c))))]

    def cut(pdf):
        return vectorize.walk_pieces(pdf["state"].to_numpy(), pdf["next"].to_numpy())

    df = spark.createDataFrame(walk, "state long, next long, g long")
    states = df.groupBy("g").applyInPandas(cut, vectorize.WALK_SCHEMA)
    got = {r["state"]: (r["cycle"], r["pos"]) for r in vectorize.order_walks(states).collect()}
    assert isinstance(cut(pd.DataFrame({"state": [4], "next": [4]})), pd.DataFrame) and len(got) == at
    for c in cycles:
        first = c.index(min(c))
        for i, a in enumerate(c[first:] + c[:first]):
            assert got[a] == (min(c), i)


def test_lines_follow_a_path_out_and_back(spark):
    mask = np.zeros((5, 8), bool)
    mask[2, 1:6] = True
    lines = vectorize.skeleton_to_lines(points_df(spark, mask), 8, GT, tile=4).orderBy("id", "seq").collect()
    assert len({r["id"] for r in lines}) == 1 and len(lines) == 8
    assert {(r["row"], r["col"]) for r in lines} == {(2, c) for c in range(1, 6)}
    for a, b in zip(lines, lines[1:]):
        assert abs(a["row"] - b["row"]) <= 1 and abs(a["col"] - b["col"]) <= 1
    assert lines[0]["x"] == GT[0] + lines[0]["col"] * 2.0


@pytest.mark.parametrize("part", [[(0, 0), (0, 1), (1, 0)], [(0, 0), (0, 1), (1, 1)], [(0, 1), (1, 0), (1, 1)], [(0, 0), (1, 0), (1, 1)]])
def test_a_part_of_three_pixels_is_one_line(spark, part):
    mask = np.zeros((6, 6), bool)
    for r, c in part:
        mask[r + 2, c + 2] = True
    lines = vectorize.skeleton_to_lines(points_df(spark, mask), 6, GT, tile=4).collect()
    assert len({x["id"] for x in lines}) == 1
    assert {(x["row"] - 2, x["col"] - 2) for x in lines} == set(part) and len(lines) == 3


def test_polygons_with_a_hole(spark):
    a = np.zeros((7, 7), int)
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    a[3, 4] = 2
    regions, rings = vectorize.polygonize(grid_df(spark, a, "label", "int"), 7, GT, names={1: "one"}, tile=3)
    got = {r["value"]: r for r in regions.collect()}
    assert got[1]["area"] == 23 and got[1]["perimeter"] == 20 + 6 and got[1]["name"] == "one"
    assert got[2]["area"] == 1 and got[2]["perimeter"] == 4 and got[2]["name"] is None
    parts = rings.orderBy("ring", "seq").collect()
    outer = [(r["x"], r["y"]) for r in parts if r["region"] == 8 and not r["hole"]]
    inner = [(r["x"], r["y"]) for r in parts if r["region"] == 8 and r["hole"]]
    assert len(outer) == 4 and set(outer) == {(102.0, 48.0), (112.0, 48.0), (112.0, 38.0), (102.0, 38.0)}
    assert len(inner) == 4

    def area(ring):
        return sum(x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1])) / 2

    assert abs(area(outer)) == 100.0 and abs(area(inner)) == 8.0 and area(outer) * area(inner) < 0


def test_diagonal_cells_are_separate_polygons(spark):
    a = np.array([[1, 0], [0, 1]])
    regions, rings = vectorize.polygonize(grid_df(spark, a, "label", "int"), 2, GT)
    assert regions.count() == 2 and rings.select("ring").distinct().count() == 2


def test_closing_fills_a_gap_between_equal_classes(spark):
    a = np.zeros((5, 9), int)
    a[1:4, 1:4] = 1
    a[1:4, 5:8] = 1
    closed = to_grid(vectorize.close_classes(grid_df(spark, a, "label", "int"), 1, tile=4), "label", a.shape)
    assert closed[2, 4] == 1 and closed[0].sum() == 0
    regions, _ = vectorize.smooth_polygons(grid_df(spark, a, "label", "int"), 9, GT, 1)
    assert regions.count() == 1


def test_batch_clean_matches_its_steps(spark):
    rng = np.random.default_rng(8)
    a = (box((rng.random((40, 40)) < 0.05).astype(float), np.max, 3, 3)).astype(int)
    got = to_grid(structure.batch_clean(grid_df(spark, a, "bin", "int"), 40, 40, 1, 2, 3, 4, 30, 10), "bin", a.shape)
    b = np.zeros_like(a)
    b[1:38, 3:36] = a[1:38, 3:36]

    def drop(x, area, value):
        labels = flood(x == value, 4)
        for name in np.unique(labels[labels >= 0]):
            if (labels == name).sum() < area:
                x = np.where(labels == name, 1 - value, x)
        return x

    b = drop(drop(b, 30, 1), 10, 0)
    b = drop(box(b, np.min, 2, 2), 30, 1)
    assert np.array_equal(got, box(b, np.max, 2, 2))


def test_halo_tiles_cover_every_neighbourhood(spark):
    df = grid_df(spark, np.zeros((10, 10)))
    copies = tiles.halo_tiles(df, 4, 1, 2, 10, 10).collect()
    assert sum(r["core"] for r in copies) == 100
    for r in copies:
        assert r["tile_row"] * 4 - 1 <= r["row"] <= r["tile_row"] * 4 + 5
    with pytest.raises(ValueError):
        tiles.tile_assign(df, "4", 10, 10)


def test_canny_keeps_weak_pixels_linked_to_strong_ones(spark):
    a = np.zeros((9, 20), int)
    for c in range(20):
        a[5:, c] = 30 + 8 * c
    edges = to_mask(structure.canny_edge(grid_df(spark, a, kind="int"), 20, 200, 500), a.shape)
    assert edges[4:6, 8:19].any(axis=0).all() and not edges[:3].any()


def test_scenes_do_not_merge(spark):
    from cubeloom.operators.polygons import polygon_clip
    from cubeloom.plans import scenes as plans

    sizes = spark.createDataFrame([("a", 4), ("b", 3)], "scene_id string, rows int")
    cells = [("a", r, c, 1) for r in (0, 1) for c in (0, 1)] + [("b", r, c, 1) for r in (0, 1, 2) for c in (0, 1)]
    classes = spark.createDataFrame(cells, "scene_id string, row int, col int, label int")
    regions, rings = plans.polygonize_scenes(classes, sizes, 5, GT, tile=3)
    assert {(r["scene_id"], r["region"], r["area"], r["perimeter"]) for r in regions.collect()} == {("a", 0, 4, 8), ("b", 0, 6, 10)}
    alone = vectorize.polygonize(classes.filter("scene_id = 'b'").drop("scene_id"), 5, GT, tile=3)[1]
    key = ("region", "ring", "hole", "seq", "x", "y")
    assert sorted(tuple(r[k] for k in key) for r in rings.filter("scene_id = 'b'").collect()) == sorted(tuple(r[k] for k in key) for r in alone.collect())
    path = spark.createDataFrame([(s, 1, c) for s in "ab" for c in (1, 2, 3)], "scene_id string, row int, col int")
    lines = plans.lines_of_scenes(path, sizes, 5, GT, tile=3).collect()
    one = vectorize.skeleton_to_lines(path.filter("scene_id = 'a'").drop("scene_id"), 5, GT, tile=3).collect()
    for s in "ab":
        assert sorted((r["id"], r["seq"], r["row"], r["col"], r["y"]) for r in lines if r["scene_id"] == s) == sorted((r["id"], r["seq"], r["row"], r["col"], r["y"]) for r in one)
    grid = classes.withColumn("v", F.when(F.col("scene_id") == "a", 1.0).otherwise(2.0))
    assert {(r["scene_id"], r["v"]) for r in stencil.downsample(grid, 4, 2, 2, "NEAREST", keys=["scene_id"]).collect()} == {("a", 1.0), ("b", 2.0)}
    pixels = classes.withColumn("spectrum", F.array(F.lit(5.0)))
    clipped = polygon_clip(pixels, classes.filter("scene_id = 'a'"), keys=["scene_id"]).groupBy("scene_id").agg(F.max("inside").alias("i")).collect()
    assert {(r["scene_id"], r["i"]) for r in clipped} == {("a", True), ("b", False)}

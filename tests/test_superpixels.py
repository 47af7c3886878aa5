"""Superpixels against a plain loop, and islands that join their neighbours."""

import numpy as np
import pytest

from cubeloom.operators import superpixels
from tests.helpers import cube_df, flood, grid_df, to_grid


def plain(cube, valid, n_segments, compactness, rounds):
    rows, cols, _ = cube.shape
    step = max(1.0, (rows * cols / n_segments) ** 0.5)
    grid = max(1, round(rows / step)), max(1, round(cols / step))
    scale = compactness / 100 / step
    at = [(r, c) for r in range(rows) for c in range(cols) if valid[r, c]]
    cell = {(r, c): (min(r * grid[0] // rows, grid[0] - 1), min(c * grid[1] // cols, grid[1] - 1)) for r, c in at}
    x = {(r, c): np.array([r * scale, c * scale, *cube[r, c]]) for r, c in at}
    centres = {}
    for g in sorted(set(cell.values())):
        middle = [(g[i] + 0.5) * n / grid[i] for i, n in enumerate((rows, cols))]
        inside = [p for p in at if cell[p] == g]
        centres[g] = x[min(inside, key=lambda p: ((p[0] + 0.5 - middle[0]) ** 2 + (p[1] + 0.5 - middle[1]) ** 2, p))]

    def nearest(p):
        near = [(((centres[g] - x[p]) ** 2).sum(), g) for g in centres if max(abs(g[0] - cell[p][0]), abs(g[1] - cell[p][1])) <= 1]
        return min(near)[1]

    for _ in range(rounds):
        owner = {p: nearest(p) for p in at}
        for g in centres:
            mine = [x[p] for p in at if owner[p] == g]
            centres[g] = np.mean(mine, axis=0) if mine else centres[g]
    seg = np.zeros((rows, cols), int)
    for p in at:
        g = nearest(p)
        seg[p] = g[0] * grid[1] + g[1] + 1
    return seg


@pytest.mark.parametrize("compactness", [0.5, 60.0])
def test_superpixels_equal_a_plain_loop(spark, compactness):
    rng = np.random.default_rng(3)
    cube, valid = rng.random((11, 14, 2)), rng.random((11, 14)) > 0.25
    valid[:4, :4] = False  # a cell without pixels, and cells whose middle is masked
    df = cube_df(spark, cube, valid).filter("valid")
    got = superpixels.slic(df, "spectrum", 11, 14, 9, compactness, rounds=3, connected=False)
    want = plain(cube, valid, 9, compactness, 3)
    assert np.array_equal(to_grid(got, "seg", valid.shape), want)
    whole = to_grid(superpixels.slic(df, "spectrum", 11, 14, 9, compactness, rounds=3), "seg", valid.shape).astype(int)
    assert np.array_equal(whole > 0, valid)
    pieces = flood(valid, 4, whole)
    for s in np.unique(whole[valid]):
        assert len(np.unique(pieces[whole == s])) == 1
    # the largest piece of every segment keeps its pixels
    before = flood(valid, 4, want)
    for s in np.unique(want[valid]):
        names, sizes = np.unique(before[want == s], return_counts=True)
        assert (whole[before == names[sizes.argmax()]] == s).all()


def test_islands_join_the_longest_border_and_chains_follow(spark):
    seg = np.array(
        [
            [1, 1, 1, 1, 2, 2],
            [1, 2, 3, 1, 2, 2],
            [1, 1, 1, 1, 2, 2],
            [0, 0, 0, 0, 2, 2],
            [3, 3, 3, 0, 2, 2],
            [0, 0, 0, 0, 0, 0],
            [0, 1, 0, 3, 0, 2],
        ]
    )
    df = grid_df(spark, seg, "seg", "int").filter("seg > 0")
    got = to_grid(superpixels.join_islands(df, 6), "seg", seg.shape).astype(int)
    want = seg.copy()
    want[1, 1] = want[1, 2] = 1
    assert np.array_equal(got[:6], want[:6])
    # pieces that touch nothing are segments of their own
    assert sorted(got[6][seg[6] > 0]) == [4, 5, 6]
    # an island behind an island follows it
    ring = np.array([[1, 1, 1, 1, 1, 1, 1], [1, 2, 2, 2, 2, 2, 1], [1, 2, 3, 3, 3, 2, 1], [1, 2, 2, 2, 2, 2, 1], [1, 1, 1, 1, 1, 1, 1],
                     [0] * 7, [2] * 7, [2] * 7, [0] * 7, [3] * 7])
    # two pieces of 2 with 14 pixels each would tie; the upper ring is smaller by its hole
    chain = to_grid(superpixels.join_islands(grid_df(spark, ring, "seg", "int").filter("seg > 0"), 7), "seg", ring.shape)
    assert (chain[:5] == 1).all() and (chain[6:8] == 2).all() and (chain[9] == 3).all()
    assert superpixels.join_islands(df.filter("false"), 6).count() == 0


def test_empty_and_single(spark):
    df = cube_df(spark, np.ones((2, 2, 1)))
    assert superpixels.slic(df.filter("false"), "spectrum", 2, 2).count() == 0
    assert {r["seg"] for r in superpixels.slic(df, "spectrum", 2, 2, 1).collect()} == {1}
    with pytest.raises(ValueError):
        superpixels.slic(df, "spectrum", 2, 2, 0)

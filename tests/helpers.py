"""Small scenes and brute-force twins used by the tests (not shipped)."""

import numpy as np


def grid_df(spark, a, name="v", kind="double", parts=3):
    rows = [(int(r), int(c), a[r, c].item()) for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, f"row int, col int, {name} {kind}").repartition(parts)


def points_df(spark, mask, parts=3):
    rows = [(int(r), int(c)) for r, c in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows, "row int, col int").repartition(parts)


def cube_df(spark, cube, valid=None, parts=3, scene="s1"):
    rows, cols, _ = cube.shape
    valid = np.ones((rows, cols), bool) if valid is None else valid
    data = [
        (scene, r * cols + c, r, c, [float(x) for x in cube[r, c]], bool(valid[r, c]))
        for r in range(rows)
        for c in range(cols)
    ]
    return spark.createDataFrame(data, "scene_id string, pix long, row int, col int, spectrum array<double>, valid boolean").repartition(parts)


def to_grid(df, name, shape, fill=0):
    out = np.full(shape, fill, dtype=float)
    for r in df.select("row", "col", name).collect():
        out[r["row"], r["col"]] = r[name]
    return out


def to_mask(df, shape):
    out = np.zeros(shape, bool)
    for r in df.select("row", "col").collect():
        out[r["row"], r["col"]] = True
    return out


def flood(mask, connectivity, value=None):
    """Labels by flood fill: smallest flat index of each component, -1 outside."""
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    if connectivity == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    labels = np.full(mask.shape, -1)
    for r, c in zip(*np.nonzero(mask)):
        if labels[r, c] >= 0:
            continue
        name, stack = r * mask.shape[1] + c, [(r, c)]
        labels[r, c] = name
        while stack:
            y, x = stack.pop()
            for dy, dx in steps:
                j, i = y + dy, x + dx
                if 0 <= j < mask.shape[0] and 0 <= i < mask.shape[1] and mask[j, i] and labels[j, i] < 0:
                    if value is None or value[j, i] == value[y, x]:
                        labels[j, i] = name
                        stack.append((j, i))
    return labels

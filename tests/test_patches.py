"""Patches cut in halo tiles: tile borders, shared pixels, centres outside, and the plan."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.operators import moments, patches, reduce
from tests.helpers import cube_df


def test_patches_over_tile_borders_and_shared_pixels(spark, monkeypatch):
    cube = np.random.default_rng(2).random((9, 10, 2))
    places = [(0, 0), (4, 5), (4, 5), (8, 9), (-1, 3), (30, 30), (5, None)]
    centres = spark.createDataFrame([(i, "s1", r, c) for i, (r, c) in enumerate(places)], "fid int, scene_id string, row int, col int")
    for p in (2, 3, 4):
        monkeypatch.setattr(patches, "PATCH_BYTES", 8 * p * p * 2 * 9)  # tiles of 3 x 3 pixels
        got = {r["fid"]: r for r in patches.patch_gather(centres, cube_df(spark, cube), p, ["fid"], fill=-1.0).collect()}
        assert sorted(got) == [0, 1, 2, 3, 4, 5]
        before = p // 2 - 1 if p % 2 == 0 else p // 2
        wide = np.full((60, 60, 2), -1.0)
        wide[10:19, 10:20] = cube
        for fid, r in got.items():
            y, x = places[fid][0] + 10 - before, places[fid][1] + 10 - before
            window = wide[y : y + p, x : x + p]
            assert np.array_equal(np.array(r["cube"]).reshape(2, p, p), window.transpose(2, 0, 1))
            assert r["n_inside"] == (window[..., 0] >= 0).sum()


def test_spectra_are_shuffled_once(spark):
    cube = np.ones((4, 4, 2))
    df = cube_df(spark, cube)
    gathered = patches.patch_gather(df.select("scene_id", "row", "col"), df, 3, bands=2)
    plan = gathered._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "collect_list" not in plan
    assert patches.patch_gather(df.filter("false").select("scene_id", "row", "col"), df, 3, bands=2).count() == 0


def test_wide_vectors_reach_functions_in_slices(spark, monkeypatch):
    monkeypatch.setattr(moments, "SLICE_BYTES", 8 * 50 * 7)
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array([[float(i)] * 50 for i in range(20)])], names=["i", "v"])
    parts = list(moments.vector_slices(iter([batch, batch.slice(0, 0)]), "v"))
    assert [p.num_rows for p in parts] == [7, 7, 6]
    assert moments.matrix_of(parts[1].column("v"))[:, 0].tolist() == [7, 8, 9, 10, 11, 12, 13]


def test_functions_over_cubes_see_few_patches_at_once(spark):
    """One batch of wide cubes; the function tells how many it was given."""
    df = spark.range(0, 600, 1, 1).withColumn("cube", F.array_repeat(F.col("id").cast("double"), 8000))
    seen = reduce.map_vectors(df, "cube", "n", lambda x: np.full(len(x), float(len(x))), T.DoubleType()).select("id", "n").collect()
    assert sorted(r["id"] for r in seen) == list(range(600)) and max(r["n"] for r in seen) * 64_000 <= moments.SLICE_BYTES
    flipped = patches.map_cubes(df, None, lambda x, _: x + len(x) * 0.0).agg(F.sum(F.element_at("cube", 1))).first()[0]
    assert flipped == sum(range(600))

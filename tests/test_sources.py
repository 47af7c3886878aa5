import numpy as np
import pytest
from helpers import cube_df
from pyspark.sql import functions as F

from cubeloom.sources import envi, files, raster
from cubeloom.sources import scene as scenes

GT = (100.0, 10.0, 0.0, 200.0, 0.0, -10.0)


def write_cube(path, cube, code, interleave, extra=""):
    rows, cols, bands = cube.shape
    order = {"bsq": (2, 0, 1), "bil": (0, 2, 1), "bip": (0, 1, 2)}[interleave]
    path.write_bytes(np.ascontiguousarray(cube.transpose(order)).tobytes())
    path.with_suffix(".hdr").write_text(
        f"ENVI\ndescription = {{\n  test }}\nsamples = {cols}\nlines = {rows}\nbands = {bands}\nheader offset = 0\n"
        f"data type = {code}\ninterleave = {interleave}\nbyte order = 0\n{extra}"
    )


@pytest.mark.parametrize("interleave", ["bsq", "bil", "bip"])
def test_envi_cube_by_strips(spark, tmp_path, interleave):
    cube = np.random.default_rng(1).integers(-50, 9000, (7, 5, 3)).astype("<i2")
    cube[2, 1] = 0
    write_cube(tmp_path / "a.dat", cube, 2, interleave)
    df = envi.read_envi(spark, str(tmp_path / "a.dat"), strip_bytes=5 * 3 * 2 * 2)
    assert df.rdd.getNumPartitions() == 4
    got = df.orderBy("row", "col").collect()
    assert np.allclose([r["spectrum"] for r in got], cube.reshape(-1, 3) * 1e-4, atol=1e-6)
    assert [r["valid"] for r in got].count(False) == 1 and got[0]["scene_id"] == "a"
    raw = envi.read_envi(spark, str(tmp_path / "a.dat"), scale=1).orderBy("row", "col").first()
    assert raw["spectrum"] == [float(v) for v in cube[0, 0]]


def test_envi_header_details_and_errors(spark, tmp_path):
    cube = np.ones((2, 2, 1), dtype="<f4")
    write_cube(tmp_path / "b.dat", cube, 4, "bsq", "data ignore value = 1\nmap info = {UTM, 1, 1, 500000, 4000000, 30, 30}\n")
    head = envi.CubeHeader.read(str(tmp_path / "b.hdr"))
    assert head.gt == (500000.0, 30.0, 0.0, 4000000.0, 0.0, -30.0) and head.nodata == 1.0
    assert envi.read_envi(spark, str(tmp_path / "b.dat")).filter("valid").count() == 0
    write_cube(tmp_path / "c.dat", cube, 6, "bsq")
    with pytest.raises(ValueError):
        envi.CubeHeader.read(str(tmp_path / "c.hdr"))
    with pytest.raises(FileNotFoundError):
        envi.header_path(str(tmp_path / "none.dat"))


def test_envi_round_trip_in_strips(spark, tmp_path):
    cube = np.random.default_rng(2).random((10, 6, 4)).astype("f4")
    envi.write_envi(cube_df(spark, cube), str(tmp_path / "out"), 6, GT, strip=4)
    assert len(list((tmp_path / "out").glob("*.dat"))) == 3
    back = envi.read_envi(spark, str(tmp_path / "out"), scene_id="s1").orderBy("row", "col").collect()
    assert np.allclose([r["spectrum"] for r in back], cube.reshape(-1, 4), atol=1e-6)
    assert [(r["row"], r["col"]) for r in back] == [(r, c) for r in range(10) for c in range(6)]


def test_pixel_table_prunes_windows(spark, tmp_path):
    cube = np.random.default_rng(3).random((16, 16, 2))
    scenes.write_pixels(cube_df(spark, cube), str(tmp_path / "px"), tile=4)
    pixels = scenes.read_pixels(spark, str(tmp_path / "px"))
    window = scenes.scan_window(pixels.filter("scene_id = 's1'"), 4, 8, 3, 2)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert window.count() == 6 and "PushedFilters: [IsNotNull(row)" in plan and "PartitionFilters: [isnotnull(scene_id" in plan


def test_int16_pixels_are_scaled_on_read(spark, tmp_path):
    rows = [("s", 0, 0, [0, 0]), ("s", 0, 1, [5000, 10])]
    spark.createDataFrame(rows, "scene_id string, row int, col int, spectrum array<smallint>").write.parquet(str(tmp_path / "p"))
    scene = scenes.Scene("s", 1, 2, 2, GT, dtype="int16")
    got = scenes.read_pixels(spark, str(tmp_path / "p"), scene).orderBy("col").collect()
    assert [r["valid"] for r in got] == [False, True] and np.allclose(got[1]["spectrum"], [0.5, 0.001])
    assert scenes.read_pixels(spark, str(tmp_path / "p"), scene, scale=1).orderBy("col").collect()[1]["spectrum"] == [5000, 10]


def test_raster_sinks(spark, tmp_path):
    sparse = spark.createDataFrame([(0, 1, 3), (2, 2, 4)], "row int, col int, label int")
    grid = raster.dense_grid(sparse, 3, 4, -1)
    assert grid.count() == 12 and grid.filter("label = -1").count() == 10
    masked = raster.dense_grid(sparse, 3, 4, 0, mask=sparse.filter("row = 0"))
    assert masked.filter("label <> 0").count() == 1
    scene = scenes.Scene("s", 3, 4, 2, GT, "wkt", -1.0)
    raster.sink_raster(grid, str(tmp_path / "r"), scene, "int16", factor=2)
    back, header = raster.read_raster(spark, str(tmp_path / "r"))
    assert back.count() == 12 and header.first()["gt"][1] == 20.0 and header.first()["srs"] == "wkt"
    with pytest.raises(ValueError):
        raster.sink_raster(grid, str(tmp_path / "x"), scene, "int8")
    raster.sink_palette_raster(grid, str(tmp_path / "pal"), scene)
    assert spark.read.parquet(str(tmp_path / "pal" / "palette")).count() == 6


def test_points_by_class_and_matrix(spark, tmp_path):
    points = spark.createDataFrame([(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 1)], "fid long, x double, class int")
    raster.sink_points_by_class(points, str(tmp_path / "pts"))
    assert sorted(p.name for p in (tmp_path / "pts").glob("class=*")) == ["class=0", "class=1"]
    features = spark.createDataFrame([(2, [0.5, -1.25]), (1, [3.0, 4.0])], "emb_idx long, v array<double>")
    files.sink_matrix(features, str(tmp_path / "m"), 2)
    back = files.scan_matrix(spark, str(tmp_path / "m")).orderBy("emb_idx").collect()
    assert [(r["emb_idx"], r["v"]) for r in back] == [(1, [3.0, 4.0]), (2, [0.5, -1.25])]
    with pytest.raises(ValueError):
        files.matrix_lines(points.withColumn("v", F.lit(1)), 1, ident="fid")


def test_sample_lists_and_packing(spark, tmp_path):
    samples = spark.createDataFrame([("/a/x.tif", 3), ("/a/y.tif", None)], "path string, label int")
    files.sink_sample_list(samples, str(tmp_path / "list"))
    back = files.scan_sample_list(spark, str(tmp_path / "list")).orderBy("path").collect()
    assert [(r["path"], r["label"]) for r in back] == [("/a/x.tif", 3), ("/a/y.tif", None)]
    moved = files.scan_sample_list(spark, str(tmp_path / "list"), rebase=True).orderBy("path").first()
    assert moved["path"] == f"{tmp_path}/x.tif"
    patches = samples.select("path", F.array(F.lit(1.0)).alias("cube"))
    files.pack_samples(samples, patches, str(tmp_path / "packed"))
    assert spark.read.parquet(str(tmp_path / "packed")).count() == 2


def test_listing(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for name in ("a.tif", "b.txt", "e/c.tif", "e/d.dat"):
        (tmp_path / "d" / name).write_text("x")
    found = {r["path"].rsplit("/", 1)[1] for r in files.scan_files(spark, str(tmp_path / "d"), (".tif", ".dat")).collect()}
    assert found == {"a.tif", "c.tif", "d.dat"}
    with pytest.raises(ValueError):
        files.scan_files(spark, str(tmp_path), [".tif"])

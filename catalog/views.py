"""The scene, grid, point and polygon views, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import view
from cubeloom.sources.scene import Scene

GT = (500000.0, 30.0, 0.0, 4000000.0, 0.0, -30.0)
COLS = 25
GRID_COLS = 100
BANDS = 64


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def px(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    valid = F.col("vec_id") % 17 != 0
    doubles = F.col("embedding").cast("array<double>")
    return e.select(
        F.lit("s1").alias("scene_id"),
        F.col("vec_id").alias("pix"),
        F.floor(F.col("vec_id") / COLS).cast("int").alias("row"),
        (F.col("vec_id") % COLS).cast("int").alias("col"),
        "label",
        valid.alias("valid"),
        F.when(valid, doubles).otherwise(F.transform("embedding", lambda x: F.lit(0.0))).alias("spectrum"),
    )


view(
    "px",
    """SELECT vec_id AS pix, CAST(vec_id // 25 AS INT) AS row, CAST(vec_id % 25 AS INT) AS col, label, vec_id % 17 <> 0 AS valid,
 [CASE WHEN vec_id % 17 = 0 THEN 0::DOUBLE ELSE x::DOUBLE END FOR x IN embedding] AS spectrum FROM embeddings""",
)
view("lng", "SELECT pix, row, col, label, valid, CAST(i - 1 AS INT) AS band, spectrum[i] AS v FROM (SELECT *, unnest(range(1, 65)) AS i FROM px)", "px")
view("lv", "SELECT * FROM lng WHERE valid", "lng")
view("dim", "SELECT CAST(max(row) + 1 AS INT) AS nrows, 25 AS ncols FROM px", "px")


def gridv(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("value")
    return table(spark, d, "events").select(
        F.floor(F.col("event_id") / GRID_COLS).cast("int").alias("row"),
        (F.col("event_id") % GRID_COLS).cast("int").alias("col"),
        value.alias("v"),
        (F.col("event_type") != "error").alias("valid"),
        (value > 60).cast("int").alias("bin"),
        (value > 2).cast("int").alias("bin_lo"),
        (value > 150).cast("int").alias("bin_hi"),
    )


view(
    "gridv",
    """SELECT CAST(event_id // 100 AS INT) AS row, CAST(event_id % 100 AS INT) AS col, value AS v, event_type <> 'error' AS valid,
 CAST(value > 60 AS INT) AS bin, CAST(value > 2 AS INT) AS bin_lo, CAST(value > 150 AS INT) AS bin_hi FROM events""",
)
view("gdim", "SELECT CAST(max(row) + 1 AS INT) AS nrows, 100 AS ncols FROM gridv", "gridv")


def gray(spark: SparkSession, d: str) -> DataFrame:
    """8-bit image of the grid."""
    g = gridv(spark, d)
    return g.select("row", "col", F.least(F.floor(F.col("v")), F.lit(255)).cast("int").alias("v"))


view("gray", "SELECT row, col, CAST(least(floor(v), 255) AS INT) AS v FROM gridv", "gridv")


def pts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    code = F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.lit("s1").alias("scene_id"),
        F.col("o_orderkey").alias("fid"),
        F.concat(F.lit("class_"), code).alias("layer"),
        (code.cast("int") - 1).alias("class"),
        (F.lit(500000.0) + 30.0 * (F.col("o_custkey") % 29 - 2) + 7.5).alias("x"),
        (F.lit(4000000.0) - 30.0 * (F.col("o_orderkey") % 23 - 1) - 7.5).alias("y"),
    )


view(
    "pts",
    """SELECT o_orderkey AS fid, concat('class_', substr(o_orderpriority,1,1)) AS layer, CAST(substr(o_orderpriority,1,1) AS INT) - 1 AS class,
 500000 + 30::DOUBLE*(o_custkey % 29 - 2) + 7.5::DOUBLE AS x, 4000000 - 30::DOUBLE*(o_orderkey % 23 - 1) - 7.5::DOUBLE AS y FROM orders""",
)
view(
    "loc",
    """SELECT * FROM (SELECT pts.*, CAST(trunc((y - 4000000) / -30) AS INT) AS row, CAST(trunc((x - 500000) / 30) AS INT) AS col FROM pts), dim
 WHERE row BETWEEN 0 AND nrows - 1 AND col BETWEEN 0 AND ncols - 1""",
    "pts", "dim",
)


def polys(spark: SparkSession, d: str) -> DataFrame:
    """A triangle per supplier over the grid scene."""
    s = F.col("s_suppkey")
    cx = F.lit(500000.0) + 30.0 * (s * 37 % 100) + 11.3
    cy = F.lit(4000000.0) - 30.0 * (s * 53 % 97) - 8.7
    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(
        point(cx - (40.0 + s % 7 * 13.7), cy + 3.1),
        point(cx + (25.0 + s % 5 * 21.3), cy + (30.0 + s % 11 * 9.1)),
        point(cx + (10.0 + s % 3 * 31.9), cy - (35.0 + s % 13 * 7.7)),
    )
    return table(spark, d, "supplier").select(s.alias("fid"), (s % 4).cast("int").alias("class"), ring.alias("ring"))


view(
    "tri",
    """SELECT fid, class, cx - (40 + fid % 7 * 13.7::DOUBLE) AS ax, cy + 3.1::DOUBLE AS ay,
 cx + (25 + fid % 5 * 21.3::DOUBLE) AS bx, cy + (30 + fid % 11 * 9.1::DOUBLE) AS by_,
 cx + (10 + fid % 3 * 31.9::DOUBLE) AS dx, cy - (35 + fid % 13 * 7.7::DOUBLE) AS dy
 FROM (SELECT s_suppkey AS fid, CAST(s_suppkey % 4 AS INT) AS class, 500000 + 30::DOUBLE * (s_suppkey * 37 % 100) + 11.3::DOUBLE AS cx,
 4000000 - 30::DOUBLE * (s_suppkey * 53 % 97) - 8.7::DOUBLE AS cy FROM supplier)""",
)
view(
    "edg",
    """SELECT fid, class, ax AS x1, ay AS y1, bx AS x2, by_ AS y2 FROM tri UNION ALL SELECT fid, class, bx, by_, dx, dy FROM tri
 UNION ALL SELECT fid, class, dx, dy, ax, ay FROM tri""",
    "tri",
)
view(
    "bbox",
    "SELECT fid, min(least(x1, x2)) AS xlo, max(greatest(x1, x2)) AS xhi, min(least(y1, y2)) AS ylo, max(greatest(y1, y2)) AS yhi FROM edg GROUP BY fid",
    "edg",
)
view(
    "inpoly",
    """SELECT g.row, g.col, e.fid, e.class FROM (SELECT row, col, 500000 + 30 * (col + 0.5::DOUBLE) AS xc, 4000000 - 30 * (row + 0.5::DOUBLE) AS yc FROM gridv) g
 JOIN bbox b ON xc BETWEEN xlo AND xhi AND yc BETWEEN ylo AND yhi JOIN edg e ON e.fid = b.fid
 GROUP BY g.row, g.col, e.fid, e.class
 HAVING sum(CASE WHEN (y1 > yc) <> (y2 > yc) AND xc < x1 + (yc - y1) * (x2 - x1) / (y2 - y1) THEN 1 ELSE 0 END) % 2 = 1""",
    "gridv", "bbox", "edg",
)


def seg(spark: SparkSession, d: str) -> DataFrame:
    p = px(spark, d).filter("valid")
    label = F.floor(F.col("row") / 5) * 5 + F.floor(F.col("col") / 5) + 1
    return p.select("scene_id", "pix", "row", "col", "spectrum", label.cast("int").alias("seg"))


view("seg", "SELECT pix, row, col, spectrum, CAST((row // 5) * 5 + (col // 5) + 1 AS INT) AS seg FROM px WHERE valid", "px")


def lab(spark: SparkSession, d: str) -> DataFrame:
    return px(spark, d).filter("pix % 11 < 3").select("scene_id", "row", "col", (F.col("label") % 3 + 1).alias("label"))


view("lab", "SELECT row, col, label % 3 + 1 AS label FROM px WHERE pix % 11 < 3", "px")


def pred(spark: SparkSession, d: str) -> DataFrame:
    guess = (
        F.when(F.col("pix") % 7 == 0, (F.col("label") + 1) % 10)
        .when(F.col("pix") % 13 == 0, (F.col("label") + 4) % 10)
        .otherwise(F.col("label"))
    )
    return px(spark, d).select("pix", F.col("label").alias("truth"), guess.alias("pred"))


view(
    "pred",
    "SELECT pix, label AS truth, CASE WHEN pix % 7 = 0 THEN (label + 1) % 10 WHEN pix % 13 = 0 THEN (label + 4) % 10 ELSE label END AS pred FROM px",
    "px",
)
view(
    "cm",
    """SELECT t.l AS truth, p.l AS pred, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT truth AS l FROM pred UNION SELECT DISTINCT pred FROM pred) t
 CROSS JOIN (SELECT DISTINCT truth AS l FROM pred UNION SELECT DISTINCT pred FROM pred) p
 LEFT JOIN (SELECT truth, pred, count(*) AS n FROM pred GROUP BY 1, 2) c ON c.truth = t.l AND c.pred = p.l""",
    "pred",
)


@functools.cache
def directions():
    """16 fixed projection directions over the 64 bands, the same as the ``dirs`` view."""
    import numpy as np

    d, b = np.meshgrid(np.arange(16), np.arange(BANDS), indexing="ij")
    return ((d * 31 + b * 17 + d * b) % 13 - 6) / 6.0


view(
    "dirs",
    "SELECT CAST(d.i AS INT) AS dir, CAST(b.i AS INT) AS band, ((d.i*31 + b.i*17 + d.i*b.i) % 13 - 6)/6::DOUBLE AS r FROM range(16) d(i) CROSS JOIN range(64) b(i)",
)


def samples_txt(spark: SparkSession, d: str) -> DataFrame:
    doc = table(spark, d, "documents")
    return doc.select(
        F.concat(F.lit("/data/"), "source", F.lit("/img_"), "doc_id", F.lit(".tif "), F.col("doc_id") % 5).alias("line"), "doc_id"
    )


view("samples_txt", "SELECT concat('/data/', source, '/img_', doc_id, '.tif ', doc_id % 5) AS line, doc_id FROM documents")


def log_txt(spark: SparkSession, d: str) -> DataFrame:
    """A training log line per event."""
    e = F.col("event_id")
    head = F.when(e % 2 == 0, "Test-Loss: 0.5, Accuracy: ").otherwise("Epoch, Loss: 0.4, Accuracy: ")
    return table(spark, d, "events").select(F.concat(head, e % 97, F.lit(".25%, Lr: 1e-4")).alias("line"))


view(
    "log_txt",
    "SELECT concat(CASE WHEN event_id % 2 = 0 THEN 'Test-Loss: 0.5, Accuracy: ' ELSE 'Epoch, Loss: 0.4, Accuracy: ' END, event_id % 97, '.25%, Lr: 1e-4') AS line FROM events",
)


def dims(pixels: DataFrame) -> tuple[int, int]:
    """(rows, cols) of the pixel scene; one aggregate."""
    return pixels.agg(F.max("row") + 1).first()[0], COLS


def grid_dims(grid: DataFrame) -> tuple[int, int]:
    return grid.agg(F.max("row") + 1).first()[0], GRID_COLS


def scene(pixels: DataFrame) -> Scene:
    rows, cols = dims(pixels)
    return Scene("s1", rows, cols, BANDS, GT, nodata=0.0)


def key_sql(ident: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5(concat('{seed}:', {ident})), 1, 8) AS BIGINT) % 2147483648)"

"""The scene header and the canonical pixel table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import bands as band_fn
from cubeloom.functions import geo

# Element types a raster may have, and the Spark type that holds each.
ELEMENT_TYPES = {
    "uint8": "smallint", "uint16": "int", "int16": "smallint", "uint32": "bigint", "int32": "int",
    "float32": "float", "float64": "double",
}
SCENES_SCHEMA = (
    "scene_id string, rows int, cols int, bands int, gt array<double>, srs string, nodata double, dtype string"
)


def check_dtype(dtype: str) -> str:
    if dtype not in ELEMENT_TYPES:
        raise ValueError(f"unsupported element type {dtype!r}; supported: {sorted(ELEMENT_TYPES)}")
    return dtype


@dataclass(frozen=True)
class Scene:
    """Header of one scene."""

    scene_id: str
    rows: int
    cols: int
    bands: int
    gt: Sequence[float]
    srs: str = ""
    nodata: float | None = None
    dtype: str = "float32"

    def __post_init__(self):
        check_dtype(self.dtype)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([{**asdict(self), "gt": [float(g) for g in self.gt]}], SCENES_SCHEMA)


def scene_meta(pixels: DataFrame, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """Extent of each scene derived from its pixels (partial aggregation)."""
    return pixels.groupBy(*keys).agg(
        (F.max("row") + 1).cast("int").alias("rows"),
        (F.max("col") + 1).cast("int").alias("cols"),
        F.max(F.size("spectrum")).cast("int").alias("bands"),
    )


def read_pixels(spark: SparkSession, path: str, scene: Scene | None = None, scale: float = band_fn.REFLECTANCE_SCALE) -> DataFrame:
    """Pixel table; int16 scenes are scaled unless ``scale=1``; valid is derived when absent."""
    pixels = spark.read.parquet(path)
    if "valid" not in pixels.columns:
        pixels = pixels.withColumn("valid", band_fn.is_valid(F.col("spectrum"), scene.nodata if scene else None))
    if scene is None:
        return pixels
    return pixels.withColumn("spectrum", band_fn.scale_reflectance(F.col("spectrum"), scene.dtype, scale))


def scan_band(pixels: DataFrame, band: int, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """(keys..., row, col, value) of one 1-based band."""
    if band < 1:
        raise ValueError("bands are numbered from 1")
    return pixels.select(*keys, "row", "col", F.element_at("spectrum", band).cast("double").alias("value"))


def scan_window(pixels: DataFrame, xoff: int, yoff: int, xsize: int, ysize: int) -> DataFrame:
    """Pixels of a window; the range filters reach the Parquet row groups."""
    return pixels.filter(
        F.col("row").between(yoff, yoff + ysize - 1) & F.col("col").between(xoff, xoff + xsize - 1)
    )


def band_subset(pixels: DataFrame, rows=None, cols=None, bands=None) -> DataFrame:
    """Row / column / band selection: all, one, or a half-open range each."""
    kept = pixels.filter(band_fn.in_slice(F.col("row"), rows) & band_fn.in_slice(F.col("col"), cols))
    return kept.withColumn("spectrum", band_fn.band_slice(F.col("spectrum"), bands))


def write_pixels(pixels: DataFrame, path: str, tile: int = 512, mode: str = "errorifexists") -> None:
    """Pixel table clustered by tile inside scene partitions, zstd Parquet.

    Sorting by tile keeps row-group statistics narrow, which is what window reads prune on.
    """
    tiled = pixels.withColumn("tile_row", geo.tile_of(F.col("row"), tile)).withColumn(
        "tile_col", geo.tile_of(F.col("col"), tile)
    )
    ranged = tiled.repartitionByRange("scene_id", "tile_row", "tile_col").sortWithinPartitions(
        "scene_id", "tile_row", "tile_col", "row", "col"
    )
    ranged.write.mode(mode).option("compression", "zstd").partitionBy("scene_id").parquet(path)


def to_wide(pixels: DataFrame, bands: int, prefix: str = "b") -> DataFrame:
    """One column per band (b001 ...): a rule then reads only the bands it names."""
    rest = [c for c in pixels.columns if c != "spectrum"]
    return pixels.select(*rest, *[F.element_at("spectrum", i).alias(f"{prefix}{i:03d}") for i in range(1, bands + 1)])


def rgb_compose(
    pixels: DataFrame, r: int, g: int, b: int, keys: Sequence[str] = ("scene_id",), vector: str = "spectrum",
    order: str = "rgb", stretch: bool = True,
) -> DataFrame:
    """(keys..., row, col, c1, c2, c3): three stretched bands in ``order``; invalid pixels are 1.0.

    The three bands share one percentile job: they are stacked and keyed by channel.
    """
    from cubeloom.operators.quantiles import STRETCH_PERCENTILES, exact_quantiles

    if order not in ("rgb", "bgr"):
        raise ValueError("order is 'rgb' or 'bgr'")
    chosen = (r, g, b) if order == "rgb" else (b, g, r)
    if min(chosen) < 1:
        raise ValueError("bands are numbered from 1")
    values = pixels.select(
        *keys, "row", "col", "valid", *[F.element_at(vector, n).cast("double").alias(f"v{i}") for i, n in enumerate(chosen)]
    )
    if not stretch:
        return values.select(
            *keys, "row", "col", *[F.when(F.col("valid"), F.col(f"v{i}")).otherwise(1.0).alias(f"c{i + 1}") for i in range(3)]
        )
    stacked = values.filter("valid").select(
        *keys, F.explode(F.array(*[F.struct(F.lit(i).alias("ch"), F.col(f"v{i}").alias("v")) for i in range(3)])).alias("_s")
    ).select(*keys, "_s.*")
    lo_q, hi_q = STRETCH_PERCENTILES
    q = exact_quantiles(stacked, [*keys, "ch"], "v", STRETCH_PERCENTILES)
    limits = q.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("ch") == i) & (F.col("q") == p), F.col("value"))).alias(f"_{name}{i}")
            for i in range(3)
            for name, p in (("lo", lo_q), ("hi", hi_q))
        ]
    )
    joined = values.join(limits, list(keys), "left")

    def channel(i: int):
        lo, hi, v = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"v{i}")
        scaled = F.when(lo == hi, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - lo) / (hi - lo))))
        return F.when(F.col("valid"), scaled).otherwise(1.0).alias(f"c{i + 1}")

    return joined.select(*keys, "row", "col", *[channel(i) for i in range(3)])

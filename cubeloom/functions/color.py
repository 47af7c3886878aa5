"""Palettes, colour conversion and 8-bit gray."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class palette (label k -> entry k).
CLASS_PALETTE = [
    "#d5e5c9", "#1c6995", "#d9c2df", "#e2795a", "#eac56c", "#299d90", "#895c56", "#1bb5b9",
    "#d68e04", "#eea78b", "#459741", "#9566a8", "#a4d2a1", "#e98d49", "#639dfc", "#93a906",
]
# Mineral map palette (background, hematite, calcite, dolomite, chlorite, hydromica).
MINERAL_PALETTE = ["#ffffff", "#ff0000", "#ffd000", "#00c8ff", "#1aff00", "#bb00ff"]
# Fixed value: colour of the background label -1.
BACKGROUND_RGB = (255, 255, 255)


def hex_channel(value: Column, channel: int) -> Column:
    """0-255 value of one channel of ``#rrggbb``."""
    return F.conv(F.substring(value, 2 + 2 * channel, 2), 16, 10).cast("int")


def palette_table(spark: SparkSession, colours: list[str] | None = None, background: bool = True) -> DataFrame:
    """palette(label, hex, r, g, b); ``background`` adds label -1 in white."""
    entries = [(i, h) for i, h in enumerate(colours or CLASS_PALETTE)]
    if background:
        entries.append((-1, "#%02x%02x%02x" % BACKGROUND_RGB))
    table = spark.createDataFrame(entries, "label int, hex string")
    return table.select("label", "hex", *[hex_channel(F.col("hex"), i).alias(c) for i, c in enumerate("rgb")])


def label_to_rgb(df: DataFrame, palette: DataFrame, label: str = "label") -> DataFrame:
    """Adds r, g, b. The palette has one row per class, so it is a constant-size broadcast."""
    keyed = palette.select(F.col("label").alias(label), "r", "g", "b")
    return df.join(F.broadcast(keyed), label, "left")


def to_u8(stretched: Column) -> Column:
    """0..1 -> 0..255, truncating; missing or NaN becomes 0."""
    clean = F.when(stretched.isNull() | F.isnan(stretched), F.lit(0.0)).otherwise(stretched)
    return (clean * 255).cast("int")


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of 8-bit channels."""
    return F.rint(0.299 * r + 0.587 * g + 0.114 * b).cast("int")

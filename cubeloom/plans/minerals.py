"""Mineral maps from band rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.functions import bands as band_fn
from cubeloom.functions import color


def rule_map(pixels: DataFrame, rule: band_fn.BandRule, band: band_fn.BandLookup) -> DataFrame:
    """Adds hit (0 / 1) and n_terms (satisfied terms) of one rule."""
    counted = pixels.withColumn("n_terms", rule.satisfied(band))
    return counted.withColumn("hit", (F.col("n_terms") == len(rule.terms)).cast("int"))


def hematite_map(pixels: DataFrame, band: band_fn.BandLookup) -> DataFrame:
    """Adds hit and ratio of the hematite index."""
    return pixels.withColumn("hit", band_fn.hematite_hit(band).cast("int")).withColumn("ratio", band_fn.hematite_ratio(band))


def carbonate_map(pixels: DataFrame, band: band_fn.BandLookup) -> DataFrame:
    """Adds label: 1 calcite, 2 dolomite, 0 neither."""
    return pixels.withColumn("label", band_fn.carbonate_class(band))


def rule_hits(pixels: DataFrame, rules: Sequence[band_fn.BandRule], band: band_fn.BandLookup, ident: str = "pix") -> DataFrame:
    """hits(ident, rule, n_terms, hit) for all rules at once.

    All rules are evaluated in the same row and unpivoted, so the pixels are read once and nothing
    is joined or shuffled.
    """
    results = F.array(
        *[
            F.struct(F.lit(r.name).alias("rule"), r.satisfied(band).alias("n_terms"), F.lit(len(r.terms)).alias("_all"))
            for r in rules
        ]
    )
    rows = pixels.select(ident, F.explode(results).alias("_r")).select(ident, "_r.*")
    return rows.select(ident, "rule", "n_terms", (F.col("n_terms") == F.col("_all")).cast("int").alias("hit"))


def rule_counts(pixels: DataFrame, rules: Sequence[band_fn.BandRule], band: band_fn.BandLookup) -> DataFrame:
    """counts(rule, n_hit, n_pixels): one aggregate over the scene."""
    totals = pixels.agg(F.count("*").alias("_n"), *[F.sum(r.hit(band).cast("long")).alias(r.name) for r in rules])
    pairs = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(r.name).alias("n_hit")) for r in rules])
    return totals.select(F.explode(pairs).alias("_p"), "_n").select("_p.rule", "_p.n_hit", F.col("_n").alias("n_pixels"))


def coloured_carbonates(pixels: DataFrame, band: band_fn.BandLookup) -> DataFrame:
    """Carbonate classes with their map colours."""
    # map value k is drawn with palette entry 0, 2, 3 for none, calcite, dolomite
    colours = [color.MINERAL_PALETTE[i] for i in (0, 2, 3)]
    palette = color.palette_table(pixels.sparkSession, colours, background=False)
    return color.label_to_rgb(carbonate_map(pixels, band), palette)

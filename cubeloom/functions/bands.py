"""Band access, reflectance scaling, validity and the mineral band rules."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# 1-based band number -> SQL expression of its value
BandLookup = Callable[[int], str]

# Fixed value: int16 reflectance is stored in units of 1/10000.
REFLECTANCE_SCALE = 1e-4


def array_bands(column: str = "spectrum", wrap: int | None = None) -> BandLookup:
    """Element of an array column (``wrap`` folds numbers into a short spectrum)."""
    return lambda n: f"CAST({column}[{(n - 1) % wrap if wrap else n - 1}] AS DOUBLE)"


def wide_bands(prefix: str = "b") -> BandLookup:
    """Columns ``b001`` ...; Parquet then reads only the bands a rule names."""
    return lambda n: f"CAST({prefix}{n:03d} AS DOUBLE)"


def scale_reflectance(spectrum: Column, dtype: str, scale: float = REFLECTANCE_SCALE) -> Column:
    """Scaled spectrum for int16 scenes, the plain one for every other type or for ``scale=1``."""
    if dtype != "int16" or scale == 1:
        return spectrum
    return F.transform(spectrum, lambda x: x.cast("double") * F.lit(scale))


def is_valid(spectrum: Column, nodata: float | None = None) -> Column:
    """False where every band equals nodata (0 when the scene names none)."""
    value = 0.0 if nodata is None else float(nodata)
    if math.isnan(value):
        # NaN never equals itself in the data model, so nothing is masked
        return F.lit(True)
    return F.exists(spectrum, lambda x: x != F.lit(value))


def band_slice(spectrum: Column, selection: int | tuple[int, int] | None) -> Column:
    """0-based band selection: all, one band, or a half-open range."""
    if selection is None:
        return spectrum
    if isinstance(selection, int):
        return F.array(spectrum[selection])
    start, stop = selection
    return F.slice(spectrum, start + 1, stop - start)


def in_slice(column: Column, selection: int | tuple[int, int] | None) -> Column:
    """Row / column counterpart of :func:`band_slice`."""
    if selection is None:
        return F.lit(True)
    if isinstance(selection, int):
        return column == selection
    return (column >= selection[0]) & (column < selection[1])


@dataclass(frozen=True)
class BandRule:
    """A mineral index: every ``(high, low)`` pair must satisfy band[high] > band[low]."""

    name: str
    terms: tuple[tuple[int, int], ...]

    def satisfied(self, band: BandLookup) -> Column:
        """Number of satisfied terms."""
        return F.expr(" + ".join(f"CAST({band(hi)} - {band(lo)} > 0 AS INT)" for hi, lo in self.terms))

    def hit(self, band: BandLookup) -> Column:
        """All terms hold; evaluation stops at the first one that does not."""
        return F.expr(" AND ".join(f"({band(hi)} - {band(lo)} > 0)" for hi, lo in self.terms))


# 1-based band pairs (high, low) of the mineral rules.
CALCITE = BandRule(
    "calcite", ((138, 136), (142, 145), (146, 145), (147, 156), (159, 156), (157, 155), (155, 156))
)
DOLOMITE = BandRule(
    "dolomite",
    (
        (125, 135), (137, 135), (147, 155), (158, 155), (158, 161), (145, 144),
        (152, 153), (153, 154), (156, 155), (138, 144), (157, 158), (147, 148),
    ),
)
CHLORITE = BandRule("chlorite", ((123, 84), (146, 151), (152, 157), (162, 157), (152, 151)))
HYDROMICA = BandRule("hydromica", ((146, 147), (150, 149), (151, 150), (156, 157), (158, 157)))
MINERAL_RULES = (CALCITE, DOLOMITE, CHLORITE, HYDROMICA)

# Hematite ratio bands, divisor offset and threshold.
HEMATITE_BANDS = (36, 20)
HEMATITE_EPS = 1e-4
HEMATITE_THRESHOLD = 1.8


def hematite_ratio(band: BandLookup) -> Column:
    """Ratio index on unscaled values (the offset is not scale free)."""
    numerator, denominator = (F.expr(band(n)) for n in HEMATITE_BANDS)
    return numerator / (denominator + F.lit(HEMATITE_EPS))


def hematite_hit(band: BandLookup) -> Column:
    return hematite_ratio(band) > F.lit(HEMATITE_THRESHOLD)


def carbonate_class(band: BandLookup) -> Column:
    """0 none, 1 calcite, 2 dolomite (only where calcite does not fire)."""
    return F.when(CALCITE.hit(band), 1).when(DOLOMITE.hit(band), 2).otherwise(0)


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights with radius int(truncate * sigma + 0.5)."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    total = sum(raw)
    return [w / total for w in raw]


def spectral_highpass(spectrum: Column, sigma: float = 1.0) -> Column:
    """Spectrum minus its Gaussian smoothing along the bands, edges mirrored (d c b a | a b c d).

    The mirrored spectrum is built once per row; each tap is then a shifted slice of it.
    """
    taps = gaussian_taps(sigma)
    radius = len(taps) // 2
    n = F.size(spectrum)
    head = F.reverse(F.slice(spectrum, F.lit(1), F.lit(radius)))
    tail = F.slice(F.reverse(spectrum), F.lit(1), F.lit(radius))
    padded = F.concat(head, spectrum, tail)
    weights = F.array(*[F.lit(w) for w in taps])

    def residual(x: Column, i: Column) -> Column:
        window = F.slice(padded, i + 1, F.lit(len(taps)))
        return x - F.aggregate(F.zip_with(window, weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)

    return F.when(n >= radius, F.transform(spectrum, residual))

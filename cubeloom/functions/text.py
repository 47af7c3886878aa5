"""Text helpers: sample lists, training logs and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_TARGETS = ("Accuracy: ", "Loss: ")


def sample_path(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")[0]


def sample_label(line: Column) -> Column:
    parts = F.split(F.trim(line), r"\s+")
    return F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).try_cast("int")


def rebase(path: Column, folder: str) -> Column:
    """File name of ``path`` placed in ``folder``."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), F.substring_index(path, "/", -1))


def log_value(line: Column, target: str) -> Column:
    """Number after ``target`` up to the next comma, without a percent sign; null when there is none."""
    if target not in LOG_TARGETS:
        raise ValueError(f"target must be one of {LOG_TARGETS}")
    text = F.trim(line)
    first = F.locate(target, text)
    rest = F.trim(F.split(F.substring(text, first + len(target), F.length(text)), ",")[0])
    return F.when(first > 0, F.regexp_replace(rest, "%$", "").try_cast("double"))


def log_phase(line: Column) -> Column:
    return F.when(F.startswith(F.trim(line), F.lit("Test")), "test").otherwise("train")


def _scaled(value: Column, digits: int) -> Column:
    """value * 10^digits as a whole number: the exact product is rounded, ties to even.

    The product of a double and a short factor is the sum of two doubles (the value is split into halves of 26 bits), so a tie is told
    from its neighbours without more precision.
    """
    factor = float(10**digits)
    wide = value * F.lit(134217729.0)
    high = wide - (wide - value)
    product = value * F.lit(factor)
    rest = (high * F.lit(factor) - product) + (value - high) * F.lit(factor)
    base = F.floor(product)
    part = product - base
    up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (base % 2 == 1))))
    return base + up.cast("long")


def percent_text(value: Column) -> Column:
    """Share as a percentage: whole numbers bare, up to two decimals -> one, more -> two, zero -> 0.0.

    The decimals are those of the percentage at ten digits; the exact binary value is rounded, ties to even.
    """
    percent = value.cast("double") * 100
    size = F.abs(percent)
    ten, one, two = (_scaled(size, digits) for digits in (10, 1, 2))
    sign = F.when(percent < 0, "-").otherwise("")

    def decimals(number: Column, digits: int) -> Column:
        whole = F.floor(number / 10**digits).cast("long")
        return F.concat(sign, whole.cast("string"), F.lit("."), F.lpad((number % 10**digits).cast("string"), digits, "0"))

    return (
        F.when(percent == 0, "0.0")
        .when(F.isnan(percent), "nan")
        .when(ten % 10**10 == 0, F.concat(sign, F.floor(ten / 10**10).cast("long").cast("string")))
        .when(ten % 10**8 == 0, decimals(one, 1))
        .otherwise(decimals(two, 2))
    )

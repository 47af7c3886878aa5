"""Arithmetic on ARRAY<DOUBLE> columns inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def vmean(a: Column) -> Column:
    return vsum(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return vsum(F.zip_with(a, b, lambda x, y: x * y))


def sqnorm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(sqnorm(a))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def arith_key(ident: Column, seed: int) -> Column:
    """Pseudo-random integer in [0, 2^31) of a row id and a seed: the first digits of an MD5, so plain SQL can repeat it.

    Depends on the row only, never on the partitioning; another seed gives an unrelated order.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(ARITH_KEY_RANGE)


ARITH_KEY_RANGE = 2147483648

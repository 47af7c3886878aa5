"""Pixel and map coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GeoTransform = Sequence[float]


def pixel_x(row: Column, col: Column, gt: GeoTransform) -> Column:
    return F.lit(float(gt[0])) + col * float(gt[1]) + row * float(gt[2])


def pixel_y(row: Column, col: Column, gt: GeoTransform) -> Column:
    return F.lit(float(gt[3])) + col * float(gt[4]) + row * float(gt[5])


def geo_col(x: Column, gt: GeoTransform) -> Column:
    """Column under x; truncates toward zero and ignores rotation."""
    return ((x - float(gt[0])) / float(gt[1])).cast("int")


def geo_row(y: Column, gt: GeoTransform) -> Column:
    return ((y - float(gt[3])) / float(gt[5])).cast("int")


def inside(row: Column, col: Column, rows: int, cols: int) -> Column:
    return row.between(0, rows - 1) & col.between(0, cols - 1)


def patch_radius(p: int) -> tuple[int, int]:
    """Pixels before and after the centre of a p-wide patch (the centre of an even patch sits left/top)."""
    return ((p // 2 - 1, p // 2) if p % 2 == 0 else (p // 2, p // 2))


def patch_origin_x(col: Column, p: int, gt: GeoTransform) -> Column:
    return F.lit(float(gt[0])) + (col - patch_radius(p)[0]) * float(gt[1])


def patch_origin_y(row: Column, p: int, gt: GeoTransform) -> Column:
    return F.lit(float(gt[3])) + (row - patch_radius(p)[0]) * float(gt[5])


def flat_index(row: Column, col: Column, cols: int) -> Column:
    return row.cast("long") * cols + col


def row_of(index: Column, cols: int) -> Column:
    return F.floor(index / cols).cast("int")


def col_of(index: Column, cols: int) -> Column:
    return F.pmod(index, F.lit(cols)).cast("int")


def tile_of(value: Column, size: int) -> Column:
    return F.floor(value / size).cast("int")


def block_shape(block: int | tuple[int, int]) -> tuple[int, int]:
    if isinstance(block, int):
        return block, block
    if isinstance(block, tuple) and len(block) == 2:
        return block
    raise ValueError("a block size is an int or a (rows, cols) pair")

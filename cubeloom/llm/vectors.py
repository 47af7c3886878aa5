"""Vectors as packed doubles: validity, keys and decoding shared by the vector operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """True for a vector that is not null, empty or zero and holds no null and no non-finite component."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def packed(series: pd.Series) -> np.ndarray:
    """Rows of doubles from a column of arrays."""
    return np.array(series.tolist(), np.float64)


def unpacked(series: pd.Series, kind: str = "<f8") -> np.ndarray:
    """Rows of numbers from a column of byte strings."""
    return np.frombuffer(b"".join(series), kind).reshape(len(series), -1)


def directions(dim: int, bits: int, seed: int) -> np.ndarray:
    """dim x bits matrix whose columns come from random orthogonal rotations of the padded space."""
    size = max(dim, 8)
    blocks = []
    rng = np.random.default_rng([seed, dim, bits])
    for _ in range(-(-bits // size)):
        q, r = np.linalg.qr(rng.standard_normal((size, size)))
        blocks.append((q * np.sign(np.diag(r)))[:dim])
    return np.concatenate(blocks, axis=1)[:, :bits]


def width(df: DataFrame, vector: str) -> int:
    """Length of the vectors (0 for an empty table); all must agree."""
    low, high = df.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high:
        raise ValueError(f"vectors of {low} and of {high} components")
    return low or 0

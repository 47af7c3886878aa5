"""Embedding near-duplicates from randomised-rotation binary codes.

A vector of length one is rotated at random; the signs of the rotated components are its code, and the inner product of the
code's own direction with the vector is stored as its correction factor. Code and factor give an unbiased estimate of the inner product
with any other vector, and a bound on its error; only pairs whose bound reaches the threshold are recomputed exactly.

Further sign bits, cut into bands, bring together the vectors that may be near: two vectors meet if they agree in a band, and the
number of bands follows from the chance that a pair at the threshold would miss them all. First only the codes travel, and tell which vectors have
a near code in a bucket; only those vectors follow. A bucket too large for one task is cut into blocks that
meet pair by pair. Blocks return a count and a root per vector, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, written
from cubeloom.llm.graph import components
from cubeloom.llm.vectors import directions, packed, unpacked, usable, width
from cubeloom.operators.components import min_labels

COSINE = 0.95
CODE_BITS = 256
SEED = 11
MISS = 1e-5  # chance that a pair exactly at the threshold meets in no band
SIGMAS = 5.0
BLOCK = 1024
PAIRS = 100_000
GROUP_ROWS = 20_000
LEAST_GROUPS = 256


def band_plan(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands): bands grow with the logarithm of the rows, so buckets keep their size."""
    bits = int(np.clip(np.ceil(np.log2(max(rows, 2))) - 3, 6, 30))
    agree = (1 - np.arccos(min(cosine, 1.0)) / np.pi) ** bits
    return bits, int(np.ceil(np.log(miss) / np.log1p(-agree)))


def turn(unit: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows of length one, rotated, in a scale where rotation keeps lengths."""
    dim = unit.shape[1]
    return unit @ (directions(dim, CODE_BITS, seed) * np.sqrt(min(1.0, max(dim, 8) / CODE_BITS)))


def sign_matrix(codes: np.ndarray) -> np.ndarray:
    """The directions of packed codes, of length one."""
    return (np.unpackbits(codes, axis=1)[:, :CODE_BITS].astype(np.float64) * 2 - 1) / np.sqrt(CODE_BITS)


def encode_vectors(unit: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(packed codes, correction factors) of rows of length one; the factor is the inner product with the code's direction."""
    turned = turn(unit, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(CODE_BITS)


def error_bound(factors: np.ndarray) -> np.ndarray:
    """SIGMAS standard deviations of the estimate (code direction . vector) / factor."""
    return SIGMAS * np.sqrt(np.maximum(1 - factors**2, 0) / factors**2 / (CODE_BITS - 1))


def _coded(reps: DataFrame, dim: int, bits: int, bands: int, seed: int) -> DataFrame:
    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn = directions(dim, bits * bands, seed + 1)
        for f in frames:
            if len(f) == 0:
                continue
            raw = packed(f["vector"])
            unit = raw / np.linalg.norm(raw, axis=1)[:, None]
            codes, factors = encode_vectors(unit, seed)
            signs = (unit @ turn > 0).reshape(len(f), bands, bits)
            keys = signs @ (1 << np.arange(bits, dtype=np.int64))
            yield pd.DataFrame({
                "rep": f["rep"], "weight": f["weight"], "unit": [u.tobytes() for u in unit], "code": [c.tobytes() for c in codes],
                "factor": factors, "keys": [k.astype("<i4").tobytes() for k in keys], "bands": list(keys),
            })

    return reps.mapInPandas(code, "rep long, weight long, unit binary, code binary, factor double, keys binary, bands array<bigint>")


def _in_blocks(rows: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """Rows dealt to pairs of blocks of their bucket: bi <= bj, side 0 or 1 (2: both, in a block with itself)."""
    sizes = rows.groupBy("band", "key").agg(F.count("*").alias("m")).filter("m > 1")
    sized = rows.join(sizes, ["band", "key"]).withColumn("blocks", F.ceil(F.col("m") / block).cast("int"))
    sized = sized.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = sized.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    return met.select("band", "key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), side.alias("side"), *columns)


def _met(f: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks of index pairs that meet in a bucket; f is in order of bucket and block pair."""
    names = f[["band", "key", "bi", "bj"]].to_numpy()
    starts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1)))
    ends = np.repeat(np.append(starts[1:], len(f)), np.diff(np.append(starts, len(f))))
    side = f["side"].to_numpy()
    rows, step, held, size = np.arange(len(f)), 1, [], 0
    while True:
        rows = rows[rows + step < ends[rows]]
        if len(rows) == 0:
            break
        # a block with itself meets whole, two blocks meet across
        x = rows[(side[rows] != side[rows + step]) | (side[rows] == 2)]
        held.append((x, x + step))
        size += len(x)
        if size > PAIRS:
            yield from _cut(held)
            held, size = [], 0
        step += 1
    yield from _cut(held)


def _cut(held: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if held:
        x, y = (np.concatenate(z) for z in zip(*held))
        for at in range(0, len(x), PAIRS):
            yield x[at : at + PAIRS], y[at : at + PAIRS]


def _grouped(rows: DataFrame, expected: int) -> DataFrame:
    """Many buckets to a group: ``expected`` rows give groups of about GROUP_ROWS, and no bucket's block pair is split."""
    groups = max(LEAST_GROUPS, -(-expected // GROUP_ROWS))
    return rows.withColumn("g", F.pmod(F.xxhash64("band", "key", "bi", "bj"), F.lit(groups))).groupBy("g")


def _live(coded: DataFrame, cosine: float, block: int, expected: int) -> DataFrame:
    """band, key, rep of the vectors that have another near code in their bucket."""
    angle = np.arccos(min(cosine, 1.0)) / np.pi
    limit = int(np.ceil(CODE_BITS * angle + SIGMAS * np.sqrt(CODE_BITS * angle * (1 - angle))))

    def near(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["band", "key", "bi", "bj"], ignore_index=True)
        codes = unpacked(f["code"], "<u8")
        live = np.zeros(len(f), bool)
        for x, y in _met(f):
            hit = np.bitwise_count(codes[x] ^ codes[y]).sum(axis=1) <= limit
            live[x[hit]] = live[y[hit]] = True
        return f.loc[live, ["band", "key", "rep"]].drop_duplicates()

    rows = coded.select("rep", "code", F.posexplode("bands").alias("band", "key"))
    pairs = _in_blocks(rows, block, ["rep", "code"])
    return _grouped(pairs, expected).applyInPandas(near, "band int, key long, rep long").distinct()


def _linked(live: DataFrame, coded: DataFrame, cosine: float, seed: int, block: int) -> DataFrame:
    """rep, n, root per group: weight of the linked vectors, and the smallest vector reachable over the group's links."""
    columns = ["rep", "weight", "unit", "code", "factor", "keys"]
    rows = _in_blocks(live, block, ["rep"]).join(coded.select(*columns), "rep")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["band", "key", "bi", "bj"], ignore_index=True)
        reps, band, weight = f["rep"].to_numpy(), f["band"].to_numpy(), f["weight"].to_numpy()
        units, keys, factors = unpacked(f["unit"]), unpacked(f["keys"], "<i4"), f["factor"].to_numpy()
        signs, turned = sign_matrix(unpacked(f["code"], "u1")), turn(units, seed)
        bounds = error_bound(factors)
        n = np.zeros(len(f), np.int64)
        us, vs = [], []
        before = np.arange(keys.shape[1])[None, :]
        for x, y in _met(f):
            # a pair counts in the first band where it meets
            first = ~((keys[x] == keys[y]) & (before < band[x][:, None])).any(axis=1)
            x, y = x[first], y[first]
            hope = np.einsum("ij,ij->i", signs[x], turned[y]) / factors[x] + bounds[x] >= cosine
            x, y = x[hope], y[hope]
            good = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
            x, y = x[good], y[good]
            us.append(x), vs.append(y)
            np.add.at(n, x, weight[y])
            np.add.at(n, y, weight[x])
        nodes, at = np.unique(reps, return_inverse=True)
        u, v = (at[np.concatenate(z)] if z else np.zeros(0, np.int64) for z in (us, vs))
        root = min_labels(len(nodes), u, v)
        total = np.bincount(at, n, minlength=len(nodes)).astype(np.int64)
        seen = total > 0
        return pd.DataFrame({"rep": nodes[seen], "n": total[seen], "root": nodes[root[seen]]})

    return _grouped(rows, live.count()).applyInPandas(compare, "rep long, n long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_: str = "vec_id", vector: str = "embedding", seed: int = SEED,
                    block: int = BLOCK, miss: float = MISS) -> DataFrame:
    """Per row: vec_id, n_links (other rows whose cosine is at least ``cosine``), component_id (smallest vec_id reachable), kept.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing. Equal vectors are one class, so copies
    meet once. Rows with a null id keep it and link with nothing; other columns are not read; an empty table gives no rows.
    """
    doubles = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), doubles.alias("vector"))
    good = F.col("vec_id").isNotNull() & usable("vector")
    # adding zero turns -0.0 into 0.0, which are equal numbers of different bits
    rows = rows.withColumn("vector", F.when(good, F.transform("vector", lambda x: x + F.lit(0.0))))
    rows = rows.withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(seed), "vector")})
    ids = written(rows.select("vec_id", "k1", "k2", F.col("vector").isNotNull().alias("good")), "vector-ids")
    reps = written(
        rows.filter(F.col("vector").isNotNull()).groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector")),
        "vector-classes",
    )
    dim, total = width(reps, "vector"), reps.count()
    if total:
        bits, bands = band_plan(total, cosine, miss)
        coded = written(_coded(reps.select("rep", "weight", "vector"), dim, bits, bands, seed), "vector-codes")
        live = written(_live(coded, cosine, block, total * bands), "near-codes")
        found = written(_linked(live, coded, cosine, seed, block), "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "rep long, n long, root long")
    roots = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = reps.select("k1", "k2", "rep", "weight").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    placed = ids.filter("good").join(classes, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = ids.filter("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


@query("op6_neardup")
def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))

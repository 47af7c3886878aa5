"""Approximate nearest neighbours by learned partitions.

A bounded sample is fitted on the driver: its exact neighbour graph is cut into balanced parts, and a small network learns which
parts hold a point's neighbours. Every row is indexed under its most probable part. A query is sent to its most probable parts,
as many as a held-out part of the sample needs to find the wanted share of its true neighbours, and the candidates there are ranked by
exact distance. Parts and queries are dealt in blocks, so neither a crowded part nor many queries fill a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import mixed_key, query, table, written
from cubeloom.llm.vectors import packed, unpacked, usable, width

K = 10
SEED = 5
#: Rows the index is fitted on, and rows held out to choose the number of parts a query visits; every row is indexed.
SAMPLE = 6144
HELD_OUT = 768
ROWS_PER_PART = 192  # sample rows of a part
RECALL = 0.97
GRAPH = 10
HIDDEN = 96
BLOCK_ROWS = 16_384
QUERY_ROWS = 1024


def nearest(base: np.ndarray, queries: np.ndarray, k: int, skip_self: bool = False) -> np.ndarray:
    """Indices of the k rows of ``base`` nearest to each query, by blocks."""
    squares = (base**2).sum(axis=1)
    out = np.empty((len(queries), k), np.int64)
    for at in range(0, len(queries), 512):
        d = squares[None, :] - 2 * queries[at : at + 512] @ base.T
        if skip_self:
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        out[at : at + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, points: np.ndarray, parts: int, rng: np.random.Generator, slack: float = 0.05, rounds: int = 8) -> np.ndarray:
    """Part of each node: cut along directions of wide spread to start with, then moved to the part of most neighbours where room is left."""
    n = len(graph)
    part = np.zeros(n, np.int64)
    pieces, open_ = [], [(np.arange(n), parts)]
    while open_:
        rows, share = open_.pop()
        if share == 1:
            pieces.append(rows)
            continue
        centred = points[rows] - points[rows].mean(axis=0)
        axis = rng.standard_normal(points.shape[1])
        for _ in range(5):  # towards the direction of most spread
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) or 1.0
        order = rows[np.argsort(centred @ axis, kind="stable")]
        half = len(order) * (share // 2) // share
        open_ += [(order[:half], share // 2), (order[half:], share - share // 2)]
    for i, rows in enumerate(pieces):
        part[rows] = i
    back = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            back[j].append(i)
    near = [np.array(row + back[i]) for i, row in enumerate(graph.tolist())]
    sizes = np.bincount(part, minlength=parts)
    most, least = int(np.ceil(n / parts * (1 + slack))), int(n / parts * (1 - slack))
    for _ in range(rounds):
        moved = 0
        for i in rng.permutation(n):
            votes = np.bincount(part[near[i]], minlength=parts)
            gain = votes - votes[part[i]]
            gain[sizes >= most] = -1
            best = int(np.argmax(gain))
            if gain[best] > 0 and sizes[part[i]] > least:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass(frozen=True)
class Router:
    """A one-hidden-layer network from a vector to the probabilities of the parts, and the parts a query visits."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    visits: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self) -> int:
        return len(self.b2)


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 40, rate: float = 0.004) -> Router:
    """Softmax network on soft targets (the parts of a row's neighbours), by Adam."""
    mean = x.mean(axis=0)
    scale = 1.0 / (x.std() or 1.0)
    z = (x - mean) * scale
    d, m = x.shape[1], target.shape[1]
    p = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, m)) * np.sqrt(1 / HIDDEN), np.zeros(m)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in p]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            rows = order[at : at + 256]
            hidden = np.maximum(z[rows] @ p[0] + p[1], 0)
            logits = hidden @ p[2] + p[3]
            logits -= logits.max(axis=1, keepdims=True)
            soft = np.exp(logits)
            slope = (soft / soft.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            down = (slope @ p[2].T) * (hidden > 0)
            grads = [z[rows].T @ down, down.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                a, b = moments[i]
                g = g + 1e-4 * p[i]
                a[...] = 0.9 * a + 0.1 * g
                b[...] = 0.999 * b + 0.001 * g * g
                p[i] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Router(mean, scale, *p, visits=m)


def fit_router(sample: np.ndarray, k: int = K, recall: float = RECALL, seed: int = SEED) -> Router:
    """The router of a sample of rows; a sample too small for two parts gives one part, which is exact search."""
    rng = np.random.default_rng(seed)
    held = min(HELD_OUT, len(sample) // 6)
    x, probe = sample[: len(sample) - held], sample[len(sample) - held :]
    parts = int(min(len(x) // ROWS_PER_PART, 256))
    if parts < 2 or held < k:
        d = sample.shape[1]
        return Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = nearest(x, x, min(GRAPH, len(x) - 1), skip_self=True)
    part = balanced_parts(graph, x, parts, rng)
    target = np.zeros((len(x), parts))
    for column in (part, *part[graph].T):
        target[np.arange(len(x)), column] += 1 / (graph.shape[1] + 1)
    router = train_router(x, target, rng)
    indexed = router.scores(x).argmax(axis=1)
    truth = indexed[nearest(x, probe, k)]
    ranks = np.argsort(np.argsort(-router.scores(probe), axis=1), axis=1)
    found = np.take_along_axis(ranks, truth, axis=1).ravel()
    reached = np.cumsum(np.bincount(found, minlength=parts)) / len(found)
    return Router(router.mean, router.scale, router.w1, router.b1, router.w2, router.b2, int(np.argmax(reached >= recall)) + 1)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_: str = "vec_id", vector: str = "embedding", recall: float = RECALL,
           sample_rows: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, by Euclidean distance in double precision.

    A query's own id is no candidate. Rows with a null id, or a vector that is null, empty or zero or holds null or non-finite components,
    take no part; ties go to the smaller id; with fewer candidates all are returned; rows that repeat an id are
    candidates one by one; other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_).isNotNull() & usable(vector)).select(
        F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")
    )
    width(rows, "vector")
    sample = rows.orderBy(mixed_key(seed, "vec_id"), "vec_id").limit(sample_rows).select("vector").toPandas()  # bounded by sample_rows
    if len(sample) == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    told = spark.sparkContext.broadcast(fit_router(packed(sample["vector"]), k, recall, seed))  # bounded by the sample

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = told.value
        for f in frames:
            if len(f):
                scores = router.scores(packed(f["vector"]))
                visits = np.argsort(-scores, axis=1, kind="stable")[:, : router.visits]
                asked = f["is_query"].to_numpy(bool)
                yield pd.DataFrame({
                    "vec_id": f["vec_id"], "vector": [np.array(v, "<f8").tobytes() for v in f["vector"]], "part": scores.argmax(axis=1),
                    "visits": [v.tolist() if q else None for v, q in zip(visits, asked)],
                })

    indexed = written(rows.mapInPandas(route, "vec_id long, vector binary, part long, visits array<bigint>"), "indexed")
    asked = indexed.filter("visits IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("vector").alias("asked"), F.explode("visits").alias("part"))
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("bs"))
    sizes = sizes.join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERY_ROWS).alias("qs")), "part")
    sizes = F.broadcast(sizes)  # one row per part, 256 at most
    spread = [F.pmod(mixed_key(seed, i), F.col(n)) for i, n in (("vec_id", "bs"), ("query_id", "qs"))]
    base = indexed.join(sizes, "part").withColumn("b", spread[0]).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    wanted = asked.join(sizes, "part").withColumn("q", spread[1]).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)))

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, points = left["vec_id"].to_numpy(), unpacked(left["vector"])
            asks, queries = right["query_id"].to_numpy(), unpacked(right["asked"])
            squares = (points**2).sum(axis=1)
            for at in range(0, len(queries), 128):
                q, names = queries[at : at + 128], asks[at : at + 128]
                near = squares[None, :] - 2 * q @ points.T + (q**2).sum(axis=1)[:, None]
                near[names[:, None] == ids[None, :]] = np.inf
                if len(ids) > k:
                    edge = np.partition(near, k - 1, axis=1)[:, k - 1]
                    # all that rounding could put among the first k, ties included
                    keep = near <= (edge + 1e-9 * (1 + np.abs(edge) + squares.max()))[:, None]
                else:
                    keep = np.isfinite(near)
                x, y = np.nonzero(keep & np.isfinite(near))
                score = np.sqrt(((q[x] - points[y]) ** 2).sum(axis=1))
                order = np.lexsort((ids[y], score, x))
                x, y, score = x[order], y[order], score[order]
                place = np.arange(len(x)) - np.searchsorted(x, x)
                first = place < k
                out.append(pd.DataFrame({"query_id": names[x[first]], "vec_id": ids[y[first]], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["part", "b", "q"]
    renamed = wanted.select(*[F.col(c).alias(f"at_{c}") for c in keys], "query_id", "asked")
    found = base.select(*keys, "vec_id", "vector").groupBy(*keys).cogroup(renamed.groupBy(*[f"at_{c}" for c in keys]))
    found = found.applyInPandas(rank, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op2_neighbours")
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)

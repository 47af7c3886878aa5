"""Near-duplicates and neighbours of vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.llm import neardup, neighbours
from cubeloom.operators.components import min_labels

KIND = "vec_id long, embedding array<float>, label int"


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x.astype(np.float32))] + list(extra)
    return spark.createDataFrame(rows, KIND).repartition(4).withColumns({c: F.lit(1) for c in ("rep", "key", "part", "vector", "code", "n")})


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [None] + [1.0] * 15, 1), (9005, [float("nan")] * 16, 1), (9006, [float("inf")] * 16, 1)]


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((30, 16))
    x = np.concatenate([centres[rng.integers(0, 30, 500)] + 0.12 * rng.standard_normal((500, 16)), rng.standard_normal((200, 16))])
    return np.concatenate([x, x[:20], x[:5], x[:5] * 2])


@pytest.mark.parametrize("block", [neardup.BLOCK, 8])
def test_near_duplicates_match_brute_force(spark, crowd, block):
    x = crowd.astype(np.float32).astype(np.float64)
    got = {r["vec_id"]: r for r in neardup.near_duplicates(vectors(spark, crowd, ODD), block=block).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    cosine = unit @ unit.T
    near = cosine >= 0.95
    np.fill_diagonal(near, False)
    sure = np.abs(cosine - 0.95) > 1e-9
    assert sure.all()
    u, v = np.nonzero(near)
    roots = min_labels(len(x), u, v)
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), roots[i], roots[i] == i)
    for i, _, _ in ODD:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert len(got) == len(x) + len(ODD)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, factors = neardup.encode_vectors(x)
    estimate = neardup.sign_matrix(codes) @ neardup.turn(x).T / factors[:, None]
    error = (estimate - x @ x.T)[~np.eye(400, dtype=bool)]
    assert abs(error.mean()) < 0.002
    spread = neardup.error_bound(factors).mean() / neardup.SIGMAS
    assert 0.8 * spread < error.std() < 1.2 * spread
    assert (np.abs(error) < neardup.error_bound(factors).max()).all()


def test_bands_grow_with_the_rows():
    bits, bands = neardup.band_plan(10**6)
    assert bits > neardup.band_plan(1000)[0] and bands > neardup.band_plan(1000)[1]
    agree = (1 - np.arccos(0.95) / np.pi) ** bits
    assert (1 - agree) ** bands <= neardup.MISS


def test_no_vectors(spark):
    empty = spark.createDataFrame([], KIND)
    assert neardup.near_duplicates(empty).count() == 0
    assert neighbours.search(empty, F.col("vec_id") % 2 == 0).count() == 0
    odd = spark.createDataFrame(ODD, KIND)
    assert neardup.near_duplicates(odd).count() == len(ODD)
    assert neighbours.search(odd, F.lit(True)).count() == 0


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    x[:40] = x[0]
    df = vectors(spark, x, ODD)
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, sample_rows=2000).collect()
    x = x.astype(np.float32).astype(np.float64)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(abs(d[i] - s) < 1e-12 for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert hits / 1500 >= 0.9
    assert [i for _, i, _ in sorted(found[0])] == list(range(1, 11))  # ties go to the smaller id


def test_few_candidates_are_all_returned(spark):
    df = vectors(spark, np.eye(4, 16))
    got = neighbours.search(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2), (3, 3)]


def test_graph_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    part = neighbours.balanced_parts(neighbours.nearest(x, x, 8, skip_self=True), x, 6, rng)
    sizes = np.bincount(part, minlength=6)
    assert sizes.max() <= np.ceil(150 * 1.05) and sizes.min() >= 100

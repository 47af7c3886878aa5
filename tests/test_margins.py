"""Margin classifiers trained together: against plain descent, against one model at a time, odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.operators import classify, margins

SMALL = {"C": [1], "gamma": ["scale", 0.5], "kernel": ["rbf", "linear", "poly"], "degree": [2, 3], "class_weight": [None]}


def points(n=90, width=3, seed=4, classes=3, noise=0.8):
    """Overlapping clouds of unequal size."""
    rng = np.random.default_rng(seed)
    label = rng.choice(classes, n, p=np.arange(1, classes + 1) / sum(range(1, classes + 1)))
    return rng.normal(0, noise, (n, width)) + np.eye(classes, width)[label] * 1.5, label


def table(spark, x, label):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "pix long, label int, spectrum array<double>").repartition(3)


def loss(w, phi, sign, counts, cost):
    short = np.maximum(1 - sign * (phi @ w), 0)
    hinge = np.where(short < margins.ROUNDING, short**2 / (2 * margins.ROUNDING), short - margins.ROUNDING / 2)
    return 0.5 * (w[:-1] ** 2).sum() + cost * (counts * hinge).sum()


def descend(phi, sign, counts, cost):
    """Minimum of the loss by accelerated descent with a fixed step."""
    bound = cost * np.linalg.eigvalsh((phi * counts[:, None]).T @ phi)[-1] / margins.ROUNDING + 1
    w, before = np.zeros(phi.shape[1]), np.zeros(phi.shape[1])
    for k in range(20_000):
        ahead = w + k / (k + 3) * (w - before)
        short = np.maximum(1 - sign * (phi @ ahead), 0)
        slope = -cost * ((counts * sign * np.minimum(short / margins.ROUNDING, 1)) @ phi)
        slope[:-1] += ahead[:-1]
        before, w = w, ahead - slope / bound
    return loss(w, phi, sign, counts, cost)


def test_shared_training_reaches_the_minimum_of_every_classifier(spark):
    x, label = points()
    fold = np.arange(len(x)) % 2
    data = table(spark, x, label).withColumn("fold", (F.col("pix") % 2).cast("int"))
    held, classes, counts = margins._prepared(data, "spectrum", "label", "fold")
    weights = margins._balance(counts)
    assert classes == [0, 1, 2] and counts[:2].sum() == len(x)
    keys = [(("rbf", 0.5, 3), (2.0, False)), (("rbf", 0.5, 3), (0.2, True)), (("linear", 1.0, 3), (1.0, True))]
    (machines,) = margins._groups(keys, 3, 16, range(2), 3, 1)
    values = margins.train_machines(held, machines, weights, 120, 1e-9)
    for machine, value in zip(machines, values):
        phi = machine.mapped(x)
        for row in range(len(machine.cost)):
            k, c = machine.fold[row], machine.klass[row]
            out = fold != k
            share = np.array([out.sum() / (3 * (out & (label == j)).sum()) for j in label]) if machine.balanced[row] else np.ones(len(x))
            sign = np.where(label == c, 1.0, -1.0)
            best = descend(phi[out], sign[out], share[out], machine.cost[row])
            assert np.isclose(loss(machine.w[row], phi[out], sign[out], share[out], machine.cost[row]), value[row])
            assert value[row] <= best * (1 + 1e-3) + 1e-6


def test_search_equals_one_model_at_a_time(spark):
    x, label = points(n=60)
    df = table(spark, x, label).cache()
    grid = {"C": [2], "gamma": ["scale"], "kernel": ["rbf", "linear"], "class_weight": ["balanced"]}
    got = {(r["C"], r["kernel"]): r["accuracy"] for r in margins.margin_search(df, "pix", grid=grid, folds=2, size=16, max_iter=30, tol=1e-9).collect()}
    folded = classify.stratified_folds(df, "pix", "label", 2).cache()
    gamma, _ = classify.kernel_gamma(df, "scale", "spectrum")
    for (cost, kernel), accuracy in got.items():
        scores = []
        for k in range(2):
            setting = {"C": cost, "gamma": gamma, "kernel": kernel, "class_weight": "balanced"}
            model = margins.margin_classifier(folded.filter(F.col("fold") != k), size=16, max_iter=30, tol=1e-9, **setting)
            held = model.transform(folded.filter(F.col("fold") == k))
            scores.append(held.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0])
        assert abs(accuracy - np.mean(scores)) < 0.05  # rows on a border may change sides


def test_every_combination_is_scored_whatever_the_groups(spark, monkeypatch):
    x, label = points(n=48)
    df = table(spark, x, label).cache()
    whole = {tuple(r)[:-1]: r["accuracy"] for r in margins.margin_search(df, "pix", grid=SMALL, folds=2, size=12, max_iter=12).collect()}
    assert len(whole) == 2 * 3 * 2 and min(whole.values()) > 0.3 and max(whole.values()) > 0.7
    for (cost, gamma, kernel, degree, weight), value in whole.items():
        if kernel == "linear":
            assert value == whole[cost, "0.5", kernel, 2, weight]
    monkeypatch.setattr(margins, "GROUP_WEIGHTS", 250)
    parts = {tuple(r)[:-1]: r["accuracy"] for r in margins.margin_search(df, "pix", grid=SMALL, folds=2, size=12, max_iter=12).collect()}
    assert parts.keys() == whole.keys() and all(abs(parts[k] - whole[k]) < 0.05 for k in whole)


def test_odd_tables(spark):
    x, label = points(n=40)
    df = table(spark, x, label)
    grid = {"C": [1], "kernel": ["linear"]}
    assert margins.margin_search(df.filter("pix < 0"), "pix", grid=grid, max_iter=12).count() == 0
    one = margins.margin_search(df.withColumn("label", F.lit(7)), "pix", grid=grid, max_iter=12).first()
    assert one["accuracy"] == 1.0
    odd = df.unionByName(spark.createDataFrame([(100, None, [1.0, 1.0, 1.0]), (101, 1, None)], df.schema))
    assert margins.margin_search(odd, "pix", grid=grid, max_iter=12).collect() == margins.margin_search(df, "pix", grid=grid, max_iter=12).collect()
    same = df.withColumn("spectrum", F.array(*[F.lit(0.0)] * 3))  # repeated rows: the largest class wins
    most = max(np.bincount(label)) / len(label)
    assert abs(margins.margin_search(same, "pix", grid=grid, folds=2, max_iter=12).first()["accuracy"] - most) < 0.1
    with pytest.raises(ValueError):
        margins.margin_search(df, "pix", grid={"rows": [1]})
    with pytest.raises(ValueError):
        margins.margin_classifier(df.filter("pix < 0"))


def test_map_by_the_trained_model(spark):
    x, label = points(n=60, classes=2, noise=0.3)
    df = table(spark, x * 3, label + 5).withColumn("valid", F.col("pix") != 3)
    model = margins.margin_classifier(df, kernel="poly", degree=2, size=16)
    got = {r["pix"]: r["label"] for r in classify.predict_map(model, df.drop("label")).collect()}
    assert got.pop(3) == -1 and set(got.values()) == {5, 6}
    assert np.mean([v == label[k] + 5 for k, v in got.items()]) > 0.85

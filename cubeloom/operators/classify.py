"""Per-pixel classifiers on Spark ML and their application to scenes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.operators.moments import collect_moments
from cubeloom.operators.ranking import number_rows
from cubeloom.operators.reduce import DOUBLES, map_vectors

# The forest grid. A split-size limit has no counterpart in Spark's trees (search.py cuts trees instead);
# unlimited depth becomes Spark's maximum of 30.
FOREST_GRID = {
    "numTrees": [50, 100, 200],
    "maxDepth": [30, 10, 20],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}
# The margin-classifier grids, full and reduced; the caller chooses. degree counts for the poly kernel only.
SVM_GRID = {"C": [0.1, 1, 10, 100], "gamma": ["scale", "auto", 0.01, 0.1, 1], "kernel": ["rbf", "linear", "poly"],
            "degree": [2, 3, 4], "class_weight": [None, "balanced"]}
SVM_GRID_SMALL = {"C": [0.1, 1, 10], "gamma": ["scale", "auto", 0.1], "kernel": ["rbf", "linear"], "class_weight": [None]}
KERNELS = ("rbf", "linear", "poly")


def with_features(df: DataFrame, vector: str = "spectrum", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(vector).cast("array<double>")))


def stratified_folds(df: DataFrame, ident: str, label: str = "label", folds: int = 3, name: str = "fold") -> DataFrame:
    """Adds a fold number that cycles inside every class (distributed numbering)."""
    numbered = number_rows(df.select(label, ident), ident, "_i", [label]).select(
        ident, ((F.col("_i") - 1) % folds).cast("int").alias(name)
    )
    return df.join(numbered, ident)


def random_forest(train: DataFrame, vector: str = "spectrum", label: str = "label", trees: int = 100, depth: int = 10,
                  seed: int = 42) -> Model:
    """Random forest with the default size."""
    forest = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(with_features(train, vector))


def param_maps(estimator: Estimator, grid: dict[str, Sequence]) -> list[dict]:
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def grid_search(
    train: DataFrame, estimator: Estimator, grid: dict[str, Sequence], ident: str, vector: str = "spectrum",
    label: str = "label", folds: int = 3, parallelism: int = 4,
) -> CrossValidatorModel:
    """Exhaustive search by cross-validated accuracy on stratified folds."""
    scorer = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=param_maps(estimator, grid), evaluator=scorer, numFolds=folds,
        foldCol="fold", parallelism=parallelism,
    )
    return search.fit(stratified_folds(with_features(train, vector), ident, label, folds))


def grid_results(model: CrossValidatorModel) -> list[tuple[dict, float]]:
    """(parameters, mean accuracy) of every combination, best first."""
    results = [
        ({p.name: v for p, v in params.items()}, score)
        for params, score in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return sorted(results, key=lambda r: -r[1])


class KernelMap:
    """Explicit features of a kernel: random Fourier features (rbf), all products (poly, degree 2) or products of random signs (poly above)."""

    def __init__(self, kernel: str, gamma: float, width: int, size: int, seed: int, degree: int = 3):
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}")
        rng = np.random.default_rng(seed)
        if degree < 1:
            raise ValueError("degree is at least 1")
        self.kernel, self.gamma, self.degree = kernel, gamma, degree
        self.signs = rng.choice([-1.0, 1.0], (degree, width, size)) if kernel == "poly" and degree != 2 else None
        self.w = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, size)) if kernel == "rbf" else None
        self.b = rng.uniform(0.0, 2.0 * np.pi, size) if kernel == "rbf" else None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.kernel == "linear":
            return x
        if self.kernel == "poly" and self.signs is not None:
            # the mean of the products over random signs is (gamma x.y) ** degree
            out = np.full((len(x), self.signs.shape[2]), np.sqrt(self.gamma**self.degree / self.signs.shape[2]))
            for signs in self.signs:
                out *= x @ signs
            return out
        if self.kernel == "poly":
            i, j = np.triu_indices(x.shape[1])
            return self.gamma * np.where(i == j, 1.0, np.sqrt(2.0)) * x[:, i] * x[:, j]
        return np.sqrt(2.0 / self.w.shape[1]) * np.cos(x @ self.w + self.b)


class SvmModel:
    """Kernel features followed by one margin classifier per class."""

    def __init__(self, features: KernelMap, model: Model, vector: str):
        self.features, self.model, self.vector = features, model, vector

    def transform(self, df: DataFrame) -> DataFrame:
        mapped = map_vectors(df, self.vector, "_mapped", self.features, DOUBLES)
        return self.model.transform(with_features(mapped, "_mapped")).drop("_mapped", "features")


def kernel_gamma(train: DataFrame, gamma: str | float, vector: str) -> tuple[float, int]:
    """Numeric gamma and the vector width; "scale" is 1 / (width * variance of all values)."""
    m = collect_moments(train, vector)
    width = len(m.mean)
    if gamma == "auto":
        return 1.0 / width, width
    if gamma == "scale":
        square = np.diag(m.cov).mean() * (m.n - 1) / m.n + (m.mean**2).mean()
        variance = square - m.mean.mean() ** 2
        return (1.0 / (width * variance) if variance > 0 else 1.0), width
    return float(gamma), width


def svm_classifier(
    train: DataFrame, vector: str = "spectrum", label: str = "label", kernel: str = "rbf", C: float = 10.0,
    gamma: str | float = "scale", class_weight: str | None = None, size: int = 256, seed: int = 42, max_iter: int = 50,
    degree: int = 3,
) -> SvmModel:
    """Margin classifier; the rbf kernel and polynomials of other degrees than 2 are approximated by random features."""
    value, width = kernel_gamma(train, gamma, vector)
    features = KernelMap(kernel, value, width, size, seed, degree)
    mapped = with_features(map_vectors(train.select(label, vector), vector, "_mapped", features, DOUBLES), "_mapped")
    counts = {r[label]: r["n"] for r in mapped.groupBy(label).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    base = LinearSVC(maxIter=max_iter, regParam=1.0 / (C * total), featuresCol="features", labelCol=label)
    judge = OneVsRest(classifier=base, labelCol=label, featuresCol="features")
    if class_weight == "balanced":
        weight = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, total / (len(counts) * n))])
        mapped = mapped.withColumn("_w", weight[F.col(label)])
        judge = judge.setWeightCol("_w")
    return SvmModel(features, judge.fit(mapped.drop("_mapped").persist()), vector)


def svm_grid_search(
    train: DataFrame, ident: str, vector: str = "spectrum", label: str = "label", grid: dict = SVM_GRID,
    folds: int = 3, size: int = 256, max_iter: int = 50,
) -> list[tuple[dict, float]]:
    """(parameters, mean accuracy) over stratified folds, best first; all combinations are trained together (margins.py)."""
    from cubeloom.operators.margins import margin_search

    scores = margin_search(train, ident, vector, label, grid, folds, size, max_iter=max_iter).collect()
    results = [({name: r[name] for name in r.asDict() if name != "accuracy"}, r["accuracy"]) for r in scores]
    return sorted(results, key=lambda r: -r[1])


def predict_map(model, pixels: DataFrame, vector: str = "spectrum", valid: str = "valid") -> DataFrame:
    """class_map: the model's label for valid pixels, -1 for background."""
    known = pixels.filter(F.col(valid))
    scored = model.transform(known if isinstance(model, SvmModel) else with_features(known, vector))
    columns = [c for c in pixels.columns if c not in (vector, valid)]
    labelled = scored.select(*columns, F.col("prediction").cast("int").alias("label"))
    return labelled.unionByName(pixels.filter(~F.col(valid)).select(*columns, F.lit(-1).alias("label")))

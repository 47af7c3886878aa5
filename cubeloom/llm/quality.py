"""Quality classifier by co-training of two views.

One classifier sees what the text is made of, the other what is recorded about the page (source, language, length). Both start
from the same labelled sample; in each round each gives its most confident guesses on unlabelled documents to the other as
pseudo-labels. Both are calibrated on labels held out from training, and the calibrated views are combined into the score of every
document. The samples are bounded parameters; the features are taken from whole texts.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import free_name, mixed_key, query, table
from cubeloom.llm.tokens import lean

SEED = 3
#: Labelled and unlabelled documents that the classifiers are fitted on.
LABELLED = 8_000
UNLABELLED = 8_000
ROWS = 1_000  # scored at a time
ROUNDS = 4
SHARE = 0.1  # of the pool that a view may hand over in a round
CONFIDENT = 0.97
THRESHOLD = 0.5
SOURCES, LANGS = 64, 16
TEXT_FEATURES, PAGE_FEATURES = 256 + 10, SOURCES + LANGS + 12
SCORES = "text_score double, page_score double, score double"


def text_view(texts: list[str | None]) -> np.ndarray:
    """Rows of features of the whole text: byte shares, kinds of characters, repetition and word shape."""
    out = np.zeros((len(texts), TEXT_FEATURES))
    for row, text in zip(out, texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            row[-1] = 1
            continue
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        row[:256] = np.sqrt(counts / len(data))
        upper, lower = counts[65:91].sum(), counts[97:123].sum()
        words = data.split()
        n = max(len(words), 1)
        lines = counts[10] + 1
        marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
        row[256:265] = (
            upper / max(upper + lower, 1), marks / n, (upper + lower) / len(data), counts[48:58].sum() / len(data),
            sum(map(operator.eq, words, words[1:])) / n, np.log(max(len(set(words)), 1)) / np.log(n + 1), len(data) / n / 10,
            np.log1p(n / lines), counts[128:].sum() / len(data),
        )
    return out


def page_view(langs: list, sources: list, lengths: list) -> np.ndarray:
    """Rows of features of the recorded metadata; null has a place of its own."""
    n = len(langs)
    out = np.zeros((n, PAGE_FEATURES))
    rows = np.arange(n)
    for at, size, values in ((0, SOURCES, sources), (SOURCES, LANGS, langs)):
        spots = [0 if v is None or v != v else 1 + zlib.crc32(str(v).encode()) % (size - 1) for v in values]
        out[rows, at + np.array(spots, int)] = 1
    known = np.array([-1.0 if v is None or v != v else max(float(v), 0.0) for v in lengths])
    logs = np.log1p(np.maximum(known, 0))
    at = SOURCES + LANGS
    out[:, at] = logs / 10
    out[:, at + 1] = known < 0
    out[rows, at + 2 + np.clip(logs - 3, 0, 9).astype(int)] = 1
    return out


@dataclass(frozen=True)
class View:
    """Standardised logistic regression with a calibrated log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (((x - self.mean) * self.scale) @ self.weights + self.bias) + self.shift


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Weights and bias by damped Newton steps."""
    one = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(one.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = sigmoid(one @ w)
        slope = one.T @ (p - y) + penalty * w
        curve = (one * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ one + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(np.abs(one @ step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> View:
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-9, 1 / np.maximum(spread, 1e-9), 0.0)
    weights, bias = logistic((x - mean) * scale, y, ridge)
    return View(mean, scale, weights, bias)


def calibrated(view: View, x: np.ndarray, y: np.ndarray) -> View:
    """The view with slope and shift fitted to held-out labels."""
    weights, bias = logistic(view.odds(x)[:, None], y, 1e-3)
    return View(view.mean, view.scale, view.weights, view.bias, float(weights[0]), bias)


@dataclass(frozen=True)
class Model:
    text: View | None
    page: View | None
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = 0.0

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return tuple(np.ones(len(text)) for _ in range(3))
        a, b = self.text.odds(text), self.page.odds(page)
        return sigmoid(a), sigmoid(b), sigmoid(self.weights[0] * a + self.weights[1] * b + self.bias)


def cotrain(text: np.ndarray, page: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray,
            rounds: int = ROUNDS, seed: int = SEED) -> Model:
    """The model of a labelled sample (y 0 or 1) and an unlabelled pool; without labels of both classes every document scores 1.

    Of each class a fifth, and one label at least, is held out to calibrate the views; a class of a single label trains and calibrates.
    """
    if len(np.unique(y)) < 2:
        return Model(None, None)
    order = np.random.default_rng(seed).permutation(len(y))
    classes = [order[y[order] == label] for label in (0, 1)]
    cuts = [max(1, len(c) // 5) for c in classes]
    held = np.concatenate([c[:n] for c, n in zip(classes, cuts)])
    train = np.concatenate([c[n:] if len(c) > n else c for c, n in zip(classes, cuts)])
    views = (text, page)
    pools = (pool_text, pool_page)
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0)) for _ in views]  # pool rows and pseudo-labels
    fitted: list[View] = []
    for turn in range(rounds + 1):
        fitted = []
        for x, pool, (rows, guesses) in zip(views, pools, given):
            view = fit_view(np.concatenate([x[train], pool[rows]]), np.concatenate([y[train], guesses]))
            fitted.append(calibrated(view, x[held], y[held]))
        if turn == rounds or not len(pool_text):
            break
        for giver, taker in ((0, 1), (1, 0)):
            p = sigmoid(fitted[giver].odds(pools[giver]))
            taken = np.isin(np.arange(len(p)), given[taker][0])
            rows, guesses = [given[taker][0]], [given[taker][1]]
            for label, sure in ((1, p), (0, 1 - p)):
                # each class by its share of the labels, the surest first
                room = int(SHARE * len(p) * (y[train] == label).mean()) + 1
                best = np.argsort(-sure, kind="stable")
                best = best[(sure[best] >= CONFIDENT) & ~taken[best]][:room]
                rows.append(best)
                guesses.append(np.full(len(best), float(label)))
            given[taker] = (np.concatenate(rows), np.concatenate(guesses))
    both = np.column_stack([v.odds(x[held]) for v, x in zip(fitted, views)])
    weights, bias = logistic(both, y[held], 1.0)
    return Model(fitted[0], fitted[1], (float(weights[0]), float(weights[1])), bias)


def _views(df: DataFrame) -> list[Column]:
    return [F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars").cast("double")]


def _sample_features(docs: DataFrame, ids: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of the documents of a bounded list of ids; ``ids`` holds doc_id and quality."""

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                both = np.column_stack([text_view(f["text"].tolist()), page_view(f["lang"].tolist(), f["source"].tolist(), f["n_chars"].tolist())])
                yield pd.DataFrame({"quality": f["quality"], "x": [r.tobytes() for r in both.astype("<f4")]})

    rows = docs.select(F.col("doc_id").cast("long"), *_views(docs)).join(F.broadcast(ids), "doc_id")  # at most ``most`` ids
    # one row of an id that repeats: the smallest, so that reruns agree and no more than ``most`` reach the driver
    views = [c for c in rows.columns if c not in ("doc_id", "quality")]
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", *views)).alias("r")).select("doc_id", "r.*").orderBy("doc_id")
    found = rows.select("quality", *views).mapInPandas(features, "quality double, x binary").toPandas()
    split = TEXT_FEATURES
    x = np.frombuffer(b"".join(found["x"]), "<f4").reshape(len(found), split + PAGE_FEATURES).astype(np.float64)
    return x[:, :split], x[:, split:], found["quality"].to_numpy(np.float64)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, seed: int = SEED) -> Model:
    """Co-trains on bounded samples, drawn by a hash of doc_id. A document with any label 0 counts as 0; null labels are no labels."""
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("double").alias("quality")
    )
    order = [mixed_key(seed, "doc_id"), F.col("doc_id")]
    sample = known.orderBy(*order).limit(labelled)
    others = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").join(known, "doc_id", "left_anti")
    pool = others.orderBy(*order).limit(unlabelled).distinct().withColumn("quality", F.lit(None).cast("double"))
    text, page, y = _sample_features(docs, sample, labelled)
    pool_text, pool_page, _ = _sample_features(docs, pool, unlabelled)
    return cotrain(text, page, y, pool_text, pool_page, seed=seed)


def with_scores(docs: DataFrame, model: Model, name: str = "_quality") -> DataFrame:
    """Adds a struct of text_score, page_score and score to every document."""
    told = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    @F.pandas_udf(SCORES)
    def score(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def scored(columns: Iterator) -> Iterator[pd.DataFrame]:
            for batch in columns:
                parts = []
                for at in range(0, max(len(batch[0]), 1), ROWS):
                    text, *page = (c.iloc[at : at + ROWS].tolist() for c in batch)
                    parts.append(np.column_stack(told.value.score(text_view(text), page_view(*page))))
                yield pd.DataFrame(np.concatenate(parts), columns=["text_score", "page_score", "score"])

        yield from lean(scored)(columns)

    return docs.withColumn(name, score(*_views(docs)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, page_score, score, keep per document row.

    Null texts and metadata have features of their own and are scored like any other; null ids are kept; repeated rows get equal
    scores; without labels of both classes every document scores 1; columns besides those of documents are not read.
    """
    name = free_name("_quality", docs.columns)
    scored = with_scores(docs, fit(docs, labels), name)
    return scored.select("doc_id", f"{name}.*", (F.col(name)["score"] >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches ``threshold``, with their own columns."""
    name = free_name("_quality", docs.columns)
    return with_scores(docs, fit(docs, labels), name).filter(F.col(name)["score"] >= threshold).select(*docs.columns)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

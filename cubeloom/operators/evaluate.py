"""Confusion tables, scores and log statistics."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.operators.ranking import ranged

# Fixed value: half width of the 95 % band in standard deviations.
CONFIDENCE_Z = 1.96


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Pixels per class plus the total (label null)."""
    return df.rollup(label).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """cm(truth, pred, n) over every pair of occurring labels (classes x classes rows)."""
    counts = df.groupBy(truth, pred).agg(F.count("*").alias("n"))
    both = F.array_sort(F.array_union(F.collect_set(truth), F.collect_set(pred)))
    domain = counts.agg(both.alias("_labels"))
    cells = domain.select(F.explode("_labels").alias(truth), "_labels").select(truth, F.explode("_labels").alias(pred))
    return cells.join(counts, [truth, pred], "left").select(
        truth, pred, F.coalesce("n", F.lit(0).cast("long")).alias("n")
    )


def confusion_percent(cm: DataFrame, mode: str = "precision", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Adds share: of the true class (recall) or of the predicted class (precision); 0 when empty."""
    if mode not in ("recall", "precision"):
        raise ValueError("mode is 'recall' or 'precision'")
    total = F.sum("n").over(Window.partitionBy(truth if mode == "recall" else pred))
    return cm.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("n") / total))


def _margins(cm: DataFrame, truth: str, pred: str) -> DataFrame:
    rows = cm.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"))
    cols = cm.groupBy(F.col(pred).alias("label")).agg(F.sum("n").alias("predicted"))
    hits = cm.filter(F.col(truth) == F.col(pred)).select(F.col(truth).alias("label"), F.col("n").alias("hit"))
    return rows.join(cols, "label").join(hits, "label")


def accuracy_kappa(cm: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row: n, accuracy and Cohen's kappa."""
    sums = _margins(cm, truth, pred).agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hit"), F.sum(F.col("support") * F.col("predicted")).alias("chance")
    )
    accuracy = F.col("hit") / F.col("n")
    expected = F.col("chance") / (F.col("n") * F.col("n"))
    return sums.select("n", accuracy.alias("accuracy"), ((accuracy - expected) / (1 - expected)).alias("kappa"))


def class_report(cm: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """report(name, precision, recall, f1, support): one row per class, macro and weighted means."""

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole == 0, 0.0).otherwise(part / whole)

    m = _margins(cm, truth, pred)
    precision, recall = share(F.col("hit"), F.col("predicted")), share(F.col("hit"), F.col("support"))
    f1 = share(2 * F.col("hit"), F.col("predicted") + F.col("support"))
    per_class = m.select(
        F.col("label").cast("string").alias("name"), precision.alias("precision"), recall.alias("recall"),
        f1.alias("f1"), "support",
    )
    scores = ("precision", "recall", "f1")
    macro = per_class.agg(*[F.avg(s).alias(s) for s in scores], F.sum("support").alias("support"))
    weight = F.sum("support")
    weighted = per_class.agg(
        *[(F.sum(F.col(s) * F.col("support")) / weight).alias(s) for s in scores], weight.alias("support")
    )
    names = ["name", *scores, "support"]
    return per_class.unionByName(macro.withColumn("name", F.lit("macro avg")).select(names)).unionByName(
        weighted.withColumn("name", F.lit("weighted avg")).select(names)
    )


def evaluate_model(df: DataFrame, truth: str = "truth", pred: str = "pred") -> dict[str, DataFrame]:
    """All evaluation tables of a prediction frame."""
    cm = confusion_matrix(df, truth, pred)
    return {"matrix": cm, "scores": accuracy_kappa(cm, truth, pred), "report": class_report(cm, truth, pred)}


def topk_accuracy(df: DataFrame, ks: Sequence[int], logits: str = "logits", label: str = "label") -> DataFrame:
    """topk(k, accuracy): percentage of rows whose label is among the k largest logits.

    The rank of the target is a count inside the array: equal logits go by position.
    """
    target = F.get(F.col(logits), F.col(label))
    ahead = F.aggregate(
        F.transform(
            logits,
            lambda x, i: ((x > target) | ((x == target) & (i < F.col(label)))).cast("int"),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    hits = df.select(ahead.alias("_rank")).agg(
        *[(F.avg((F.col("_rank") < k).cast("double")) * 100.0).alias(f"k{k}") for k in ks]
    )
    pairs = F.array(*[F.struct(F.lit(int(k)).alias("k"), F.col(f"k{k}").alias("accuracy")) for k in ks])
    return hits.select(F.explode(pairs).alias("_p")).select("_p.*")


def weighted_mean(df: DataFrame, value: str, weight: str, groups: Sequence[str] = ()) -> DataFrame:
    """Count-weighted mean of batch values."""
    total = F.sum(F.col(value) * F.col(weight))
    return df.groupBy(*groups).agg((total / F.sum(weight)).alias("avg"), F.sum(weight).alias("count"))


def weighted_running_mean(df: DataFrame, order: str, value: str, weight: str) -> DataFrame:
    """Adds avg: the weighted mean up to each row of a unique order column.

    Running sums restart in every value range and are shifted by the totals of earlier ranges, so
    no task sees the whole log.
    """
    bucketed = ranged(df, order)
    product = F.col(value) * F.col(weight)
    totals = bucketed.groupBy("_b").agg(F.sum(product).alias("_s"), F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_b",
        F.coalesce(F.sum("_s").over(earlier), F.lit(0.0)).alias("_s0"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_w0"),
    )
    upto = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = bucketed.withColumn("_s", F.sum(product).over(upto)).withColumn("_w", F.sum(weight).over(upto))
    joined = running.join(offsets, "_b")
    return joined.withColumn("avg", (F.col("_s") + F.col("_s0")) / (F.col("_w") + F.col("_w0"))).drop(
        "_b", "_s", "_w", "_s0", "_w0"
    )


def curve_confidence(df: DataFrame, vector: str = "spectrum", flag: str = "flag") -> DataFrame:
    """curve(band, mean, lower, upper): 95 % band of the kept samples (flag = 1)."""
    from cubeloom.operators.reduce import mean_std

    stats = mean_std(df.filter(F.col(flag) == 1), vector)
    bands = stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("band", "_e"))
    half = F.lit(CONFIDENCE_Z) * F.col("_e.std")
    mean = F.col("_e.mean")
    return bands.select("band", mean.alias("mean"), (mean - half).alias("lower"), (mean + half).alias("upper"))


def masked_infonce(
    df: DataFrame, batch_size: int, pair: str = "pair_id", view: str = "view", vector: str = "v",
    temperature: float = 0.07, threshold: float | None = 0.9,
) -> DataFrame:
    """score(batch, pair, view, loss): contrastive score of every row against its batch.

    ``view`` is 0 or 1; the other view of a pair is the positive, all other rows of the batch are
    negatives, and negatives more similar than ``threshold`` leave the soft-max. A batch holds
    ``batch_size`` consecutive pairs by construction, so its similarity matrix is bounded; a
    repeated (pair, view) is an error.
    """
    key = F.floor(F.col(pair) / batch_size).cast("long")

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > 2 * batch_size:
            raise ValueError("a pair holds a view twice")
        pdf = pdf.sort_values(["_pair", "_view"], ignore_index=True)
        x = np.stack(pdf["_v"].to_numpy()).astype(float)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cosine = x @ x.T
        logits = cosine / temperature
        same = pdf["_pair"].to_numpy()[:, None] == pdf["_pair"].to_numpy()[None, :]
        other = ~np.eye(len(pdf), dtype=bool)
        used = other if threshold is None else other & (same | ~(cosine > threshold))
        top = np.where(other, logits, -np.inf).max(axis=1)
        mass = np.where(used, np.exp(logits - top[:, None]), 0.0)
        hit = (mass * (same & other)).sum(axis=1)
        return pd.DataFrame(
            {"batch": pdf["_batch"], pair: pdf["_pair"], view: pdf["_view"], "loss": -np.log(hit / mass.sum(axis=1))}
        )

    slim = df.select(
        key.alias("_batch"), F.col(pair).cast("long").alias("_pair"), F.col(view).cast("int").alias("_view"),
        F.col(vector).alias("_v"),
    )
    return slim.groupBy("_batch").applyInPandas(score, f"batch long, {pair} long, {view} int, loss double")

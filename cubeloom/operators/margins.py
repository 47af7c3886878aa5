"""Many margin classifiers trained together.

All settings of a grid, folds and classes that share a kernel map are columns of one weight matrix. One pass over the rows maps each
row once per kernel, adds up the loss and the slope of every classifier in the task, and Spark adds the tasks' sums per classifier;
the weights then move by a quasi-Newton step each. The rows themselves stay on the executors.

A classifier of class c minimises |w|^2 / 2 + C * sum of the rows' weighted hinge losses, one class against the rest, with a free
constant; the hinge is rounded over ROUNDING so that it has a slope. The polynomial kernel's gamma only scales its features, so a
setting of it is one of gamma 1 with C * gamma^degree.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.operators.classify import SVM_GRID, KernelMap, SvmModel, kernel_gamma, stratified_folds
from cubeloom.operators.moments import list_array, matrix_of
from cubeloom.operators.reduce import DOUBLES, map_vectors
from cubeloom.session import cut_lineage

#: Width of the rounded corner of the hinge.
ROUNDING = 0.2
#: Weights trained at once (at least one setting); the steps a classifier remembers hold 2 * MEMORY times as many on the driver.
GROUP_WEIGHTS = 1_000_000
MEMORY = 6
#: Rows per task, margins of one step of a task.
TASK_ROWS = 20_000
STEP_VALUES = 2_000_000
DEFAULTS = {"C": 10.0, "gamma": "scale", "kernel": "rbf", "degree": 3, "class_weight": None}


def grid_settings(grid: dict[str, Sequence]) -> list[dict]:
    """Every combination of the grid, absent parameters at their defaults."""
    unknown = set(grid) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    full = {name: list(grid.get(name, [value])) for name, value in DEFAULTS.items()}
    return [dict(zip(full, values)) for values in itertools.product(*full.values())]


class Machine:
    """The classifiers of some settings over one kernel map: one per (setting, fold, class), in this order."""

    def __init__(self, features: KernelMap, width: int, names: Sequence[tuple], folds: Sequence[int], classes: int):
        self.features, self.names, self.folds, self.classes = features, list(names), np.array(folds), classes
        per_setting = len(folds) * classes
        self.cost = np.repeat([n[0] for n in names], per_setting).astype(float)
        self.balanced = np.repeat([n[1] for n in names], per_setting)
        self.fold = np.tile(np.repeat(self.folds, classes), len(names))
        self.klass = np.tile(np.arange(classes), len(names) * len(folds))
        self.w = np.zeros((len(self.cost), width + 1))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        """Kernel features and the constant."""
        features = self.features(x)
        return np.column_stack([features, np.ones(len(features))])


def _machine_parts(machine: Machine, rows: np.ndarray, x: np.ndarray, label: np.ndarray, fold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(classifiers, 1 + width + 1): loss and slope of the classifiers ``rows`` over these table rows, without their cost."""
    w, out = machine.w[rows], np.zeros((len(rows), 1 + machine.w.shape[1]))
    step = max(1, STEP_VALUES // max(1, len(rows)))
    for begin in range(0, len(x), step):
        part = slice(begin, begin + step)
        phi = machine.mapped(x[part])
        sign = np.where(label[part, None] == machine.klass[rows], 1.0, -1.0)
        counts = np.where(machine.balanced[rows], weights[machine.fold[rows][None, :], label[part, None]], 1.0)
        counts = counts * (fold[part, None] != machine.fold[rows])
        short = np.maximum(1.0 - sign * (phi @ w.T), 0.0)
        out[:, 0] += (counts * np.where(short < ROUNDING, short**2 / (2 * ROUNDING), short - ROUNDING / 2)).sum(axis=0)
        out[:, 1:] -= (counts * sign * np.minimum(short / ROUNDING, 1.0)).T @ phi
    return out


def _evaluate(data: DataFrame, machines: Sequence[Machine], active: Sequence[np.ndarray], weights: np.ndarray) -> list[np.ndarray]:
    """Loss and slope of the active classifiers of every machine over all rows, in one pass."""
    told = data.sparkSession.sparkContext.broadcast((machines, active, weights))  # GROUP_WEIGHTS numbers

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, active, weights = told.value
        held = [np.zeros((len(rows), 1 + m.w.shape[1])) for m, rows in zip(machines, active)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, label, fold = matrix_of(batch.column("v")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for total, machine, rows in zip(held, machines, active):
                if len(rows):
                    total += _machine_parts(machine, rows, x, label, fold, weights)
        for i, (total, rows) in enumerate(zip(held, active)):
            if len(rows):
                columns = [pa.array(np.full(len(rows), i, np.int32)), pa.array(rows.astype(np.int32)), list_array(total)]
                yield pa.RecordBatch.from_arrays(columns, names=["machine", "row", "part"])

    def add(table: pa.Table) -> pa.Table:
        summed = matrix_of(table.column("part")).sum(axis=0, keepdims=True)
        return pa.table([table.column(c).slice(0, 1) for c in ("machine", "row")] + [list_array(summed)], names=table.column_names)

    kind = "machine int, row int, part array<double>"
    found = data.mapInArrow(sums, kind).groupBy("machine", "row").applyInArrow(add, kind).toArrow()
    machine, row, out = found.column("machine").to_numpy(), found.column("row").to_numpy(), []
    parts = found.column("part").combine_chunks()
    for i, rows in enumerate(active):
        here = np.flatnonzero(machine == i)
        here = here[np.argsort(row[here])]
        out.append(matrix_of(parts.take(pa.array(here))) if len(rows) else np.zeros((0, 1 + machines[i].w.shape[1])))
    told.destroy()
    return out


class Steps:
    """Limited-memory quasi-Newton steps of a machine's classifiers, each with its own length and history."""

    def __init__(self, machine: Machine):
        self.machine = machine
        n, width = machine.w.shape
        self.at, self.value, self.slope = machine.w.copy(), np.full(n, np.inf), np.zeros((n, width))
        self.move, self.length, self.halved = np.zeros((n, width)), np.ones(n), np.zeros(n, int)
        self.s, self.y, self.rho = np.zeros((MEMORY, n, width)), np.zeros((MEMORY, n, width)), np.zeros((MEMORY, n))
        self.live = np.ones(n, bool)

    def take(self, rows: np.ndarray, parts: np.ndarray, tol: float) -> None:
        """Uses the loss and slope at the present trial weights of ``rows`` and sets the next trial weights."""
        m = self.machine
        cost = m.cost[rows]
        trial = m.w[rows]
        flat = trial.copy()
        flat[:, -1] = 0.0  # the constant is free
        value = 0.5 * (flat**2).sum(axis=1) + cost * parts[:, 0]
        slope = flat + cost[:, None] * parts[:, 1:]
        first = ~np.isfinite(self.value[rows])
        promised = 1e-4 * self.length[rows] * (self.slope[rows] * self.move[rows]).sum(axis=1)
        with np.errstate(invalid="ignore"):
            good = first | (value <= self.value[rows] + promised)
        bad = rows[~good]
        self.halved[bad] += 1
        self.length[bad] *= 0.3
        lost = bad[self.halved[bad] > 20]  # no step gains anything more
        self.live[lost] = False
        won, value, slope, trial, first = rows[good], value[good], slope[good], trial[good], first[good]
        gain = self.value[won] - value
        s, y = trial - self.at[won], slope - self.slope[won]
        curve = (s * y).sum(axis=1)
        keep = ~first & (curve > 1e-12 * (y * y).sum(axis=1))
        kept = won[keep]
        for store, fresh in ((self.s, s[keep]), (self.y, y[keep]), (self.rho, 1.0 / curve[keep])):
            store[:-1, kept] = store[1:, kept]
            store[-1, kept] = fresh
        self.at[won], self.value[won], self.slope[won] = trial, value, slope
        self.halved[won], self.length[won] = 0, 1.0
        self.live[won[~first & (gain <= tol * np.maximum(np.abs(value), 1.0))]] = False
        self.live[won[(slope**2).sum(axis=1) == 0.0]] = False
        self._aim(won)
        fresh = won[first]
        self.length[fresh] = 1.0 / np.maximum(1.0, np.sqrt((self.slope[fresh] ** 2).sum(axis=1)))
        m.w[rows] = self.at[rows] + (self.live[rows] * self.length[rows])[:, None] * self.move[rows]

    def _aim(self, rows: np.ndarray) -> None:
        q, shares = self.slope[rows].copy(), np.zeros((MEMORY, len(rows)))
        for h in reversed(range(MEMORY)):
            shares[h] = self.rho[h, rows] * (self.s[h, rows] * q).sum(axis=1)
            q -= shares[h][:, None] * self.y[h, rows]
        last = (self.y[-1, rows] ** 2).sum(axis=1) * self.rho[-1, rows]
        q *= np.where(last > 0, 1.0 / np.where(last > 0, last, 1.0), 1.0)[:, None]
        for h in range(MEMORY):
            q += (shares[h] - self.rho[h, rows] * (self.y[h, rows] * q).sum(axis=1))[:, None] * self.s[h, rows]
        self.move[rows] = -q


def train_machines(data: DataFrame, machines: Sequence[Machine], weights: np.ndarray, max_iter: int, tol: float) -> list[np.ndarray]:
    """Trains all classifiers of the machines in shared passes; returns the final loss of each."""
    steps = [Steps(m) for m in machines]
    for _ in range(max_iter):
        active = [np.flatnonzero(s.live) for s in steps]
        if not any(len(rows) for rows in active):
            break
        for s, rows, parts in zip(steps, active, _evaluate(data, machines, active, weights)):
            s.take(rows, parts, tol)
    for s in steps:
        s.machine.w = s.at
    return [s.value for s in steps]


def _prepared(train: DataFrame, vector: str, label: str, fold: str | None) -> tuple[DataFrame, list, np.ndarray]:
    """Rows (v, label = position of the class, fold), the classes in order, and the rows per (fold, class)."""
    held = train.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    fold_column = F.lit(-1) if fold is None else F.col(fold)
    held = held.select(F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("_l"), fold_column.cast("int").alias("fold"))
    sizes = held.groupBy("fold", "_l").count().collect()  # one row per fold and class
    classes = sorted({r["_l"] for r in sizes})
    counts = np.zeros((max([r["fold"] for r in sizes], default=-1) + 2, len(classes)))
    for r in sizes:
        counts[r["fold"], classes.index(r["_l"])] = r["count"]  # fold -1 is the last line
    if classes:
        held = held.withColumn("label", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("_l")) - 1).cast("int"))
        tasks = int(np.ceil(counts.sum() / TASK_ROWS))
        held = cut_lineage(held.select("v", "label", "fold").repartition(tasks))
    return held, classes, counts


def _balance(counts: np.ndarray) -> np.ndarray:
    """(fold, class) weight of a row when all rows but the fold's train; the last line holds all rows (fold -1)."""
    left = counts.sum(axis=0)[None, :] - counts
    left[-1] = counts.sum(axis=0)
    return left.sum(axis=1, keepdims=True) / (max(1, left.shape[1]) * np.maximum(left, 1.0))


def _model_key(setting: dict, gamma: float) -> tuple[tuple, tuple[float, bool]]:
    """Kernel map (kernel, gamma, degree) and (C, balanced) of a setting; settings that mean the same share both."""
    kernel, cost, degree = setting["kernel"], float(setting["C"]), setting["degree"]
    if setting["class_weight"] not in (None, "balanced"):
        raise ValueError("class_weight is None or balanced")
    balanced = setting["class_weight"] == "balanced"
    if kernel == "poly":
        return (kernel, 1.0, degree), (cost * gamma**degree, balanced)
    return (kernel, gamma if kernel == "rbf" else 1.0, 3), (cost, balanced)


def _width(kernel: str, degree: int, width: int, size: int) -> int:
    if kernel == "poly" and degree == 2:
        return width * (width + 1) // 2
    return width if kernel == "linear" else size


def _groups(keys: Sequence[tuple], width: int, size: int, folds: Sequence[int], classes: int, seed: int) -> Iterator[list[Machine]]:
    """Machines whose weights together stay below GROUP_WEIGHTS; a setting is never split."""
    group, held = [], 0
    by_map: dict[tuple, list] = {}
    for features, name in dict.fromkeys(keys):
        by_map.setdefault(features, []).append(name)
    for (kernel, gamma, degree), names in by_map.items():
        mapped = _width(kernel, degree, width, size)
        each = (mapped + 1) * len(folds) * classes
        most = max(1, GROUP_WEIGHTS // each)
        for begin in range(0, len(names), most):
            some = names[begin : begin + most]
            if group and held + each * len(some) > GROUP_WEIGHTS:
                yield group
                group, held = [], 0
            group.append(Machine(KernelMap(kernel, gamma, width, size, seed, degree), mapped, some, folds, classes))
            held += each * len(some)
    if group:
        yield group


def _hits(data: DataFrame, machines: Sequence[Machine]) -> list[tuple]:
    """(machine, setting, fold, rows, hits) on the held-out rows of each fold: a count per task, added on Spark."""
    told = data.sparkSession.sparkContext.broadcast(machines)
    kind = "machine int, setting int, fold int, n long, hits long"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines, out = told.value, {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, label, fold = matrix_of(batch.column("v")), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for i, machine in enumerate(machines):
                w = machine.w.reshape(len(machine.names), len(machine.folds), machine.classes, -1)
                for f, k in enumerate(machine.folds):
                    here = np.flatnonzero(fold == k)
                    step = max(1, STEP_VALUES // (len(machine.names) * machine.classes))
                    for begin in range(0, len(here), step):
                        rows = here[begin : begin + step]
                        margins = machine.mapped(x[rows]) @ w[:, f].reshape(-1, w.shape[3]).T
                        best = margins.reshape(len(rows), len(machine.names), machine.classes).argmax(axis=2)
                        hits = (best == label[rows, None]).sum(axis=0)
                        for j, h in enumerate(hits):
                            old = out.get((i, j, int(k)), (0, 0))
                            out[i, j, int(k)] = (old[0] + len(rows), old[1] + int(h))
        if out:
            names = ["machine", "setting", "fold", "n", "hits"]
            types = [pa.int32()] * 3 + [pa.int64()] * 2
            columns = list(zip(*[(*key, *value) for key, value in out.items()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    found = data.mapInArrow(score, kind).groupBy("machine", "setting", "fold").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect()
    told.destroy()
    return [tuple(r) for r in found]


def margin_search(
    train: DataFrame, ident: str, vector: str = "spectrum", label: str = "label", grid: dict[str, Sequence] = SVM_GRID, folds: int = 3,
    size: int = 256, seed: int = 42, max_iter: int = 100, tol: float = 1e-4,
) -> DataFrame:
    """scores(C, gamma, kernel, degree, class_weight, accuracy): mean accuracy over stratified folds of every combination of the grid.

    Rows without a vector or label take no part; without rows the result is empty. Settings that mean the same (another gamma of the
    linear kernel, another degree of any kernel but the polynomial) share their classifiers. A fold without rows is left out of the
    mean. A classifier stops when a step gains less than ``tol`` of its loss.
    """
    spark = train.sparkSession
    schema = T.StructType(
        [
            T.StructField("C", T.DoubleType()), T.StructField("gamma", T.StringType()), T.StructField("kernel", T.StringType()),
            T.StructField("degree", T.IntegerType()), T.StructField("class_weight", T.StringType()), T.StructField("accuracy", T.DoubleType()),
        ]
    )
    settings = grid_settings(grid)
    known = train.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    data, classes, counts = _prepared(stratified_folds(known, ident, label, folds), vector, label, "fold")
    if not classes:
        return spark.createDataFrame([], schema)
    gammas = {g: kernel_gamma(known, g, vector) for g in dict.fromkeys(s["gamma"] for s in settings)}
    width = next(iter(gammas.values()))[1]
    keys = [_model_key(s, gammas[s["gamma"]][0]) for s in settings]
    weights = _balance(counts)
    accuracy: dict[tuple, list[float]] = {}
    for machines in _groups(keys, width, size, range(folds), len(classes), seed):
        train_machines(data, machines, weights, max_iter, tol)
        for i, j, _, n, hits in sorted(_hits(data, machines)):
            m = machines[i]
            key = (m.features.kernel, m.features.gamma, m.features.degree)
            accuracy.setdefault((key, m.names[j]), []).append(hits / n)
    rows = [
        (float(s["C"]), str(s["gamma"]), s["kernel"], s["degree"], s["class_weight"], float(np.mean(accuracy[key])))
        for s, key in zip(settings, keys)
    ]
    return spark.createDataFrame(rows, schema)


class MarginModel(SvmModel):
    """The trained classifiers of one setting; ``transform`` adds prediction (the class, as a double)."""

    def __init__(self, machine: Machine, classes: Sequence, vector: str):
        self.machine, self.classes, self.vector = machine, classes, vector

    def transform(self, df: DataFrame) -> DataFrame:
        machine = self.machine
        margins = map_vectors(df, self.vector, "_margins", lambda x: machine.mapped(x) @ machine.w.T, DOUBLES)
        first = F.array_position("_margins", F.array_max("_margins")).cast("int")
        named = F.element_at(F.array(*[F.lit(float(c)) for c in self.classes]), first)
        return margins.withColumn("prediction", named).drop("_margins")


def margin_classifier(
    train: DataFrame, vector: str = "spectrum", label: str = "label", size: int = 256, seed: int = 42, max_iter: int = 100,
    tol: float = 1e-4, **setting,
) -> MarginModel:
    """One setting (C, gamma, kernel, degree, class_weight) trained on all rows, as ``margin_search`` trains it; classes are numbers."""
    (setting,) = grid_settings({name: [value] for name, value in setting.items()})
    known = train.filter(F.col(vector).isNotNull() & F.col(label).isNotNull())
    data, classes, counts = _prepared(known, vector, label, None)
    if not classes:
        raise ValueError("no rows to train on")
    gamma, width = kernel_gamma(known, setting["gamma"], vector)
    ((machine,),) = _groups([_model_key(setting, gamma)], width, size, [-1], len(classes), seed)
    # fold -2 names no row, so every row trains
    machine.fold = np.full_like(machine.fold, -2)
    train_machines(data, [machine], np.vstack([_balance(counts)[-1:]] * 2), max_iter, tol)
    return MarginModel(machine, classes, vector)

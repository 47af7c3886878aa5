"""Exhaustive searches that share work between settings: nested forests.

Trees of a forest are independent, so its first trees are a smaller forest; a tree cut at a depth, or at nodes with few rows, is
the tree that a smaller limit would have grown. One fit per leaf size, feature share and fold at the largest limits therefore
scores every number of trees, depth and split size. Spark ML grows the forests of few rows; their nodes are tables (Spark ML's own
save), and each block of held-out rows meets a forest where it lies. Its cost per node is the same however few rows a node has, and
nodes follow the rows, so forests of more rows are grown inside tasks by the same rules (``forests``): rows lie binned in the
session's shared folder, a task grows a lot of trees, another one leads a block of held-out rows past the trees of a setting.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.operators import forests
from cubeloom.operators.classify import FOREST_GRID, stratified_folds, with_features
from cubeloom.operators.moments import matrix_of
from cubeloom.operators.outlier import layer_batches, mixed, write_ordered
from cubeloom.operators.ranking import number_rows
from cubeloom.session import cut_lineage, drop_folder, output_folder

# The split sizes of the forest grid.
SPLIT_SIZES = (2, 5, 10)
#: Held-out rows that meet a forest in one task, rows per task of a fit, values of a scoring step.
BLOCK_ROWS = 50_000
FIT_ROWS = 20_000
STEP_VALUES = 20_000_000
#: Node statistics of one step of a fit, several of which run at once.
FIT_MB = 128
#: Rows whose forests Spark ML grows; bytes of binned rows that a task holds at most (Spark ML again beyond), trees of a task.
SPARK_ROWS = 1000
TASK_BYTES = 256_000_000
LOT_TREES = 20
#: What a grown tree is written as.
PARTS = {"feature": np.int16, "cut": np.uint8, "left": np.int32, "stats": np.int32}
SETTINGS = ["numTrees", "maxDepth", "minInstancesPerNode", "featureSubsetStrategy", "minSplit"]


def forest_nodes(spark, path: str) -> DataFrame:
    """One row per tree of a saved forest: tree, nodes (by id: feature or -1, cut, left, right, rows, stats)."""
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    node = F.struct(
        "id", F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("rawCount").alias("rows"), F.col("impurityStats").alias("stats"),
    )
    return saved.groupBy(F.col("treeID").alias("tree")).agg(F.sort_array(F.collect_list(node)).alias("nodes"))


class Forest:
    """Trees as arrays, root of tree t at ``roots[t]``."""

    def __init__(self, trees: pa.ChunkedArray):
        lists = trees.combine_chunks() if isinstance(trees, pa.ChunkedArray) else trees
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        nodes = lists.flatten()
        self.roots = np.cumsum(sizes) - sizes
        base = np.repeat(self.roots, sizes)
        column = dict(zip([f.name for f in nodes.type], nodes.flatten()))
        self.feature = column["feature"].to_numpy(zero_copy_only=False)
        self.cut = column["cut"].to_numpy(zero_copy_only=False).astype(float)
        self.left = base + column["left"].to_numpy(zero_copy_only=False)
        self.right = base + column["right"].to_numpy(zero_copy_only=False)
        self.rows = column["rows"].to_numpy(zero_copy_only=False)
        stats = column["stats"].flatten().to_numpy().reshape(len(self.feature), -1)
        self.share = stats / np.maximum(stats.sum(axis=1, keepdims=True), 1e-300)

    def stops(self, x: np.ndarray, depths: Sequence[int], splits: Sequence[int]) -> dict[tuple[int, int], np.ndarray]:
        """Per depth limit and split size the node (rows x trees) at which every row stops in every tree."""
        row = np.repeat(np.arange(len(x)), len(self.roots))
        at = np.tile(self.roots, len(x))
        found = {(d, s): np.full(len(at), -1) for d in depths for s in splits}
        open_ = np.arange(len(at))
        for depth in itertools.count():
            here = at[open_]
            leaf = self.feature[here] < 0
            for (d, s), node in found.items():
                ends = (leaf | (depth >= d) | (self.rows[here] < s)) & (node[open_] < 0)
                node[open_[ends]] = here[ends]
            keep = ~leaf if depth < max(depths) else np.zeros(len(here), bool)
            open_, here = open_[keep], here[keep]
            if len(open_) == 0:
                return {k: v.reshape(len(x), len(self.roots)) for k, v in found.items()}
            goes_left = x[row[open_], self.feature[here]] <= self.cut[here]
            at[open_] = np.where(goes_left, self.left[here], self.right[here])

    def hits(self, x: np.ndarray, label: np.ndarray, trees: Sequence[int], depths: Sequence[int], splits: Sequence[int]) -> dict[tuple, int]:
        """Rows that the first trees, cut at a depth and a split size, classify right, by (trees, depth, split size)."""
        out = dict.fromkeys(itertools.product(trees, depths, splits), 0)
        step = max(1, STEP_VALUES // (len(self.roots) * self.share.shape[1]))
        for lo in range(0, len(x), step):
            for (d, s), node in self.stops(x[lo : lo + step], depths, splits).items():
                votes = self.share[node]
                for t in trees:
                    out[t, d, s] += int((votes[:, :t].sum(axis=1).argmax(axis=1) == label[lo : lo + step]).sum())
        return out


def folded_rows(train: DataFrame, ident: str, vector: str, label: str, folds: int) -> DataFrame:
    """Complete rows (checkpointed): _id, _y (label), _x (vector), _fold, _i (number in the fold, from 1)."""
    rows = train.select(F.col(ident).alias("_id"), F.col(label).cast("int").alias("_y"), F.col(vector).cast("array<double>").alias("_x"))
    folded = stratified_folds(rows.dropna(), "_id", "_y", folds, "_fold")
    return cut_lineage(number_rows(folded, "_id", "_i", ["_fold"]))


def fit_rows(data: DataFrame, count: int) -> DataFrame:
    """What the fits read, in partitions of about ``FIT_ROWS``."""
    return with_features(data, "_x").select("_y", "_fold", "features").coalesce(max(1, count // FIT_ROWS))


def scored_by_spark(
    data: DataFrame, count: int, kinds: list[tuple], grid: dict[str, Sequence], splits: Sequence[int], seed: int, parallelism: int, result: T.StructType,
) -> DataFrame:
    """Right answers per setting, fold and block of held-out rows, from forests that Spark ML fits."""
    spark = data.sparkSession
    folder = output_folder(spark, "forests")
    ready = fit_rows(data, count).persist()

    def fit(kind: tuple) -> DataFrame:
        leaf, share, fold = kind
        # every row keeps its node per tree: else each step's tasks carry all trees grown so far
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="_y", numTrees=max(grid["numTrees"]), maxDepth=max(grid["maxDepth"]), seed=seed,
            minInstancesPerNode=leaf, featureSubsetStrategy=share, maxMemoryInMB=FIT_MB, cacheNodeIds=True)
        path = f"{folder}/{leaf}-{share}-{fold}"
        forest.fit(ready.filter(F.col("_fold") != fold)).write().save(path)
        return forest_nodes(spark, path).select(F.lit(leaf).alias("_leaf"), F.lit(share).alias("_share"), F.lit(fold).alias("_fold"), "tree", "nodes")

    pool = ThreadPool(min(parallelism, len(kinds)))
    try:
        made = pool.map(inheritable_thread_target(spark)(fit), kinds)
    finally:
        pool.close()
        ready.unpersist()
    trees = made[0]
    for part in made[1:]:
        trees = trees.unionByName(part)
    blocked = data.withColumn("_block", F.floor((F.col("_i") - 1) / BLOCK_ROWS))
    met = F.explode(F.array(*[F.struct(F.lit(a).alias("leaf"), F.lit(b).alias("share")) for a, b, fold in kinds if fold == 0]))
    held = blocked.withColumn("_k", met).select(F.col("_k.leaf").alias("_leaf"), F.col("_k.share").alias("_share"), "_fold", "_block", "_y", "_x")
    blocks = blocked.select(F.col("_fold").alias("_of"), F.col("_block").alias("_at")).distinct()
    copies = trees.join(blocks, F.col("_fold") == F.col("_of")).withColumnRenamed("_at", "_block").drop("_of")
    limits = (list(grid["numTrees"]), list(grid["maxDepth"]), list(splits))

    def score(rows: pa.Table, forest: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or forest.num_rows == 0:
            return pa.Table.from_pylist([], schema=arrow)
        forest = forest.sort_by("tree")
        leaf, share, fold = (forest.column(c)[0].as_py() for c in ("_leaf", "_share", "_fold"))
        hits = Forest(forest.column("nodes")).hits(matrix_of(rows.column("_x")), rows.column("_y").to_numpy(), *limits)
        found = [(t, d, leaf, share, s, fold, n, rows.num_rows) for (t, d, s), n in hits.items()]
        return pa.Table.from_pylist([dict(zip(result.names, f)) for f in found], schema=arrow)

    arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.int64())) for f in result])
    keys = ["_leaf", "_share", "_fold", "_block"]
    scored = cut_lineage(held.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(score, result))
    drop_folder(spark, folder)  # the counts are checkpointed
    return scored


def binned_rows(data: DataFrame, width: int, folds: int, path: str, tasks: int) -> DataFrame:
    """Writes every row once per fold left out, binned by that fold's thresholds: _key, _i, _y, _row (key of its draws), _bins.

    ``_key`` is ``<fold>-train``, or ``<fold>-<block>`` for the rows of the fold itself. Returns thresholds: _band, _of, _cuts.
    """
    spark = data.sparkSession
    sums = [F.sum((F.col("_fold") != of).cast("long")).alias(f"_n{of}") for of in range(folds)]
    values = data.select("_fold", F.posexplode("_x").alias("_band", "_v")).groupBy("_band", "_v").agg(*sums)

    def cut(found: pa.Table) -> pa.Table:
        found = found.sort_by("_v")
        v, cuts = found.column("_v").to_numpy(), []
        for of in range(folds):
            n = found.column(f"_n{of}").to_numpy()
            cuts.append(forests.thresholds(v[n > 0], n[n > 0]).tolist())
        return pa.table({"_band": pa.array([found.column("_band")[0].as_py()] * folds, pa.int32()), "_of": pa.array(range(folds), pa.int32()), "_cuts": cuts})

    # a few thousand numbers: 31 at most per feature and fold
    cuts = {(r["_of"], r["_band"]): np.array(r["_cuts"]) for r in values.groupBy("_band").applyInArrow(cut, "_band int, _of int, _cuts array<double>").collect()}
    names = pa.schema([("_key", pa.string()), ("_i", pa.int64()), ("_y", pa.int32()), ("_row", pa.int64()), ("_bins", pa.binary())])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, fold, i = matrix_of(batch.column("_x")), batch.column("_fold").to_numpy(), batch.column("_i").to_numpy()
            draws = mixed(fold, i).view(np.int64)
            for of in range(folds):
                bins = np.empty(x.shape, np.uint8)
                for band in range(width):
                    bins[:, band] = np.searchsorted(cuts[of, band], x[:, band])
                keys = [f"{of}-{(n - 1) // BLOCK_ROWS}" if mine else f"{of}-train" for n, mine in zip(i.tolist(), (fold == of).tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("_i"), batch.column("_y"), pa.array(draws), pa.array([b.tobytes() for b in bins], pa.binary())], schema=names)

    kind = "_key string, _i long, _y int, _row long, _bins binary"
    write_ordered(data.select("_fold", "_i", "_y", "_x").mapInArrow(binned, kind), path, tasks, "_key", "_i")
    return spark.read.schema(kind).parquet(path)


def scored_in_tasks(data: DataFrame, width: int, grid: dict[str, Sequence], splits: Sequence[int], folds: int, seed: int, result: T.StructType) -> DataFrame:
    """Right answers per setting, fold and block of held-out rows, from forests that tasks grow and others lead the rows past."""
    spark = data.sparkSession
    low, high = data.select(F.min("_y"), F.max("_y")).first()
    if low < 0:
        raise ValueError("labels are 0 to k - 1")
    classes, trees, depth = high + 1, max(grid["numTrees"]), max(grid["maxDepth"])
    folder = output_folder(spark, "forests")
    rows_at, trees_at = f"{folder}/rows", f"{folder}/trees"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = binned_rows(data, width, folds, rows_at, tasks)
    sizes = {share: forests.share_size(share, width, trees) for share in grid["featureSubsetStrategy"]}
    kinds = sorted(itertools.product(grid["minInstancesPerNode"], sizes, range(folds)), key=lambda kind: -sizes[kind[1]])  # long tasks first
    lots = [(*kind, first) for kind in kinds for first in range(0, trees, LOT_TREES)]
    limits = (list(grid["numTrees"]), list(grid["maxDepth"]), list(splits))

    def held(key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bins, labels, keys of the draws) of the rows under a key."""
        found = pa.Table.from_batches([b for b in layer_batches(rows_at, "_key", key, ["_y", "_row", "_bins"], 8192) if b.num_rows])
        return forests.bytes_matrix(found.column("_bins"), width), found.column("_y").to_numpy().astype(np.int64), found.column("_row").to_numpy()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for batch in batches for n in batch.column("id").to_pylist()):
            leaf, share, of, first = lots[n]
            bins, y, draws = held(f"{of}-train")
            bins = np.ascontiguousarray(bins.T)
            for t in range(first, min(first + LOT_TREES, trees)):
                tree = forests.grow_tree(bins, y, forests.repeats(draws, t, seed), classes, sizes[share], leaf, depth, t, seed)
                row = {"_kind": f"{leaf}-{share}-{of}", "_tree": t, **{c: tree[c].tobytes() for c in PARTS}}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("_kind", pa.string()), ("_tree", pa.int32()), *[(c, pa.binary()) for c in PARTS]]))

    written = "_kind string, _tree int, " + ", ".join(f"{c} binary" for c in PARTS)
    # a partition and a file per lot, so a kind's trees lie in their order
    spark.range(0, len(lots), 1, len(lots)).mapInArrow(grow, written).write.parquet(trees_at)
    blocks = [r["_key"] for r in rows.filter(~F.col("_key").endswith("-train")).select("_key").distinct().orderBy("_key").collect()]
    meetings = [(kind, key) for kind in kinds for key in blocks if key.startswith(f"{kind[2]}-")]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n in (n for batch in batches for n in batch.column("id").to_pylist()):
            (leaf, share, of), key = meetings[n]
            bins, y, _ = held(key)

            def met() -> Iterator[dict[str, np.ndarray]]:
                expected = itertools.count()
                for part in layer_batches(trees_at, "_kind", f"{leaf}-{share}-{of}", ["_tree", *PARTS], 4):
                    for tree in part.to_pylist():
                        if tree["_tree"] != next(expected):
                            raise ValueError("trees out of order")
                        parts = {c: np.frombuffer(tree[c], dtype) for c, dtype in PARTS.items()}
                        yield parts | {"stats": parts["stats"].reshape(-1, classes)}

            found = forests.hits(bins, y, met(), classes, *limits)
            got = [(t, d, leaf, share, s, of, right, len(y)) for (t, d, s), right in found.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(result.names, row)) for row in got], schema=arrow)

    arrow = pa.schema([(f.name, {"string": pa.string(), "int": pa.int32()}.get(f.dataType.simpleString(), pa.int64())) for f in result])
    scored = cut_lineage(spark.range(0, len(meetings), 1, len(meetings)).mapInArrow(meet, result))
    drop_folder(spark, folder)  # the counts are checkpointed
    return scored


def forest_search(
    train: DataFrame, ident: str, grid: dict[str, Sequence] = FOREST_GRID, splits: Sequence[int] = SPLIT_SIZES,
    vector: str = "spectrum", label: str = "label", folds: int = 3, seed: int = 42, parallelism: int = 8,
) -> DataFrame:
    """(numTrees, maxDepth, minInstancesPerNode, featureSubsetStrategy, minSplit, accuracy) of every combination.

    Labels are 0 to k - 1. Draws of up to ``SPARK_ROWS`` rows are Spark's own, others hashes of the seed. Accuracy is the mean over stratified folds. Split sizes count a tree's drawn rows with their repeats, as
    Spark's leaf sizes do. Trees wider than a limit are cut, so shares under a cut come from nodes that Spark did not prune.
    Rows without label or vector take no part; a table without rows gives no rows.
    """
    spark = train.sparkSession
    data = folded_rows(train, ident, vector, label, folds)
    count = data.count()
    kinds = list(itertools.product(grid["minInstancesPerNode"], grid["featureSubsetStrategy"], range(folds)))
    result = T.StructType(
        [T.StructField(n, T.StringType() if n == "featureSubsetStrategy" else T.IntegerType()) for n in SETTINGS]
        + [T.StructField("_fold", T.IntegerType()), T.StructField("_right", T.LongType()), T.StructField("_rows", T.LongType())]
    )
    if count == 0:
        return spark.createDataFrame([], result).drop("_fold", "_right", "_rows").withColumn("accuracy", F.lit(0.0))
    width = data.select(F.max(F.size("_x"))).first()[0]
    known = all(forests.share_size(share, width, max(grid["numTrees"])) for share in grid["featureSubsetStrategy"])
    if SPARK_ROWS < count and count * width <= TASK_BYTES and folds > 1 and known:
        scored = scored_in_tasks(data, width, grid, splits, folds, seed, result)
    else:
        scored = scored_by_spark(data, count, kinds, grid, splits, seed, parallelism, result)
    by_fold = scored.groupBy(*SETTINGS, "_fold").agg((F.sum("_right") / F.sum("_rows")).alias("_accuracy"))
    return by_fold.groupBy(*SETTINGS).agg(F.avg("_accuracy").alias("accuracy"))


def best_setting(found: DataFrame) -> dict | None:
    """The best combination that Spark's trees know (no split size); ties go to the smaller forest."""
    known = found.filter(F.col("minSplit") <= 2)
    best = known.orderBy(F.desc("accuracy"), "numTrees", "maxDepth", F.desc("minInstancesPerNode"), "featureSubsetStrategy").first()
    return None if best is None else {name: best[name] for name in SETTINGS if name != "minSplit"}


def best_forest(train: DataFrame, found: DataFrame, vector: str = "spectrum", label: str = "label", seed: int = 42) -> Model:
    """Forest of the best setting on all rows."""
    setting = best_setting(found)
    if setting is None:
        raise ValueError("no rows to train on")
    return RandomForestClassifier(featuresCol="features", labelCol=label, seed=seed, **setting).fit(with_features(train, vector))

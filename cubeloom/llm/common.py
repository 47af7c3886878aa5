"""Shared folders, written tables and column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.session import ensure_checkpoint_dir, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query of this subpackage; ``sql`` is its DuckDB twin."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared checkpoint folder."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    context._cubeloom_work = getattr(context, "_cubeloom_work", []) + [path]
    return path


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` into the shared folder and reads it back: lineage ends there and lost executors lose nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    # the names and types are known, so an empty table reads back as well
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for frame in frames:
        for path in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            _delete(spark, path)


def drop_all_written(spark: SparkSession) -> None:
    """Deletes every table this session's operators wrote; call it once their results are stored."""
    for path in getattr(spark.sparkContext, "_cubeloom_work", []):
        _delete(spark, path)
    spark.sparkContext._cubeloom_work = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it while a column has that name in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def mixed_key(seed: int, *parts: str | Column) -> Column:
    """Non-negative 63-bit hash of the parts: a function of the row and the seed, not of the partitioning."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 63) - 1))

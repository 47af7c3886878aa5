"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cubeloom") -> SparkSession:
    """Session for tests and local benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session; a temporary one only for an unset local session."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        configured = tempfile.mkdtemp(prefix="cubeloom-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def output_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's checkpoint folder, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``output_folder`` named."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and starts a fresh plan."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession, *folders: str) -> None:
    """Makes this package and further package folders importable in the session's Python workers (once)."""
    context = spark.sparkContext
    shipped = getattr(context, "_cubeloom_shipped", set())
    wanted = {os.path.dirname(os.path.abspath(__file__)), *(os.path.abspath(f) for f in folders)} - shipped
    for root in sorted(wanted):
        archive = os.path.join(tempfile.mkdtemp(prefix="cubeloom-"), os.path.basename(root) + ".zip")
        with zipfile.ZipFile(archive, "w") as target:
            for folder, _, files in os.walk(root):
                for name in files:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        target.write(path, os.path.relpath(path, os.path.dirname(root)))
        context.addPyFile(archive)
    context._cubeloom_shipped = shipped | wanted

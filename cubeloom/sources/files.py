"""File listings, sample lists, training logs, matrices and point layers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.functions import text


def scan_files(spark: SparkSession, folder: str, suffixes: str | tuple[str, ...]) -> DataFrame:
    """files(path, length) under a folder whose name ends with one of the suffixes; contents are not read."""
    if isinstance(suffixes, str):
        suffixes = (suffixes,)
    if not isinstance(suffixes, tuple):
        raise ValueError("suffixes are a string or a tuple of strings")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    pattern = "{" + ",".join(f"*{s}" for s in suffixes) + "}"
    return reader.option("pathGlobFilter", pattern).load(folder).select("path", "length")


def modified_times(spark: SparkSession, folders: dict[str, str]) -> dict[str, int]:
    """Microseconds since 1970 at which each named folder or file was last written (its newest file; contents are not read)."""
    frames = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.lit(name).alias("name"), "modificationTime")
        for name, path in folders.items()
    ]
    newest = reduce(DataFrame.unionByName, frames).groupBy("name").agg(F.unix_micros(F.max("modificationTime")).alias("time"))
    times = {r["name"]: r["time"] for r in newest.collect()}
    if missing := sorted(set(folders) - set(times)):
        raise FileNotFoundError(f"no files in {', '.join(missing)}")
    return times


def parse_samples(lines: DataFrame, line: str = "line", folder: str | None = None) -> DataFrame:
    """samples(path, label) of "path label" lines; ``folder`` re-roots the file names."""
    path = text.sample_path(F.col(line))
    return lines.select((text.rebase(path, folder) if folder else path).alias("path"), text.sample_label(F.col(line)).alias("label"))


def scan_sample_list(spark: SparkSession, path: str, rebase: bool = False) -> DataFrame:
    """Sample list file; ``rebase`` looks for the samples next to the list."""
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(F.trim("line") != "")
    return parse_samples(lines, "line", path.rsplit("/", 1)[0] if rebase else None)


def sink_sample_list(samples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One "path[ label]" line per sample."""
    sample_lines(samples).write.mode(mode).text(path)


def sample_lines(samples: DataFrame) -> DataFrame:
    columns = [F.col("path")] + ([F.col("label").cast("string")] if "label" in samples.columns else [])
    return samples.select(F.concat_ws(" ", *columns).alias("line"))


def labelled_spectra(samples: DataFrame, patches: DataFrame) -> DataFrame:
    """(path, label, spectrum) of listed samples; a 1 x 1 patch is its spectrum."""
    return samples.join(patches.select("path", F.col("cube").alias("spectrum")), "path")


def parse_log(lines: DataFrame, target: str = "Accuracy: ", line: str = "line") -> DataFrame:
    """(phase, value) of the log lines that carry the target."""
    parsed = lines.select(text.log_phase(F.col(line)).alias("phase"), text.log_value(F.col(line), target).alias("value"))
    return parsed.filter(F.col("value").isNotNull())


def scan_training_log(spark: SparkSession, path: str, target: str = "Accuracy: ") -> DataFrame:
    return parse_log(spark.read.text(path).withColumnRenamed("value", "line"), target)


def matrix_lines(features: DataFrame, width: int, vector: str = "v", ident: str = "emb_idx") -> DataFrame:
    """Wide form of a feature table: ident, c0, c1, ...; booleans become integers."""
    kind = dict(features.dtypes)[vector]
    item = F.col(vector)
    if kind == "array<boolean>":
        item = F.transform(vector, lambda x: x.cast("int"))
    if not kind.startswith("array<") or kind.startswith("array<array"):
        raise ValueError("a matrix needs one flat vector per row")
    return features.select(ident, *[F.get(item, F.lit(i)).alias(f"c{i}") for i in range(width)])


def sink_matrix(features: DataFrame, path: str, width: int, vector: str = "v", ident: str = "emb_idx",
                delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Delimited text with the row key first, so that order never carries meaning."""
    matrix_lines(features, width, vector, ident).write.mode(mode).option("sep", delimiter).csv(path)


def parse_matrix(lines: DataFrame, line: str = "line", ident: str = "emb_idx", delimiter: str = ",") -> DataFrame:
    """features(emb_idx, v ARRAY<FLOAT>) of delimited lines whose first field is the key."""
    parts = F.split(F.col(line), f"\\Q{delimiter}\\E")
    values = F.slice(parts, F.lit(2), F.size(parts) - 1)
    return lines.select(parts[0].cast("long").alias(ident), F.transform(values, lambda x: x.cast("float")).alias("v"))


def scan_matrix(spark: SparkSession, path: str, ident: str = "emb_idx", delimiter: str = ",") -> DataFrame:
    """Feature table from delimited text files."""
    return parse_matrix(spark.read.text(path).withColumnRenamed("value", "line"), "line", ident, delimiter)


def scan_points(points: DataFrame) -> DataFrame:
    """Rows with a point geometry; class and emb_idx are null when the layer has none."""
    for name, kind in (("class", "int"), ("emb_idx", "long")):
        if name not in points.columns:
            points = points.withColumn(name, F.lit(None).cast(kind))
    return points.filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def pack_samples(samples: DataFrame, patches: DataFrame, path: str, rows_per_file: int = 50_000, mode: str = "errorifexists") -> None:
    """All listed patches with their labels in one compressed columnar store."""
    packed = samples.join(patches, "path").select("path", "label", "cube")
    packed.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)

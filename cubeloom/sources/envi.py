"""ENVI flat-binary cubes as a Spark data source.

A cube is one binary file plus a text header. Reading gives one input partition per strip of
rows; writing gives one cube per strip of rows, so neither side passes a whole scene through
one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# ENVI data type codes.
ENVI_TYPES = {1: "uint8", 2: "int16", 3: "int32", 4: "float32", 5: "float64", 12: "uint16", 13: "uint32"}
SCHEMA = "scene_id string, row int, col int, spectrum array<float>, valid boolean"
STRIP_BYTES = 64 << 20


def parse_header(lines: str) -> dict:
    """Key - value pairs of a header; braces may span lines."""
    fields, pending = {}, ""
    for line in lines.splitlines():
        pending = f"{pending} {line}".strip() if pending else line.strip()
        if "=" not in pending or pending.count("{") > pending.count("}"):
            if "=" not in pending:
                pending = ""
            continue
        key, value = pending.split("=", 1)
        fields[key.strip().lower()] = value.strip().strip("{}").strip()
        pending = ""
    return fields


@dataclass(frozen=True)
class CubeHeader:
    rows: int
    cols: int
    bands: int
    dtype: str
    interleave: str
    offset: int
    big_endian: bool
    nodata: float | None
    gt: tuple[float, ...]

    @classmethod
    def read(cls, path: str) -> "CubeHeader":
        with open(path, encoding="utf-8") as file:
            f = parse_header(file.read())
        code = int(f["data type"])
        if code not in ENVI_TYPES:
            raise ValueError(f"unsupported data type {code}; supported: {sorted(ENVI_TYPES)}")
        gt = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
        if "map info" in f:
            info = [p.strip() for p in f["map info"].split(",")]
            px, py, x, y, dx, dy = (float(v) for v in info[1:7])
            gt = (x - (px - 1) * dx, dx, 0.0, y + (py - 1) * dy, 0.0, -dy)
        nodata = float(f["data ignore value"]) if "data ignore value" in f else None
        return cls(
            int(f["lines"]), int(f["samples"]), int(f["bands"]), ENVI_TYPES[code], f.get("interleave", "bsq").lower(),
            int(f.get("header offset", 0)), f.get("byte order", "0") == "1", nodata, gt,
        )

    @property
    def numpy_dtype(self) -> np.dtype:
        return np.dtype(self.dtype).newbyteorder(">" if self.big_endian else "<")

    def strip(self, file, first: int, count: int) -> np.ndarray:
        """(count, cols, bands) array of a strip, reading only its bytes."""
        size = self.numpy_dtype.itemsize
        if self.interleave == "bsq":
            planes = []
            for b in range(self.bands):
                file.seek(self.offset + (b * self.rows + first) * self.cols * size)
                planes.append(np.frombuffer(file.read(count * self.cols * size), self.numpy_dtype).reshape(count, self.cols))
            return np.stack(planes, axis=2)
        file.seek(self.offset + first * self.cols * self.bands * size)
        data = np.frombuffer(file.read(count * self.cols * self.bands * size), self.numpy_dtype)
        if self.interleave == "bil":
            return data.reshape(count, self.bands, self.cols).transpose(0, 2, 1)
        if self.interleave == "bip":
            return data.reshape(count, self.cols, self.bands)
        raise ValueError(f"unknown interleave {self.interleave!r}")


def header_path(path: str) -> str:
    for candidate in (path + ".hdr", os.path.splitext(path)[0] + ".hdr"):
        if os.path.exists(candidate):
            return candidate
    raise FileNotFoundError(f"no header beside {path}")


class Strip(InputPartition):
    def __init__(self, path: str, first: int, count: int, row_offset: int):
        self.path, self.first, self.count, self.row_offset = path, first, count, row_offset


class EnviReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        if os.path.isdir(path):
            names = sorted(n for n in os.listdir(path) if n.endswith((".dat", ".img")))
            self.paths = [os.path.join(path, n) for n in names]
        else:
            self.paths = [path]
        self.scene = options.get("scene_id") or os.path.splitext(os.path.basename(path.rstrip("/")))[0]
        self.scale = float(options.get("scale", 1e-4))
        self.strip_bytes = int(options.get("strip_bytes", STRIP_BYTES))

    def partitions(self) -> list[Strip]:
        out, offset = [], 0
        for path in self.paths:
            h = CubeHeader.read(header_path(path))
            row_bytes = h.cols * h.bands * h.numpy_dtype.itemsize
            step = max(1, self.strip_bytes // row_bytes)
            # only strip files of one written scene are stacked; their names carry the first row
            stem = os.path.splitext(os.path.basename(path))[0]
            base = int(stem.rsplit("_", 1)[1]) if stem.startswith("strip_") else offset
            out += [Strip(path, r, min(step, h.rows - r), base) for r in range(0, h.rows, step)]
            offset += h.rows
        return out

    def read(self, partition: Strip) -> Iterator[pa.RecordBatch]:
        h = CubeHeader.read(header_path(partition.path))
        nodata = 0.0 if h.nodata is None else h.nodata
        with open(partition.path, "rb") as file:
            cube = h.strip(file, partition.first, partition.count)
        valid = ~np.all(cube == nodata, axis=2)
        values = cube.astype(np.float32)
        if h.dtype == "int16" and self.scale != 1:
            values = (values * self.scale).astype(np.float32)
        for i in range(partition.count):
            row = partition.row_offset + partition.first + i
            flat = np.ascontiguousarray(values[i]).ravel()
            offsets = np.arange(0, flat.size + 1, h.bands, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([self.scene] * h.cols),
                    pa.array(np.full(h.cols, row, dtype=np.int32)),
                    pa.array(np.arange(h.cols, dtype=np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array(valid[i]),
                ],
                names=["scene_id", "row", "col", "spectrum", "valid"],
            )


@dataclass
class StripWritten(WriterCommitMessage):
    files: int


class EnviWriter(DataSourceWriter):
    """Writes every strip a task holds as its own BSQ cube ``strip_<first row>``."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.cols, self.strip = int(options["cols"]), int(options["strip"])
        self.gt = [float(v) for v in options.get("gt", "0,1,0,0,0,-1").split(",")]

    def write(self, iterator: Iterator) -> StripWritten:
        os.makedirs(self.path, exist_ok=True)
        strips: dict[int, list] = {}
        for row in iterator:
            strips.setdefault(row.row // self.strip, []).append((row.row, row.col, row.spectrum))
        for number, cells in strips.items():
            first = number * self.strip
            height = max(r for r, _, _ in cells) - first + 1
            cube = np.zeros((len(cells[0][2]), height, self.cols), dtype="<f4")
            for r, c, spectrum in cells:
                cube[:, r - first, c] = spectrum
            base = os.path.join(self.path, f"strip_{first:09d}")
            with open(base + ".part", "wb") as file:
                file.write(cube.tobytes())
            x, y = self.gt[0], self.gt[3] + first * self.gt[5]
            header = (
                f"ENVI\nsamples = {self.cols}\nlines = {height}\nbands = {cube.shape[0]}\nheader offset = 0\n"
                f"data type = 4\ninterleave = bsq\nbyte order = 0\n"
                f"map info = {{Arbitrary, 1, 1, {x}, {y}, {self.gt[1]}, {-self.gt[5]}}}\n"
            )
            with open(base + ".hdr", "w", encoding="utf-8") as file:
                file.write(header)
            os.replace(base + ".part", base + ".dat")
        return StripWritten(len(strips))

    def commit(self, messages: list) -> None:
        return None

    def abort(self, messages: list) -> None:
        return None


class EnviDataSource(DataSource):
    """Format ``envi``: options scene_id, scale, strip_bytes (read); cols, strip, gt (write)."""

    @classmethod
    def name(cls) -> str:
        return "envi"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> EnviReader:
        return EnviReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> EnviWriter:
        return EnviWriter(dict(self.options))


def read_envi(spark: SparkSession, path: str, **options) -> DataFrame:
    """Pixel table of a cube file, or of a folder of strips."""
    spark.dataSource.register(EnviDataSource)
    return spark.read.format("envi").options(**{k: str(v) for k, v in options.items()}).load(path)


def write_envi(pixels: DataFrame, path: str, cols: int, gt, strip: int = 256) -> None:
    """Folder of strip cubes: rows are shuffled by strip, each task writes whole strips."""
    from pyspark.sql import functions as F

    pixels.sparkSession.dataSource.register(EnviDataSource)
    by_strip = pixels.select("scene_id", "row", "col", "spectrum", "valid").repartition(F.floor(F.col("row") / strip))
    options = {"cols": str(cols), "strip": str(strip), "gt": ",".join(str(float(g)) for g in gt)}
    by_strip.write.format("envi").options(**options).mode("append").save(path)

"""Token files: documents' ids in ascending document order as patched frame-of-reference blocks.

A shard image is little-endian binary: a header, the stream of document lengths and the stream of ids. A stream
is cut into blocks of 256 numbers; a block stores its minimum, the differences packed at a width that holds a
percentile of them, and the outliers as exceptions (place and whole difference). The block index holds each
block's minimum, width, exception count and byte start, so any block can be read alone. Shards are rows of a
Parquet table, written by Spark's committer: a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, work_path
from cubeloom.llm.tokens import encoder, release, text_chunks

BLOCK = 256
PERCENTILE = 95.0
SHARD_TOKENS = 1 << 20
END_ID = 0
MAGIC = b"PFR1"
HEAD = struct.Struct("<4sQQ")
STREAM = struct.Struct("<QII")
INDEX = np.dtype([("base", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u8")])
SHARD = "part int, shard int, n_docs long, n_tokens long, doc_ids array<bigint>, image binary"
ROWS = "part int, shard int, doc_id long, in_shard long, n_tokens long, ids binary"


def percentile_widths(rest: np.ndarray, percentile: float) -> np.ndarray:
    """Bits of each row that hold at least ``percentile`` of its numbers; the rest are outliers."""
    allowed = BLOCK - min(BLOCK, int(np.ceil(BLOCK * percentile / 100)))
    widths = np.zeros(len(rest), np.uint8)
    left = np.arange(len(rest))
    for width in range(int(rest.max()).bit_length(), 0, -1):
        full = np.count_nonzero(rest[left] >= rest.dtype.type(1 << (width - 1)), axis=1) > allowed
        widths[left[full]] = width
        left = left[~full]
        if len(left) == 0:
            break
    return widths


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK numbers below 2**width as rows of bytes, first number in the highest bits."""
    rows = len(values)
    eight = values.reshape(rows, BLOCK // 8, 8)
    wide = np.uint16 if width <= 8 else np.uint32 if width <= 24 else np.uint64
    out = np.zeros((rows, BLOCK // 8, width), np.uint8)
    for j in range(8):  # eight numbers fill ``width`` bytes
        first, last = j * width // 8, ((j + 1) * width - 1) // 8
        moved = eight[:, :, j].astype(wide) << wide((last + 1) * 8 - (j + 1) * width)
        for byte in range(last, first - 1, -1):
            out[:, :, byte] |= moved.astype(np.uint8)
            moved >>= wide(8)
    return out.reshape(rows, -1)


def unpack_bits(data: np.ndarray, width: int) -> np.ndarray:
    """Inverse of pack_bits for rows of packed bytes."""
    rows = len(data)
    eight = data.reshape(rows, BLOCK // 8, width)
    wide = np.uint32 if width <= 24 else np.uint64
    out = np.empty((rows, BLOCK // 8, 8), np.uint32)
    for j in range(8):
        first, last = j * width // 8, ((j + 1) * width - 1) // 8
        value = eight[:, :, first].astype(wide)
        for byte in range(first + 1, last + 1):
            value = (value << wide(8)) | eight[:, :, byte]
        out[:, :, j] = (value >> wide((last + 1) * 8 - (j + 1) * width)) & wide((1 << width) - 1)
    return out.reshape(rows, BLOCK)


def encode_stream(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Patched frame-of-reference bytes of unsigned 32-bit numbers."""
    n = len(values)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = values
    if n:
        padded[n:] = values[-1]  # the padding of the last block costs no width
    padded = padded.reshape(blocks, BLOCK)
    index = np.zeros(blocks, INDEX)
    if not blocks:
        return STREAM.pack(0, 0, 0)
    index["base"] = padded.min(axis=1)
    rest = padded - index["base"][:, None]
    rest = rest.astype(np.uint16) if rest.max() < 1 << 16 else rest
    index["width"] = percentile_widths(rest, percentile)
    limit = ((np.uint64(1) << index["width"].astype(np.uint64)) - np.uint64(1)).astype(rest.dtype)
    out = rest > limit[:, None]
    index["exceptions"] = np.count_nonzero(out, axis=1)
    where, spot = np.divmod(np.flatnonzero(out), BLOCK)
    patches = np.zeros(len(where), [("spot", "u1"), ("rest", "<u4")])
    patches["spot"], patches["rest"] = spot, rest[where, spot]
    low = rest.copy()
    low[where, spot] = 0
    sizes = index["width"].astype(np.int64) * (BLOCK // 8)
    index["start"] = np.cumsum(sizes) - sizes
    body: list[bytes] = [b""] * blocks
    for width in np.unique(index["width"]):
        if width:
            mine = np.flatnonzero(index["width"] == width)
            for i, row in zip(mine.tolist(), pack_bits(low[mine], int(width))):
                body[i] = row.tobytes()
    return STREAM.pack(n, blocks, len(patches)) + index.tobytes() + patches.tobytes() + b"".join(body)


def decode_stream(data: memoryview) -> tuple[np.ndarray, int]:
    """(numbers, bytes read) of an encoded stream."""
    n, blocks, patched = STREAM.unpack_from(data)
    at = STREAM.size
    index = np.frombuffer(data, INDEX, blocks, at)
    at += index.nbytes
    patches = np.frombuffer(data, [("spot", "u1"), ("rest", "<u4")], patched, at)
    at += patches.nbytes
    total = int(index["width"].astype(np.int64).sum()) * (BLOCK // 8)
    body = np.frombuffer(data, np.uint8, total, at)
    values = np.zeros((blocks, BLOCK), np.uint32)
    for width in np.unique(index["width"]):
        if width:
            mine = np.flatnonzero(index["width"] == width)
            size = int(width) * BLOCK // 8
            values[mine] = unpack_bits(np.stack([body[at : at + size] for at in index["start"][mine].tolist()]), int(width))
    values[np.repeat(np.arange(blocks), index["exceptions"]), patches["spot"]] = patches["rest"]
    values += index["base"][:, None]
    return values.reshape(-1)[:n], at + total


def encode_shard(lengths: np.ndarray, ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    return HEAD.pack(MAGIC, len(lengths), len(ids)) + encode_stream(lengths, percentile) + encode_stream(ids, percentile)


def decode_shard(image: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(document lengths, ids) of a shard image."""
    view = memoryview(image)
    magic, documents, tokens = HEAD.unpack_from(view)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    lengths, used = decode_stream(view[HEAD.size :])
    ids, _ = decode_stream(view[HEAD.size + used :])
    if len(lengths) != documents or len(ids) != tokens:
        raise ValueError("token shard is cut short")
    return lengths, ids


def range_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids that cut the rows into ``parts`` nearly equal ranges; an id of many rows is several bounds."""
    if parts < 2:
        return np.zeros(0, np.int64)
    steps = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", steps, 100 * parts)).first()[0]  # one number per part
    return np.array(found or [], np.int64)


def encode_documents(docs: DataFrame, tokenizer: str, parts: int, end_id: int = END_ID) -> tuple[DataFrame, np.dtype]:
    """(part, doc_id, ids) of whole texts with the end id, encoded where the rows lie, and the width of an id.

    Ids take two bytes while the vocabulary allows it. Parts ascend with doc_id (null first); rows of an id that fills
    more than a part are dealt to all of its parts.
    """
    kind = np.dtype("<u2" if max(len(encoder(tokenizer).sizes) - 1, end_id) < 1 << 16 else "<u4")
    release()  # the driver keeps no vocabulary
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bounds = range_bounds(ordered, parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_ids = encoder(tokenizer).flat_ids
        for batch in batches:
            for lo, hi, texts in text_chunks(batch.column(1)):
                names = batch.column(0).slice(lo, hi - lo)
                ids, counts = flat_ids(texts)
                ends = np.cumsum(counts + 1)
                data = np.full(ends[-1], end_id, kind)
                data[np.delete(np.arange(ends[-1]), ends - 1)] = ids
                stops = np.concatenate([[0], ends]) * kind.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(stops), pa.py_buffer(data)]).cast(pa.binary())
                numbers = names.fill_null(-(1 << 63)).to_numpy()
                first, last = (np.searchsorted(bounds, numbers, side) for side in ("left", "right"))
                part = first + np.array([zlib.crc32(x.as_buffer()) for x in column]) % (last - first + 1)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), names, column], names=["part", "doc_id", "ids"])

    return ordered.mapInArrow(encode, "part int, doc_id long, ids binary"), kind


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                      shard_tokens: int = SHARD_TOKENS, percentile: float = PERCENTILE) -> None:
    """Encodes whole texts and writes shards in ascending doc_id order (null first).

    Null and empty texts are the end id alone; rows that repeat a doc_id stay side by side, and one id's rows may fill many
    shards. A document longer than ``shard_tokens`` has a shard to itself. Columns besides doc_id and text are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded, kind = encode_documents(docs, tokenizer, parts, end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names: list = []
        held: list[np.ndarray] = []
        tokens = made = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, tokens, made
            lengths = np.array([len(h) for h in held], np.uint32)
            image = encode_shard(lengths, np.concatenate(held).astype(np.uint32), percentile)
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "shard": made, "n_docs": len(held), "n_tokens": tokens, "doc_ids": names, "image": image}],
                pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                           ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())]),
            )
            names, held, tokens, made = [], [], 0, made + 1
            return row

        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(data.as_buffer(), kind)
                if held and tokens + len(ids) > shard_tokens:
                    yield flush()
                names.append(key)
                held.append(ids)
                tokens += len(ids)
        if held:
            yield flush()

    ordered = encoded.repartitionById(parts, "part").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    ordered.mapInArrow(shards, SHARD).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = decode_shard(row["image"])
                ends = np.cumsum(lengths.astype(np.int64))
                data = ids.astype("<u4").tobytes()
                cut = np.concatenate([[0], ends]) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(np.full(len(ends), row["shard"], np.int32)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)),
                     pa.array([data[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["part", "shard", "doc_id", "in_shard", "n_tokens", "ids"],
                )

    return _with_starts(spark, path, spark.read.schema(SHARD).parquet(path).mapInArrow(open_shards, ROWS))


def _with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replaces the place inside the shard by the place in the whole corpus."""
    heads = spark.read.schema(SHARD).parquet(path).select("part", "shard", "n_tokens")
    totals = heads.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per write task, then one row per shard of a task
    behind = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(behind), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("before"))
    starts = heads.join(totals, "part").select("part", "shard", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(starts, ["part", "shard"]).withColumn("start", F.col("base") + F.col("in_shard")).drop("part", "shard", "in_shard", "base")


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_files, with the checksum of each document's ids instead of the ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths, ids = decode_shard(row["image"])
                ends = np.cumsum(lengths.astype(np.int64))
                data = memoryview(ids.astype("<u4").tobytes())
                cut = np.concatenate([[0], ends]) * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ends), row["part"], np.int32)), pa.array(np.full(len(ends), row["shard"], np.int32)),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths.astype(np.int64)),
                     pa.array([zlib.crc32(data[a:b]) for a, b in zip(cut[:-1], cut[1:])], pa.int64())],
                    names=["part", "shard", "doc_id", "in_shard", "n_tokens", "ids_crc32"],
                )

    rows = spark.read.schema(SHARD).parquet(path).mapInArrow(digest, ROWS.replace("ids binary", "ids_crc32 long"))
    return _with_starts(spark, path, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op5_tokenfile")
def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file_digest(spark, path)

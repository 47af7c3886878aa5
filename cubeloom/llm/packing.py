"""Packing of token sequences: shortest-pack-first over the length histogram, joined back by rank.

Only the histogram (one count per length, at most ``max_len`` numbers) reaches the driver. Lengths are placed
longest first into the pack with the most room; packs of equal fill form one run of sequence numbers, so a
placement is one row (length, ranks, first sequence, offset) whatever the number of documents behind it. The
pieces find their row by length and rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table, written
from cubeloom.llm.tokens import CACHE_ENTRIES, encoder, lean, text_chunks

MAX_LEN = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, doc_tokens long, part int, nth long, ids binary"
RUNS = "length long, first long, count long, sequence long, offset long"


def shortest_pack_first(histogram: Mapping[int, int], max_len: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) rows that place every piece of the histogram.

    A heap holds runs of equally filled packs, emptiest first; a run that is only partly used is split in two.
    Every length adds at most two runs, so there are at most 2 * max_len runs at any time.
    """
    runs: list[tuple[int, int, int]] = []  # (fill, first sequence, count)
    sequences = 0
    placed = []
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        refilled = []
        while left:
            if runs and runs[0][0] + length <= max_len:
                fill, first, count = heapq.heappop(runs)
                used = min(left, count)
                if used < count:
                    refilled.append((fill, first + used, count - used))
            else:
                fill, first, used = 0, sequences, left
                sequences += left
            placed.append((length, rank, used, first, fill))
            if fill + length < max_len:
                heapq.heappush(runs, (fill + length, first, used))
            left -= used
            rank += used
        for run in refilled:
            heapq.heappush(runs, run)
    return placed


def cut_documents(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID,
                  entries: int = CACHE_ENTRIES, frugal: bool = False) -> DataFrame:
    """Pieces of at most ``max_len`` ids of every document; ``ids`` holds little-endian unsigned 32-bit numbers.

    Null and empty texts are the end id alone. ``part`` and ``nth`` number equal lengths within a task; the table
    is written, so these numbers stay as they are if an executor is lost. ``frugal`` tasks leave no words in their worker.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, entries).ids
        part = TaskContext.get().partitionId()
        seen = np.zeros(max_len + 1, np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            names = batch.column(0)
            for lo, _, texts in text_chunks(batch.column(1)):
                row, start, length, total, nth, ids = [], [], [], [], [], []
                for i, found in enumerate(encode(texts), lo):
                    found += end
                    n = len(found) // 4
                    for s in range(0, n, max_len):
                        size = min(max_len, n - s)
                        row.append(i)
                        start.append(s)
                        length.append(size)
                        total.append(n)
                        nth.append(seen[size])
                        seen[size] += 1
                        ids.append(found[4 * s : 4 * (s + size)])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()),
                     pa.array(np.full(len(row), part, np.int32)), pa.array(np.array(nth, np.int64)), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "part", "nth", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut) if frugal else cut, PIECES)
    return written(rows, "pieces")


def place(pieces: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Adds sequence_id and offset to pieces that carry length, part and nth."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # one row per length and task, far fewer than the pieces
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most max_len rows
    runs = spark.createDataFrame(shortest_pack_first(histogram, max_len), RUNS)
    ranked = pieces.join(counts.select("part", "length", "before"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    inside = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("count"))
    # the runs are bounded by max_len whatever the number of documents (see shortest_pack_first)
    placed = ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")), (F.col("length") == F.col("run_length")) & inside)
    return placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first")).drop(
        "part", "nth", "before", "rank", "run_length", "first", "count", "sequence"
    )


def pack(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, end_id: int = END_ID, entries: int = CACHE_ENTRIES,
         frugal: bool = False) -> DataFrame:
    """Packed pieces: doc_id, start, length, doc_tokens, ids (binary), sequence_id, offset.

    A null or empty text is packed as its end id; a null doc_id is kept; repeated rows are packed one by one; an
    empty table gives no rows; columns besides doc_id and text are not read.
    """
    return place(cut_documents(docs, tokenizer, max_len, end_id, entries, frugal), max_len)


def packed_digest(docs: DataFrame, tokenizer: str, entries: int = CACHE_ENTRIES) -> DataFrame:
    """The placement of every piece with a checksum of its ids instead of the ids."""
    pieces = cut_documents(docs, tokenizer, entries=entries).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

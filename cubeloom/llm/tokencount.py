"""Token counts by section: whole documents are encoded once, tokens are attributed by their place in the text.

A byte-level vocabulary gives every id its number of bytes, so the running sum of those numbers over a document's ids is the
span of each token. The spans meet the sections' spans in a sorted interval join, and an explicit rule says where a token
that crosses a boundary counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table
from cubeloom.llm.tokens import encoder, text_chunks

RULES = ("first", "last", "most", "share")
COUNTS = "doc_id long, section long, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def line_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the lines, each with its line end; together they cover the text."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(ends) == 0 or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends[:-1]]), ends


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section, plus a last entry for tokens outside all sections.

    Sections are sorted and do not overlap. A token crosses when its first and last byte lie in different sections. It counts
    for the section of its first byte, of its last byte, of most of its bytes (equal parts: the earlier), or in shares of its bytes.
    """
    n = len(lo)

    def at(place: np.ndarray) -> np.ndarray:
        found = np.searchsorted(lo, place, "right") - 1
        inside = (found >= 0) & (place < hi[np.maximum(found, 0)]) if n else np.zeros(len(place), bool)
        return np.where(inside, found, n)

    first, last = at(starts), at(np.maximum(ends - 1, starts))
    cross = first != last
    crossing = np.bincount(first[cross], minlength=n + 1) + np.bincount(last[cross], minlength=n + 1)
    if rule == "first":
        return np.bincount(first, minlength=n + 1).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n + 1).astype(float), crossing
    counts = np.bincount(first[~cross], minlength=n + 1).astype(float)
    for s, e in zip(starts[cross], ends[cross]):  # few tokens cross, and a token has few bytes
        spots = np.bincount(at(np.arange(s, e)), minlength=n + 1)
        if rule == "share":
            counts += spots / (e - s)
        else:
            counts[np.argmax(spots)] += 1
    return counts, crossing


def section_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", sections: str | None = None) -> DataFrame:
    """Tokens per section: doc_id, section, start, end (code points), n_tokens, n_crossing, doc_tokens (of the whole document).

    ``sections`` names a column array<struct<start: long, end: long>> of sorted, disjoint code-point spans; without it the
    sections are the lines. Tokens outside all sections are section -1. A null or empty text, or one without sections and
    tokens, gives section 0 with no tokens, so every document row has a row. Repeated rows are counted one by one, null ids are
    kept, other columns are not read, and an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sizes = encoder(tokenizer).ids, encoder(tokenizer).sizes
        for batch in batches:
            given = batch.column(2) if sections else None
            for lo, _, texts in text_chunks(batch.column(1)):
                out: list[tuple[np.ndarray, ...]] = []
                rows = []
                for i, (text, found) in enumerate(zip(texts.to_pylist(), encode(texts)), lo):
                    data = (text or "").encode()
                    widths = sizes[np.frombuffer(found, "<u4")]
                    ends = np.cumsum(widths)
                    if sections:
                        spans = given[i].as_py() or []
                        leads = np.append(np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80), len(data))
                        cut = np.array([(s["start"], s["end"]) for s in spans], np.int64).reshape(-1, 2)
                        low, high = (leads[np.minimum(cut[:, j], len(leads) - 1)] for j in (0, 1))
                    elif data:
                        low, high = line_bounds(data)
                    else:
                        low = high = np.zeros(0, np.int64)
                    counts, crossing = attribute(ends - widths, ends, low, high, rule)
                    number = np.arange(len(low) + 1)
                    number[-1] = -1
                    keep = np.ones(len(number), bool)
                    keep[-1] = counts[-1] > 0 or crossing[-1] > 0
                    if not keep.any():
                        number, keep = np.zeros(1, np.int64), np.ones(1, bool)
                    # byte places back to code points
                    if len(data) == len(text or ""):
                        s, e = low, high
                    else:
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                        s, e = points[low], points[high]
                    s, e = np.append(s, 0), np.append(e, 0)
                    out.append((number[keep], s[keep], e[keep], counts[keep], crossing[keep], np.full(keep.sum(), len(widths))))
                    rows.append(np.full(keep.sum(), i))
                if out:
                    columns = [np.concatenate(c) for c in zip(*out)]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                        names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"],
                    )

    wanted = [F.col("doc_id").cast("long"), F.col("text"), *([F.col(sections)] if sections else [])]
    return docs.select(*wanted).mapInArrow(count, COUNTS)


@query("op10_tokencount")
def op10_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))

"""Periodic runs of words: online dyadic square catching.

Words are appended to a stream. A block of 2**k words that starts at a multiple of 2**k is a catcher once it is complete. A
catcher of length b watches the distances q whose squares are long enough to hold a whole aligned block of that length, and
compares its fingerprint with that of each newly completed stretch of b words, q words on. A hit is extended in both directions by
comparing fingerprints of halving length; what reaches the end of the stream stays open and grows with the next words.
Squares of one period that overlap by a period extend to the same run, so a run is known by its start and its period; of
several periods of one stretch the smallest counts.

Fingerprints of 2**k words are 64-bit mixes of the halves' fingerprints, and single words are numbered exactly. Every run found is
compared word by word before it is reported.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table

MIN_LENGTH = 12
#: Words that one group of documents brings to the catchers; a longer document is a group of its own.
GROUP_WORDS = 100_000
DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def shuffled_bits(x: np.ndarray) -> np.ndarray:
    """One-to-one mix of 64-bit numbers: equal numbers stay equal, near ones part."""
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA24BAED4963EE407)
    return x ^ (x >> np.uint64(32))


class SquareCatchers:
    """Runs of a stream of numbers, of at least ``min_length`` words and twice their period.

    Kept between appends: the words, the fingerprints of each length, closed runs, and the stretches that still reach the end.
    """

    def __init__(self, min_length: int = MIN_LENGTH, longest_period: int | None = None):
        self.min_length = max(2, min_length)
        self.longest_period = longest_period  # for a caller who knows that none can be longer
        self.words = np.zeros(0, np.int64)
        self.marks: list[np.ndarray] = []  # marks[k][i] stands for the words i to i + 2**k - 1
        self.closed: list[np.ndarray] = []  # rows (start, period, end)
        self.open = np.zeros((0, 2), np.int64)  # rows (start, period) of stretches that reach the end

    def __len__(self) -> int:
        return len(self.words)

    def distances(self, k: int) -> tuple[int, int]:
        """First and last distance that the catchers of 2**k words watch.

        The words of a run of period q that equal the word q places on are max(q, min_length - q) in a row at least; any
        2**(k+1) - 1 words in a row hold an aligned block of 2**k. Each distance goes to the longest such block.
        """
        low, high = 2 ** (k + 1) - 1, 2 ** (k + 2) - 2
        watched = [q for q in range(1, high + 1) if low <= max(q, self.min_length - q) <= high]
        return (watched[0], watched[-1]) if watched else (1, 0)

    def append(self, words: np.ndarray) -> None:
        """Takes further words."""
        before = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, np.int64)])
        n = len(self.words)
        longest = n // 2 if self.longest_period is None else min(self.longest_period, n // 2)
        self._fingerprint(n, longest)
        hits = [self.open]
        k = 0
        while 2**k <= max(longest, self.min_length):
            first, last = self.distances(k)
            last = min(last, longest)
            if first <= last and k < len(self.marks):
                hits.append(self._catch(k, first, last, before))
            k += 1
        found = np.concatenate(hits)
        if len(found):
            self._extend(found, n)

    def runs(self) -> np.ndarray:
        """Rows (start, length, period) of the runs so far, by start, then period."""
        rows = [c for c in self.closed if len(c)]
        if len(self.open):
            ends = np.full((len(self.open), 1), len(self.words))
            rows.append(np.concatenate([self.open, ends], axis=1))
        if not rows:
            return np.zeros((0, 3), np.int64)
        rows = np.concatenate(rows)
        length = rows[:, 2] - rows[:, 0]
        rows = rows[length >= np.maximum(self.min_length, 2 * rows[:, 1])]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 2], rows[:, 0]))]
        # of several periods of one stretch the smallest comes first
        same = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 2] == rows[:-1, 2])
        rows = rows[np.concatenate([[True], ~same])] if len(rows) else rows
        for start, period, end in rows.tolist():
            if not np.array_equal(self.words[start : end - period], self.words[start + period : end]):
                raise ArithmeticError("two stretches of words share a fingerprint")
        out = np.stack([rows[:, 0], rows[:, 2] - rows[:, 0], rows[:, 1]], axis=1)
        return out[np.lexsort((out[:, 2], out[:, 0]))]

    def _fingerprint(self, n: int, longest: int) -> None:
        """Brings the fingerprints of each length up to the words at hand."""
        if not self.marks:
            self.marks.append(np.zeros(0, np.uint64))
        done = len(self.marks[0])
        self.marks[0] = np.concatenate([self.marks[0], shuffled_bits(self.words[done:].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))])
        k = 1
        while 2**k <= min(n, max(longest, self.min_length)):
            if len(self.marks) == k:
                self.marks.append(np.zeros(0, np.uint64))
            half, mine = self.marks[k - 1], self.marks[k]
            done, most = len(mine), n - 2**k + 1
            if most > done:
                left, right = half[done:most], half[done + 2 ** (k - 1) : most + 2 ** (k - 1)]
                fresh = shuffled_bits(left * np.uint64(0xD6E8FEB86659FD93) + shuffled_bits(right + np.uint64(k)))
                self.marks[k] = np.concatenate([mine, fresh])
            k += 1

    def _catch(self, k: int, first: int, last: int, before: int) -> np.ndarray:
        """(place, distance) where a catcher meets its own words again in what was appended; one per chain of blocks."""
        block, marks = 2**k, self.marks[k]
        # the second stretch ends behind ``before``: the catcher starts behind this place
        low = max(0, before - last - block) // block * block
        starts = np.arange(low, max(low, len(marks) - first), block)
        if len(starts) == 0:
            return np.zeros((0, 2), np.int64)
        span = last - first + 1
        # places past the end hold each its own word's opposite: equal to no catcher
        ahead = np.concatenate([marks[low + first :], np.zeros(span + block, np.uint64)])
        windows = np.lib.stride_tricks.sliding_window_view(ahead, span)[: len(starts) * block : block]
        starts = starts[: len(windows)]
        mine = marks[starts]
        met = windows == mine[:, None]
        if not met.any():
            return np.zeros((0, 2), np.int64)
        met[1:] &= ~met[:-1].copy()  # blocks side by side with the same distance extend to the same stretch
        row, column = np.nonzero(met)
        place, distance = starts[row], column + first
        inside = place + distance + block <= len(self.words)
        return np.stack([place[inside], distance[inside]], axis=1)

    def _extend(self, found: np.ndarray, n: int) -> None:
        """Suffix comparisons: the whole stretch in which words equal those one distance on."""
        left, ahead = found[:, 0].copy(), found[:, 0].copy()
        gap = found[:, 1]
        sizes = [2**k for k in range(len(self.marks))][::-1]
        for size in sizes:
            marks = self.marks[size.bit_length() - 1]
            active = np.arange(len(gap))
            while len(active):  # only the longest steps can be made more than once
                at = ahead[active]
                fits = at + gap[active] + size <= n
                active, at = active[fits], at[fits]
                active = active[marks[at] == marks[at + gap[active]]]
                ahead[active] += size
                if size != sizes[0]:
                    break
            active = np.arange(len(gap))
            while len(active):
                active = active[left[active] >= size]
                at = left[active] - size
                active = active[marks[at] == marks[at + gap[active]]]
                left[active] -= size
                if size != sizes[0]:
                    break
        rows = np.unique(np.stack([left, gap, ahead + gap], axis=1), axis=0)
        ends = rows[:, 2] == n
        whole = rows[:, 2] - rows[:, 0] >= np.maximum(self.min_length, 2 * rows[:, 1])
        self.closed.append(rows[~ends & whole])
        self.open = rows[ends][:, :2]


def find_runs(words: list, min_length: int = MIN_LENGTH, step: int | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, appended ``step`` at a time."""
    numbers: dict = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    catchers = SquareCatchers(min_length)
    for at in range(0, len(ids), step or max(1, len(ids))):
        catchers.append(ids[at : at + (step or len(ids))])
    return [tuple(r) for r in catchers.runs().tolist()]


def dropped_words(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Flags of the words that some run holds behind its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:n] > 0


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's tables: one document in ten gets a periodic tail, by its id (the contract of op13)."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if n == 0 or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, prepare=None, digest: bool = False) -> DataFrame:
    """Runs of the words ``[^\\x20\\x09-\\x0D]+`` of every whole text: doc_id, words (n), runs array<struct<start, length, period>>, collapsed text.

    A run is a stretch of at least ``min_length`` words and two periods that no neighbouring word extends; the collapsed text
    keeps of each run its first period, words joined by one space. Null, empty and blank texts have no words and no runs; a null
    doc_id is kept; repeated rows are answered one by one; an empty table gives no rows; other columns are not read.
    ``prepare(doc_id, words)`` may change the words first; ``digest`` returns the columns of op13 instead.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary())
            group: list[tuple[int | None, list[bytes]]] = []
            held = 0
            for name, text in zip(names, texts):
                words = (text.as_py() or b"").split()  # of bytes: just the ASCII blanks part words
                words = prepare(name, words) if prepare else words
                group.append((name, words))
                held += len(words)
                if held >= GROUP_WORDS:
                    yield answer(group, min_length, digest)
                    group, held = [], 0
            if group:
                yield answer(group, min_length, digest)

    kind = DIGEST if digest else "doc_id long, words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(search, kind)


def group_runs(texts: list[list[bytes]], min_length: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text: the texts, longest first, pass the catchers as one stream, parted by words found nowhere else."""
    numbers: dict[bytes, int] = {}
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    order = [i for i in order if len(texts[i]) >= min_length]
    stream: list[int] = []
    begins = []
    for j, i in enumerate(order):
        begins.append(len(stream))
        stream.extend([numbers.setdefault(w, len(numbers)) for w in texts[i]])
        stream.append(-1 - j)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not order:
        return out
    ids = np.array(stream, np.int64)
    found = []
    first = 0
    while first < len(order):  # texts of like length share catchers, so that short texts wait for no long periods
        longest = len(texts[order[first]])
        last = first
        while last < len(order) and 2 * len(texts[order[last]]) >= longest:
            last += 1
        stop = begins[last] if last < len(order) else len(ids)
        catchers = SquareCatchers(min_length, longest // 2)
        catchers.append(ids[begins[first] : stop])
        found.append(catchers.runs() + np.array([begins[first], 0, 0]))
        first = last
    found = np.concatenate(found)
    where = np.searchsorted(begins, found[:, 0], "right") - 1
    for j, (start, length, period) in zip(where.tolist(), found.tolist()):
        out[order[j]].append((start - begins[j], length, period))
    return out


def answer(group: list[tuple[int | None, list[bytes]]], min_length: int, digest: bool) -> pa.RecordBatch:
    """Result rows of a group of documents."""
    texts = [w for _, w in group]
    rows = []
    for (name, words), runs in zip(group, group_runs(texts, min_length)):
        if runs:
            gone = dropped_words(runs, len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g])
        else:
            kept = b" ".join(words)
        if not digest:
            rows.append((name, len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], kept.decode()))
            continue
        listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs])
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        rows.append((name, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
                     hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    if digest:
        fields = [(c, pa.int64()) for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")]
        fields += [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
    else:
        fields = [("doc_id", pa.int64()), ("words", pa.int64()), ("runs", pa.list_(span)), ("collapsed", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), fields)], names=[f for f, _ in fields])


@query("op13_squares")
def op13_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), prepare=repeated_tail, digest=True)

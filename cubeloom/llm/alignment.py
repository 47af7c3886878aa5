"""Alignment of two tokenizers' tokens: an associative monoid of text fragments.

Both vocabularies have tokens that never run from a character that is not white space into a space behind it, so both sides
end a token there: a group of aligned tokens always closes. A stretch of a text, cut at any character, is a fragment: an open
prefix up to the first such place, the closed groups of what lies between the first and the last, and an open suffix (a stretch
without such a place is open as a whole). Two neighbouring fragments compose by aligning what their open ends form together;
the composition is associative, so the chunks of a very long document are aligned by different tasks and composed in a tree.

A segment between two such places is aligned once per worker (bounded cache): words repeat.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from cubeloom.llm.common import query, table, written
from cubeloom.llm.tokens import RUNS, encoder, token_cuts

# Both sides end a token between a character that is not white space and a space.
CLOSE = re.compile(r"(?<=\S)(?= )")
MARK = "▁"  # stands for the space in a piece vocabulary; as text it would be read as one
#: Bytes of a chunk; texts of one chunk are aligned where they lie.
CHUNK_BYTES = 1 << 16
#: Fragments that one step of the tree composes.
FAN_IN = 8
#: Segments that a worker keeps of each of two generations.
SEGMENTS = 200_000
#: An id pair that this share of the documents hold is looked up in the tasks; 1 / HOT_SHARE times the mean number of a document's pairs bounds them.
HOT_SHARE = 1 / 500


#: What a worker keeps of a segment: tokens of both sides, groups, the groups as text, linked pairs (one little-endian 64-bit number
#: a << 32 | b for each link), and whether the pieces' bytes are the segment's bytes.
Segment = tuple[int, int, int, str, bytes, bool]


class Aligner:
    """Aligns segments that begin with a space."""

    def __init__(self, a_path: str, b_path: str, segments: int = SEGMENTS):
        self.a = encoder(a_path, 1)  # its words are not kept twice
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        ]
        if any(re.search(f"[^{MARK}]{MARK}", self.b.id_to_piece(i)) for i in range(self.b.vocab_size()) if not self.b.is_control(i)):
            raise ValueError("a piece of the second vocabulary runs over a space")
        self.a_sizes = self.a.sizes
        self.b_sizes = np.array([len(t) for t in self.b_bytes], np.int64)
        self.blank = self.b.piece_to_id(MARK)
        # an id as text with what may follow it in a group
        self.a_texts, self.b_texts = (
            [np.array([f"{i}{mark}" for i in range(n)], object) for mark in marks]
            for n, marks in ((len(self.a_sizes), ",|"), (len(self.b_sizes), ",;"))
        )
        self.segments = segments
        self.known: dict[str, Segment] = {}
        self.older: dict[str, Segment] = {}

    def joined(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and their number in each segment, for segments that end in no white space.

        Many are encoded in one text, and its ids are parted by their bytes. The piece model adds the first space by itself.
        """
        sides = []
        bare = [s[1:] for s in segments]
        for sizes, size in ((self.a_sizes, 1024), (self.b_sizes, 16)):
            parts = [bare[at : at + size] for at in range(0, len(bare), size)]
            texts = [" ".join(p) for p in parts]
            if size == 16:
                found = self.b.encode(texts, num_threads=1)
            else:
                found = [f.ids for f in self.a.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), np.int64)
            sides += [ids, np.diff(token_cuts(ids, sizes, bare), prepend=0)]
        return tuple(sides)

    def single(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for any segments, one by one."""
        left = [f.ids for f in self.a.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        right = [ids or [self.blank] for ids in self.b.encode([s[1:] for s in segments], num_threads=1)]
        a, b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (left, right))
        return a, np.array([len(x) for x in left]), b, np.array([len(x) for x in right])

    def learn(self, segments: list[str]) -> None:
        """Aligns segments that are not known yet."""
        together = [s for s in segments if not s[-1].isspace() and MARK not in s]
        others = [s for s in segments if s[-1].isspace() or MARK in s]
        for part, encode in ((together, self.joined), (others, self.single)):
            for at in range(0, len(part), 8192):
                some = part[at : at + 8192]
                self.known.update(zip(some, self._align(some, *encode(some))))

    def _align(self, segments: list[str], a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> list[Segment]:
        sizes = np.fromiter(map(len, map(str.encode, segments)), np.int64, len(segments))
        covered = np.concatenate([[0], np.cumsum(self.b_sizes[b])])[np.cumsum(n_b)]
        if np.array_equal(covered, np.cumsum(sizes)) and b"".join([self.b_bytes[i] for i in b.tolist()]) == "".join(segments).encode():
            whole = [True] * len(segments)
        else:
            stops = np.cumsum(n_b).tolist()
            ids = b.tolist()
            whole = [b"".join([self.b_bytes[i] for i in ids[x:y]]) == s.encode() for s, x, y in zip(segments, [0, *stops], stops)]
        # a segment whose pieces differ from it would shift what follows: such segments get no groups
        keep_a, keep_b = np.repeat(whole, n_a), np.repeat(whole, n_b)
        a, b = a[keep_a], b[keep_b]
        n_a, n_b, sizes = np.where(whole, n_a, 0), np.where(whole, n_b, 0), np.where(whole, sizes, 0)
        ends_a, ends_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        if len(ends_a) and ends_a[-1] != sizes.sum():
            raise ValueError("the first vocabulary does not keep every byte")
        spot = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
        closes = ends_a[ends_b[spot] == ends_a] if len(ends_b) else ends_a
        group_a, group_b = np.searchsorted(closes, ends_a), np.searchsorted(closes, ends_b)
        count_a, count_b = np.bincount(group_a, minlength=len(closes)), np.bincount(group_b, minlength=len(closes))
        # every first-side token meets all second-side tokens of its group
        reach = count_b[group_a]
        begin_b = np.cumsum(count_b) - count_b
        inner = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
        pairs = (np.repeat(a, reach).astype("<u8") << np.uint64(32)) | b[np.repeat(begin_b[group_a], reach) + inner].astype("<u8")
        stops = np.cumsum(sizes)
        last_group = np.searchsorted(closes, stops, "right")
        links = np.concatenate([[0], np.cumsum(count_a * count_b)])
        bytes_of = pairs.tobytes()
        # the text of a group is a1,a2|b1,b2 and a mark that parts it from the next
        tokens = np.empty(len(a) + len(b), object)
        begin_a = np.cumsum(count_a) - count_a
        last_a = np.arange(len(a)) + 1 == (begin_a + count_a)[group_a]
        last_b = np.arange(len(b)) + 1 == (begin_b + count_b)[group_b]
        tokens[np.arange(len(a)) + begin_b[group_a]] = np.where(last_a, self.a_texts[1][a], self.a_texts[0][a])
        tokens[np.arange(len(b)) + (begin_a + count_a)[group_b]] = np.where(last_b, self.b_texts[1][b], self.b_texts[0][b])
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))])
        ends = ends[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        text = "".join(tokens.tolist())
        n_groups = np.diff(last_group, prepend=0).tolist()
        cuts = (8 * links[np.concatenate([[0], last_group])]).tolist()
        return [
            (x, y, n, text[i : j - 1] if j > i else "", bytes_of[v:w], ok)
            for x, y, n, i, j, v, w, ok in zip(n_a.tolist(), n_b.tolist(), n_groups, ends, ends[1:], cuts, cuts[1:], whole)
        ]

    def align(self, texts: list[list[str]]) -> list[list[Segment]]:
        """Segments of each text."""
        collecting = gc.isenabled()
        gc.disable()  # only acyclic objects are made here, in great number
        try:
            if len(self.known) > self.segments:
                self.older, self.known = self.known, {}
            known = self.known
            fresh = {p for pieces in texts for p in pieces if p not in known}
            missing = []
            for p in fresh:
                old = self.older.get(p)
                if old is None:
                    missing.append(p)
                else:
                    known[p] = old
            self.learn(missing)
            return [[known[p] for p in pieces] for pieces in texts]
        finally:
            if collecting:
                gc.enable()


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str, segments: int = SEGMENTS) -> Aligner:
    """The aligner of this Python worker."""
    return Aligner(a_path, b_path, segments)


def segments_of(text: str) -> list[str]:
    """The segments of a whole text that begins with a space."""
    if any(run in text for run in RUNS):
        return CLOSE.split(text)
    return list(map(" ".__add__, text[1:].split(" ")))  # each space is a place to close


@dataclass(slots=True)
class Closed:
    """Closed groups side by side; adding two of them joins them."""

    n_a: int = 0
    n_b: int = 0
    groups: list[str] = field(default_factory=list)  # texts of one group or more
    n_groups: int = 0
    pairs: list[bytes] = field(default_factory=list)
    whole: bool = True

    @staticmethod
    def of(segments: list[Segment]) -> Closed:
        if not segments:
            return Closed()
        n_a, n_b, n_groups, groups, pairs, whole = zip(*segments)
        return Closed(sum(n_a), sum(n_b), list(groups), sum(n_groups), list(pairs), all(whole))

    def __add__(self, other: Closed) -> Closed:
        return Closed(self.n_a + other.n_a, self.n_b + other.n_b, self.groups + other.groups, self.n_groups + other.n_groups,
                      self.pairs + other.pairs, self.whole and other.whole)


Align = Callable[[list[str]], Closed]


@dataclass(slots=True)
class Fragment:
    """A stretch of a text: open prefix, closed groups, open suffix; ``closed`` is None while the whole stretch is open."""

    prefix: str
    closed: Closed | None = None
    suffix: str = ""


def fragment(text: str, align: Align) -> Fragment:
    """The fragment of a stretch cut anywhere between two characters."""
    pieces = CLOSE.split(text)
    if len(pieces) == 1:
        return Fragment(text)
    return Fragment(pieces[0], align(pieces[1:-1]), pieces[-1])


def compose(left: Fragment, right: Fragment, align: Align) -> Fragment:
    """The fragment of both stretches side by side: associative, with the open empty stretch as its neutral element."""
    middle = (left.prefix if left.closed is None else left.suffix) + right.prefix
    pieces = CLOSE.split(middle)  # only the seam can be a new place to close
    if left.closed is None and right.closed is None:
        return Fragment(middle) if len(pieces) == 1 else Fragment(pieces[0], Closed(), pieces[1])
    if left.closed is None:
        return Fragment(pieces[0], align(pieces[1:]) + right.closed, right.suffix)
    if right.closed is None:
        return Fragment(left.prefix, left.closed + align(pieces[:-1]), pieces[-1])
    return Fragment(left.prefix, left.closed + align(pieces) + right.closed, right.suffix)


def finish(whole: Fragment, align: Align) -> Closed:
    """The groups of a whole text: its ends close the open ends."""
    if whole.closed is None:
        return align([whole.prefix])
    return align([whole.prefix]) + whole.closed + align([whole.suffix])


FRAGMENTS = "key long, doc_id long, chunk int, chunks int, open boolean, prefix string, n_a long, n_b long, n_groups long, groups string, pairs binary, whole boolean, suffix string"
ALIGNED = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def chunks_of(text: str, size: int) -> list[str]:
    """The text in stretches of about ``size`` bytes, cut between characters."""
    data = text.encode()
    cuts = [0]
    while len(data) - cuts[-1] > size:
        at = cuts[-1] + size
        while at < len(data) and data[at] & 0xC0 == 0x80:  # inside a character
            at += 1
        if at >= len(data):
            break
        cuts.append(at)
    return [data[i:j].decode() for i, j in zip(cuts, [*cuts[1:], len(data)])]


def _row(key: int, doc_id, chunk: int, chunks: int, f: Fragment) -> dict:
    c = f.closed or Closed()
    return {
        "key": key, "doc_id": doc_id, "chunk": chunk, "chunks": chunks, "open": f.closed is None, "prefix": f.prefix, "n_a": c.n_a, "n_b": c.n_b,
        "n_groups": c.n_groups, "groups": ";".join([g for g in c.groups if g]), "pairs": b"".join(c.pairs), "whole": c.whole, "suffix": f.suffix,
    }


def _fragment_of(row) -> Fragment:
    if row["open"]:
        return Fragment(row["prefix"])
    groups = [row["groups"]] if row["groups"] else []
    return Fragment(row["prefix"], Closed(row["n_a"], row["n_b"], groups, row["n_groups"], [row["pairs"]], row["whole"]), row["suffix"])


def _digest(key: int, doc_id, closed: Closed | None) -> tuple:
    """Row of a whole document; without tokens all zeros and no text."""
    if closed is None or not closed.whole or not closed.n_a:
        return key, doc_id, 0, 0, 0, 0, "", b"", b""
    pairs = np.frombuffer(b"".join(closed.pairs), "<u8")
    codes, times = np.unique(pairs, return_counts=True)
    text = ";".join([g for g in closed.groups if g])
    return (key, doc_id, closed.n_a, closed.n_b, closed.n_groups, len(pairs), hashlib.sha256(text.encode()).hexdigest(),
            codes.tobytes(), times.astype("<u4").tobytes())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[c.split()[0] for c in ALIGNED.split(", ")])


def align_documents(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN,
                    segments: int = SEGMENTS) -> DataFrame:
    """One row per document row (written): key, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times.

    ``pairs`` holds the document's distinct id pairs as sorted 64-bit numbers a << 32 | b, ``times`` how many links each has. Texts
    longer than a chunk leave their task as chunks, are aligned wherever their chunks land, and come back by a tree.
    """

    def by(worker: Aligner) -> Align:
        return lambda pieces: Closed.of(worker.align([pieces])[0])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(a_path, b_path, segments)
        base, seen = TaskContext.get().partitionId() << 40, 0
        schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("text", pa.string())])
        empty = pa.array([None], pa.string())
        for batch in batches:
            names = batch.column(0).to_pylist()
            at = 0
            widths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            while at < len(names):  # about a megabyte of text at a time
                to = at + max(1, int(np.searchsorted(np.cumsum(widths[at:]), 1 << 20)))
                texts = batch.column(1).slice(at, to - at).to_pylist()
                rows, cut, long = [], [], []
                for name, text in zip(names[at:to], texts):
                    key, seen = base + seen, seen + 1
                    if not text or MARK in text:
                        rows.append(_digest(key, name, None))
                    elif len(text) > chunk_bytes or len(text.encode()) > chunk_bytes:
                        parts = chunks_of(" " + text, chunk_bytes)
                        long.extend([(key, name, i, len(parts), p) for i, p in enumerate(parts)])
                    else:
                        cut.append((key, name, segments_of(" " + text)))
                for (key, name, _), found in zip(cut, worker.align([c[2] for c in cut])):
                    rows.append(_digest(key, name, Closed.of(found)))
                if rows:
                    done = _batch(rows)
                    yield _both(done, None, empty)
                if long:
                    yield _both(None, pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*long), schema)], schema=schema), empty)
                at = to

    both = ALIGNED + ", chunk int, chunks int, text string"
    rows = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(start, both), "aligned")
    columns = [c.split()[0] for c in ALIGNED.split(", ")]
    whole = rows.filter("chunks IS NULL").select(*columns)
    chunks = rows.filter("chunks IS NOT NULL").select("key", "doc_id", "chunk", "chunks", "text")
    most = chunks.agg(F.max("chunks")).first()[0]
    if most is None:
        return whole

    def leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = by(aligner(a_path, b_path, segments))
        for batch in batches:
            for r in batch.to_dict("records"):
                yield pd.DataFrame([_row(r["key"], r["doc_id"], r["chunk"], r["chunks"], fragment(r["text"], align))])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        align = by(aligner(a_path, b_path, segments))
        rows = group.sort_values("chunk").to_dict("records")
        whole = functools.reduce(lambda x, y: compose(x, y, align), map(_fragment_of, rows))
        first = rows[0]
        return pd.DataFrame([_row(first["key"], first["doc_id"], first["chunk"] // fan_in, -(-first["chunks"] // fan_in), whole)])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = by(aligner(a_path, b_path, segments))
        for batch in batches:
            for r in batch.to_dict("records"):
                row = _digest(r["key"], r["doc_id"], finish(_fragment_of(r), align))
                yield pd.DataFrame([row], columns=columns)

    # the chunks of one text go to different tasks; a null id is no number in pandas, so ids come back by the key
    named = chunks.select("key", "doc_id").distinct()
    parts = chunks.withColumn("doc_id", F.lit(0).cast("long")).repartition("key", "chunk").mapInPandas(leaf, FRAGMENTS)
    while most > 1:  # one round per power of the fan-in
        parts = written(parts.groupBy("key", F.expr(f"chunk div {fan_in}").alias("_at")).applyInPandas(join, FRAGMENTS), "fragments")
        most = -(-most // fan_in)
    closed = parts.mapInPandas(close, ALIGNED).drop("doc_id").join(named, "key").select(*columns)
    return whole.unionByName(written(closed, "aligned-long"))


def _both(done: pa.RecordBatch | None, long: pa.RecordBatch | None, empty: pa.Array) -> pa.RecordBatch:
    """Rows of whole documents or of chunks in the columns of both."""
    names = [*[c.split()[0] for c in ALIGNED.split(", ")], "chunk", "chunks", "text"]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
    given = done if done is not None else long
    have = given.schema.names
    return pa.RecordBatch.from_arrays(
        [given.column(have.index(n)) if n in have else pa.nulls(given.num_rows, k) for n, k in zip(names, kinds)], names=names
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, n (documents that hold the pair linked), best (n is the highest of its first id) (written)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        total, codes, times = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add() -> None:
            nonlocal codes, times
            fresh, n = np.unique(np.concatenate(held), return_counts=True)
            every = np.concatenate([codes, fresh])
            codes, back = np.unique(every, return_inverse=True)
            times = np.bincount(back, np.concatenate([times, n])).astype(np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(times)], names=["pair", "n"])

        for batch in batches:
            for data in batch.column(0):
                found = np.frombuffer(data.as_buffer() or b"", "<i8")
                held.append(found)
                total += len(found)
                if total > 4_000_000:
                    add()
                    held, total = [], 0
                    if len(codes) > 4_000_000:  # a partial count: the sum behind the shuffle completes it
                        yield rows()
                        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if held:
            add()
        yield rows()

    counted = aligned.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counted = written(counted.withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    top = counted.groupBy("a").agg(F.max("n").alias("most"))
    return written(counted.join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def alignment_scores(aligned: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Adds n_best and count_sum to aligned documents.

    Counts of frequent pairs are looked up in the tasks: a pair that ``hot_share`` of the documents hold is one of at most
    (mean pairs of a document) / ``hot_share``, however many documents there are. The others are joined on the pair, which no
    larger share of the rows can hold.
    """
    spark = aligned.sparkSession
    counts = pair_counts(aligned)
    least = max(2, int(aligned.count() * hot_share))
    hot = counts.filter(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        pairs = np.append(pairs, np.int64(-1)) if len(pairs) == 0 else pairs
        for batch in batches:
            sums, bests, cold, cold_times = [], [], [], []
            for codes, times in zip(batch.column(1), batch.column(2)):
                codes = np.frombuffer(codes.as_buffer() or b"", "<i8")
                times = np.frombuffer(times.as_buffer() or b"", "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
                found = pairs[at] == codes
                at, here = at[found], times[found]
                sums.append(int((n[at] * here).sum()) if len(at) else 0)
                bests.append(int(here[best[at]].sum()) if len(at) else 0)
                cold.append(codes[~found])
                cold_times.append(times[~found])
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cold])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(c))) for c in (cold, cold_times)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sums, pa.int64()), pa.array(bests, pa.int64()), *lists], names=["key", "sum", "bests", "cold", "times"]
            )

    looked = written(
        aligned.select("key", "pairs", "times").mapInArrow(look_up, "key long, sum long, bests long, cold array<long>, times array<long>"), "links"
    )
    rare = looked.filter(F.size("cold") > 0).select("key", F.explode(F.arrays_zip("cold", "times")).alias("c"))
    rare = rare.select("key", F.col("c.cold").alias("pair"), F.col("c.times").alias("times"))
    scored = rare.join(counts.filter(F.col("n") < least), "pair").groupBy("key").agg(
        F.sum(F.col("n") * F.col("times")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("bests")
    )
    total = looked.select("key", "sum", "bests").unionByName(scored).groupBy("key").agg(
        F.sum("bests").alias("n_best"), F.sum("sum").alias("count_sum")
    )
    return aligned.drop("pairs", "times").join(total, "key").drop("key")


def cross_alignment(docs: DataFrame, a_path: str, b_path: str, chunk_bytes: int = CHUNK_BYTES, fan_in: int = FAN_IN,
                    hot_share: float = HOT_SHARE, segments: int = SEGMENTS) -> DataFrame:
    """Per document row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    Side a is a byte-level vocabulary of the tokenizers library and encodes a space and the text, side b a piece vocabulary of
    sentencepiece, which adds that space. Byte offsets where tokens of both sides end cut the text into groups, and a link is
    a pair of an a and a b token of one group. An id pair counts the documents that hold it linked; n_best are the links whose
    count is the highest of their a id, count_sum is the sum over the links. Null and empty texts, and texts holding U+2581,
    which the pieces give back as a space, have no tokens: zeros and ''. A null doc_id is kept, repeated rows count one by one, an
    empty table gives no rows, other columns are not read.
    """
    return alignment_scores(align_documents(docs, a_path, b_path, chunk_bytes, fan_in, segments), hot_share)


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))

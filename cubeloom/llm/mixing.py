"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A hash orders the documents of a source; equal ranges of the hash are its blocks, so a hot source has many blocks and a
block is a random part of its source. A source's target gives whole passes over all blocks and one pass that ends inside a
block. The block quotas of all sources are split down a binary tree to the output shards: a node draws its left half from
its own quotas without replacement, seeded by its place in the tree. A shard walks its own path, so neither the driver nor a
task holds the tree. It takes the next blocks of each source, and shuffles their documents locally.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cubeloom.llm.common import free_name, mixed_key, query, table, written

SEED = 20
BLOCK_WORDS = 200_000
BLOCKS_PER_SHARD = 16
MOST_REPEATS = 3
#: A table of sources up to this many rows is broadcast; a larger one is joined.
BROADCAST_SOURCES = 20_000
KEYS = float(1 << 63)
KEY_GAP = 2048  # two steps of a double near 2**63
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its source's size and the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    left = float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
        open_ = [i for i in open_ if i not in set(over)]
    return targets


@dataclass(frozen=True)
class Plan:
    """``sources``: one row per source; ``blocks``: one row per block with the shards of its passes."""

    sources: DataFrame
    blocks: DataFrame
    shards: int
    rows: int


def shard_quota(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first unit, units) of each source for one shard: the path from the root of the splitting tree."""
    have = np.asarray(quotas, np.int64)
    first = np.zeros_like(have)
    lo, hi, node = 0, shards, 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(have.sum())
        take = total * (mid - lo) // (hi - lo)
        draw = np.random.default_rng([seed, node])
        left = np.zeros_like(have)
        # one source after the other: exact, and free of the size limit of a joint draw
        need, rest = take, total
        for i, n in enumerate(have.tolist()):
            rest -= n
            got = need if rest == 0 else int(draw.hypergeometric(n, rest, need)) if need and n else 0
            left[i] = min(got, n)
            need -= int(left[i])
        if shard < mid:
            have, hi, node = left, mid, 2 * node
        else:
            first, have, lo, node = first + left, have - left, mid, 2 * node + 1
    return first, have


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds _size (words of the text) and _key (place in the permutation of its source; equal rows share a place)."""
    return docs.withColumns({"_size": words(F.col("text")), "_key": mixed_key(seed, "doc_id", "text")})


def make_plan(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = SEED, block_words: int = BLOCK_WORDS,
              blocks_per_shard: int = BLOCKS_PER_SHARD, most: int = MOST_REPEATS) -> Plan:
    """Targets, cutoffs and block placements from the sizes of all documents.

    Sources go by code point, null last, and take ``weights`` in turn. The driver holds one row per source.
    """
    spark = docs.sparkSession
    slim = written(keyed(docs, seed).select("source", "_size", "_key"), "mix-sizes")
    totals = slim.groupBy("source").agg(F.sum("_size").alias("size")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in totals]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], sum(sizes), most)
    blocks = [max(1, round(s / block_words)) for s in sizes]
    passes = [min(most, int(t // s)) if s else 0 for t, s in zip(targets, sizes)]
    rest = [t - p * s for t, s, p in zip(targets, sizes, passes)]
    known = "sid int, source string, source_size long, target double, blocks long, passes int, rest double"
    base = spark.createDataFrame(
        [(i, r["source"], s, t, b, p, x) for i, (r, s, t, b, p, x) in enumerate(zip(totals, sizes, targets, blocks, passes, rest))], known
    )
    cutoffs = _cutoffs(slim, base, len(totals))
    units = [p * b + (_block(cutoffs[i], b) + 1 if i in cutoffs else 0) for i, (p, b) in enumerate(zip(passes, blocks))]
    shards = max(1, -(-sum(units) // blocks_per_shard))
    sources = spark.createDataFrame(
        [(i, r["source"], s, t, b, p, cutoffs.get(i, -1)) for i, (r, s, t, b, p) in enumerate(zip(totals, sizes, targets, blocks, passes))],
        known.replace("rest double", "cutoff long"),
    )
    return Plan(sources, _placements(spark, units, blocks, shards, seed), shards, len(totals))


def _block(key: int, blocks: int) -> int:
    return min(blocks - 1, int(key / KEYS * blocks))


def block_of(key: Column, blocks: Column) -> Column:
    return F.least(blocks - 1, F.floor(key.cast("double") / F.lit(KEYS) * blocks)).cast("long")


def _with_sources(rows: DataFrame, sources: DataFrame, count: int) -> DataFrame:
    known = sources.withColumnRenamed("source", "_name")
    if count <= BROADCAST_SOURCES:
        known = F.broadcast(known)
    return rows.join(known, F.col("source").eqNullSafe(F.col("_name")), "left").drop("_name")


def _cutoffs(slim: DataFrame, sources: DataFrame, count: int) -> dict[int, int]:
    """By source: the last key of the pass that ends inside a block. The keys of one block are sorted, never a whole source."""
    rows = _with_sources(slim, sources.filter("rest > 0"), count).filter("sid IS NOT NULL")
    rows = rows.select("sid", "_size", "_key", "rest", block_of(F.col("_key"), F.col("blocks")).alias("block"))
    sums = rows.groupBy("sid", "block").agg(F.sum("_size").alias("words"), F.max("rest").alias("rest"))
    upto = F.sum("words").over(Window.partitionBy("sid").orderBy("block"))  # one row per block
    edge = sums.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    edge = edge.filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest") - 0.5)).groupBy("sid").agg(
        F.min_by(F.struct("block", "before"), "block").alias("edge")
    ).select("sid", "edge.block", "edge.before")
    inside = rows.join(edge, ["sid", "block"])
    end = F.sum("_size").over(Window.partitionBy("sid", "block").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = inside.withColumn("end", F.col("before") + end).filter(F.col("end") - F.col("_size") / 2 <= F.col("rest"))
    found = edge.join(near.groupBy("sid").agg(F.max("_key").alias("cutoff")), "sid", "left")
    found = found.join(sources.select("sid", "blocks"), "sid").collect()  # one row per source
    cutoffs = {}
    for r in found:
        # no document of the last block is near enough: the pass ends before that block
        cutoff = r["cutoff"] if r["cutoff"] is not None else int(r["block"] / r["blocks"] * KEYS) - KEY_GAP
        if cutoff >= 0:
            cutoffs[r["sid"]] = cutoff
    return cutoffs


def _placements(spark: SparkSession, units: Sequence[int], blocks: Sequence[int], shards: int, seed: int) -> DataFrame:
    """One row per (source, block): the shard of each pass over it, in order of the passes."""
    quotas, sizes = np.array(units, np.int64), np.array(blocks, np.int64)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                first, count = shard_quota(quotas, shards, int(shard), seed)
                sid = np.arange(len(first), dtype=np.int32)
                yield pd.DataFrame({"sid": sid, "of": sizes, "first": first, "n": count, "shard": np.int64(shard)})

    taken = spark.range(shards).mapInPandas(walk, "sid int, of long, first long, n long, shard long").filter("n > 0")
    taken = taken.select("sid", "of", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("unit"))
    placed = taken.select("sid", (F.col("unit") % F.col("of")).alias("block"), F.floor(F.col("unit") / F.col("of")).cast("int").alias("pass"), "shard")
    return placed.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("units"))


def draw(docs: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """Every document row with _size, source_size, target and draws: (pass, shard) of each time the mix takes it."""
    rows = _with_sources(keyed(docs, seed), plan.sources, plan.rows)
    rows = rows.withColumn("block", block_of(F.col("_key"), F.col("blocks")))
    times = F.col("passes") + (F.col("_key") <= F.col("cutoff")).cast("int")
    joined = rows.join(plan.blocks, ["sid", "block"], "left")
    none = F.array().cast("array<struct<pass:int,shard:long>>")
    taken = F.filter(F.coalesce("units", none), lambda u: u["pass"] < F.col("_times"))
    return joined.withColumn("_times", times).withColumn("draws", taken).drop("sid", "block", "blocks", "passes", "cutoff", "units", "_times")


def mixed_rows(docs: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """The rows that ``plan`` takes, with shard and place: a partition holds whole shards, each in the order of its places."""
    rows = draw(docs, plan, seed).select(*[docs[c] for c in docs.columns], "_key", F.explode("draws").alias("_draw"))
    order = mixed_key(seed + 1, F.col("_draw")["pass"], "_key")
    rows = rows.select(*docs.columns, F.col("_draw")["shard"].alias("shard"), order.alias("_order"))
    place = F.row_number().over(Window.partitionBy("shard").orderBy("_order"))  # a shard has a bounded number of blocks
    # the sort needs shard and place, so the rows are dealt and shuffled even where a caller drops both columns
    return rows.withColumn("place", place).drop("_order").sortWithinPartitions("shard", "place")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), seed: int = SEED, block_words: int = BLOCK_WORDS,
        blocks_per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """The mixed rows (documents repeat as often as they are drawn) with shard and place in the shard, dealt and sorted by them.

    Null texts have size 0; a source of size 0 has target 0; a null source is a source of its own, null ids are kept; repeated rows are
    rows and are taken alike; an empty table gives no rows. Extra columns are carried along whatever their names; shard and place
    get underscores before them while the table has a column of that name.
    """
    used = ("doc_id", "source", "text")
    others = [c for c in docs.columns if c not in used]
    carried = docs.select(*used, F.struct(*others, F.lit(0).alias(free_name("_none", docs.columns))).alias("_carried"))
    rows = mixed_rows(carried, make_plan(carried, weights, seed, block_words, blocks_per_shard), seed)
    shard, place = (free_name(n, docs.columns) for n in ("shard", "place"))
    own = [F.col(c) if c in used else F.col("_carried")[c].alias(c) for c in docs.columns]
    return rows.select(*own, F.col("shard").alias(shard), F.col("place").alias(place))


def taken_words(docs: DataFrame, plan: Plan, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken per row of doc_id, source, text: the words that the mixed rows hold of it, 0 if not drawn.

    The mixed rows are made and written, and the words are counted in their texts; repeated rows share what is found of them.
    """
    row = ("doc_id", "source", "_key")
    mixed = written(mixed_rows(docs.select("doc_id", "source", "text"), plan, seed), "mixed")
    found = keyed(mixed, seed).groupBy(*[F.col(c).alias(f"_m_{c}") for c in row]).agg(F.sum("_size").alias("_words"))
    every = _with_sources(keyed(docs, seed).select(*row, "_size"), plan.sources, plan.rows)
    every = every.groupBy(*row, "_size", "source_size", "target").agg(F.count("*").alias("_copies"))
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in row]
    joined = every.join(found, same[0] & same[1] & same[2], "left")
    taken = F.coalesce(F.expr("_words div _copies"), F.lit(0)).cast("long")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    rows = joined.select("doc_id", F.col("_size").alias("size"), "source_size", "target", taken.alias("taken"), each.alias("_copy"))
    return rows.drop("_copy")


@query("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return taken_words(docs, make_plan(docs))

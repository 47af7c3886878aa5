"""Exact "first q rows per group" and numbering that never put a group into one task.

A window over a label, a layer or a whole scene would sort that group in a single task. Here a
group is first counted per key bucket (partial aggregation), the bucket holding the q-th row is
found from those counts, and only that bucket is ranked. The outcome is one cutoff per group;
rows are then kept or dropped by comparing with it, in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cubeloom.functions.vectors import ARITH_KEY_RANGE
from cubeloom.session import cut_lineage

BUCKETS = 8192


def quota_cutoffs(
    df: DataFrame,
    groups: Sequence[str],
    key: Column,
    tie: Column,
    quota: Column | int,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per group: the (key, tie) of its quota-th row in (key, tie) order, with the group's size.

    ``key`` lies in [0, 2^31-1); ``quota`` may use the column ``group_rows`` and is clipped to the
    group size. Groups with quota 0 get a null cutoff.
    """
    width = -(-ARITH_KEY_RANGE // buckets)
    slim = df.select(*groups, key.cast("long").alias("_key"), tie.alias("_tie"))
    slim = slim.withColumn("_bucket", F.floor(F.col("_key") / width).cast("int"))
    counts = slim.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    # at most `buckets` rows per group from here on
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    running = counts.withColumn("_end", F.sum("_n").over(by_group.orderBy("_bucket"))).withColumn(
        "group_rows", F.sum("_n").over(by_group)
    )
    wanted = quota if isinstance(quota, Column) else F.lit(quota)
    running = running.withColumn("_quota", F.least(wanted.cast("long"), F.col("group_rows")))
    edge = running.filter((F.col("_quota") > F.col("_end") - F.col("_n")) & (F.col("_quota") <= F.col("_end")))
    edge = edge.select(*groups, "_bucket", (F.col("_quota") - F.col("_end") + F.col("_n")).alias("_rest"))
    ranked = slim.join(edge, [*groups, "_bucket"]).withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_key", "_tie"))
    )
    cutoff = ranked.filter(F.col("_rn") == F.col("_rest")).select(
        *groups, F.struct("_key", "_tie").alias("cutoff")
    )
    sizes = running.groupBy(*groups).agg(F.max("group_rows").alias("group_rows"))
    if not groups:
        keyed = cutoff.withColumn("_g", F.lit(0))
        return sizes.withColumn("_g", F.lit(0)).join(keyed, "_g", "left").drop("_g")
    return sizes.join(cutoff, list(groups), "left")


def flag_first(
    df: DataFrame,
    groups: Sequence[str],
    key: Column,
    tie: Column,
    quota: Column | int,
    flag: str = "selected",
) -> DataFrame:
    """Adds ``flag``: true for the first ``quota`` rows of each group in (key, tie) order."""
    cutoffs = quota_cutoffs(df, groups, key, tie, quota)
    mine = F.struct(key.cast("long").alias("_key"), tie.alias("_tie"))
    chosen = F.coalesce(mine <= F.col("cutoff"), F.lit(False))
    if not groups:
        joined = df.withColumn("_g", F.lit(0)).join(F.broadcast(cutoffs.withColumn("_g", F.lit(0))), "_g", "left")
        return joined.withColumn(flag, chosen).drop("_g", "cutoff", "group_rows")
    # one row per group: Spark broadcasts it below its size limit, AQE splits a hot group otherwise
    return df.join(cutoffs, list(groups), "left").withColumn(flag, chosen).drop("cutoff", "group_rows")


def ranged(df: DataFrame, order: str, name: str = "_b") -> DataFrame:
    """Rows dealt to value ranges of ``order``, numbered in order by ``name``: one range per partition, so ranges grow with the data.

    The rows are checkpointed, which fixes the ranges.
    """
    return cut_lineage(df.repartitionByRange(order).withColumn(name, F.spark_partition_id()))


def number_rows(df: DataFrame, order: str, name: str, groups: Sequence[str] = ()) -> DataFrame:
    """1-based consecutive numbers in the order of a unique column, without a global window.

    Rows are dealt to value ranges; each range is numbered on its own and shifted by the sizes
    of the ranges before it.
    """
    bucketed = ranged(df, order)
    sizes = bucketed.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    offsets = sizes.withColumn(
        "_offset",
        F.coalesce(F.sum("_n").over(before.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_n")
    local = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(order))
    numbered = bucketed.withColumn("_rn", local).join(offsets, [*groups, "_b"])
    return numbered.withColumn(name, (F.col("_rn") + F.col("_offset")).cast("long")).drop("_b", "_rn", "_offset")


def sample_order(df: DataFrame, row: str = "row", col: str = "col") -> DataFrame:
    """Samples in (row, col) order: a range-partitioned distributed sort."""
    return df.orderBy(row, col)


def top_per_group(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column], limit: int, name: str = "rank"
) -> DataFrame:
    """First ``limit`` rows per group. The constant limit lets Spark drop rows before the shuffle
    (partial group limit), so a hot group ships at most ``limit`` rows per input partition."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.filter(F.col(name) <= limit)

"""Connected components of a link table, without a hub in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.llm.common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(u, v): root is the smallest node reachable.

    Each round hooks every node to its smallest neighbour below it, flattens the trees by pointer doubling, and keeps only the
    links between different trees. Joins on a hub can be split by Spark, because no aggregate stands on them.
    """
    spark = edges.sparkSession
    edges = written(_between(edges), "links")
    labels, first = None, True
    while not edges.isEmpty():
        parent = written(edges.groupBy("u").agg(F.min("v").alias("p")), "parents")
        while True:
            upper = parent.select(F.col("u").alias("p"), F.col("p").alias("top"))
            jumped = written(parent.join(upper, "p", "left").select("u", F.coalesce("top", "p").alias("p"), F.col("top").isNotNull().alias("moved")), "parents")
            drop_written(spark, parent)
            parent = jumped
            if parent.filter("moved").isEmpty():
                break
        parent = parent.select("u", "p")
        if labels is None:
            nodes = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
            labels = nodes.withColumn("root", F.col("node"))
        after = labels.join(parent.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
        after = written(after, "labels")
        mapped = edges
        for end in ("u", "v"):
            mapped = mapped.join(parent.select(F.col("u").alias(end), F.col("p").alias("_p")), end, "left").withColumn(end, F.coalesce("_p", end)).drop("_p")
        left = written(_between(mapped), "links")
        drop_written(spark, *([] if first else [labels]), edges, parent)
        labels, edges, first = after, left, False
    drop_written(spark, edges)
    return labels if labels is not None else spark.createDataFrame([], "node long, root long")


def _between(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

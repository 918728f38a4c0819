"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kanaforge.llm.common import drop, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Every neighbour above a node moves to the smallest node of its neighbourhood.

    The smallest neighbours are written first: with plain exchanges on both sides of the join, the edges of a hub
    can be split over tasks."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least, path = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
    moved, to = materialize(both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
    drop(edges.sparkSession, path)
    return moved, to


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, move to the smallest of them. edges: u < v."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v")
    return moved.unionByName(least.select(F.col("m").alias("u"), "v"))


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of longs -> (node, component) for every node with an edge to another node.

    component is the smallest node that can be reached. Self-edges, repeated and null edges change nothing; an
    empty table gives an empty one. Each round writes its edges to the shared folder; hubs are never gathered."""
    spark = edges.sparkSession
    now, path = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    mark = None
    while True:
        large, large_path = _large_star(now)
        stars, new_path = materialize(_small_star(large).distinct())
        drop(spark, path)
        drop(spark, large_path)
        now, path = stars, new_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
        mark = seen

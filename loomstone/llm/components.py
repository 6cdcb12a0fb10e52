"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import checkpoint


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = both.join(_min_neighbour(both), "u").where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _min_neighbour(down)
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node on an edge; a component's name is its smallest node.

    ``edges`` has two long columns, u and v, in any order; loops, nulls and
    repeats do no harm. Each round ends in a checkpoint; rounds grow with the
    logarithm of the longest path.
    """
    now = checkpoint(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct())
    while not _stars(now):
        now = checkpoint(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every edge goes from a node of that edge only down to a node that has none of its own."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("low"), (F.col("u") < F.col("v")).alias("up")).union(edges.select("v", F.lit(0), F.lit(False)))
    odd = ends.groupBy("node").agg(F.sum("low").alias("low"), F.count("*").alias("all"), F.max("up").alias("up"))
    return odd.where("(low > 0 and all > 1) or up").limit(1).count() == 0
